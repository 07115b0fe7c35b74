"""Pixel tables: (image, channel, x, y, value) and what is computed over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.functions import geometry as G
from scanweave.functions import pixels as P


def block_pixels(images: DataFrame, values: str, width: int, *keys: str) -> DataFrame:
    """One row a pixel of row-major arrays: keys, x, y, v."""
    spread = images.select(*keys, F.posexplode(values).alias("i", "v"))
    return spread.select(*keys, F.pmod("i", F.lit(width)).alias("x"), F.expr(f"int(i div {width})").alias("y"), F.col("v").cast("double").alias("v"))


def histogram(lum: DataFrame, column: str, *keys: str, bins: int = 64) -> DataFrame:
    """Counts by bin of luminance: keys, bin, n, without empty bins."""
    return lum.groupBy(*keys, P.bin_of(F.col(column), bins).alias("bin")).agg(F.count("*").alias("n"))


def dense_histogram(counts: DataFrame, *keys: str, bins: int = 64) -> DataFrame:
    """All bins of every key, those without pixels with 0, and each bar's share of the peak."""
    every = counts.groupBy(*keys).agg(F.max("n").alias("peak")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "bin", "n", (F.col("n") / F.greatest("peak", F.lit(1))).alias("bar"))


def tone_mapped(px: DataFrame, r: Column, g: Column, b: Column, a: Column, exposure: float, gamma: float, *keys: str) -> DataFrame:
    """Bytes of red, green, blue and alpha; a channel that is missing is black, a missing alpha opaque."""
    byte = lambda c: P.to_byte(P.displayed(F.coalesce(c, F.lit(0.0)), exposure, gamma))
    return px.select(*keys, byte(r).alias("r"), byte(g).alias("g"), byte(b).alias("b"), P.alpha_byte(a).alias("a"))


def upsampled(samples: DataFrame, key: str, values: str, width: int, height: int, sx: int, sy: int, sw: int, sh: int) -> DataFrame:
    """Full-size pixels (key, x, y, v) of a subsampled plane, each the nearest sample; a plane without samples is 0.

    The maps of columns and rows are arrays made once, so no join is needed.
    """
    if sx <= 1 and sy <= 1 and (sw, sh) == (width, height):
        return block_pixels(samples, values, width, key)
    at = lambda n, s, count: G.nearest_sample(F.col(n), F.lit(0), F.lit(s), F.lit(count))
    grid = samples.select(key, values, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    grid = grid.select(key, values, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    value = F.get(values, at("y", sy, sh) * sw + at("x", sx, sw)) if sw and sh else F.lit(None)
    return grid.select(key, "x", "y", F.coalesce(value.cast("double"), F.lit(0.0)).alias("v"))


def inspected(planes: DataFrame, key: str, x: int, y: int, x_min: int, y_min: int) -> DataFrame:
    """The values of one pixel, with its place in the file's window; a missing channel is 0."""
    channels = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("v"))), F.lit(0.0)).alias(c.lower()) for c in ("R", "G", "B", "A")]
    return planes.filter((F.col("x") == x) & (F.col("y") == y)).groupBy(key).agg(*channels).withColumn("file_x", F.lit(x + x_min)).withColumn("file_y", F.lit(y + y_min))


def view(width: Column, height: Column, avail_w: float, avail_h: float) -> tuple[Column, Column, Column]:
    """Scale and offsets that fit an image into a view, centred."""
    scale = F.least(avail_w / width, avail_h / height)
    return scale, (avail_w - width * scale) / 2, (avail_h - height * scale) / 2


def zoomed(scale: Column, pan: Column, at: Column, inwards: Column) -> tuple[Column, Column]:
    """A zoom step about a point that stays where it is: (scale, pan); the scale stays within 0.005 and 50."""
    new = F.least(F.greatest(F.when(inwards, scale * 1.1).otherwise(scale / 1.1), F.lit(0.005)), F.lit(50.0))
    return new, at - (at - pan) * (new / scale)


def rendered_histogram(px: DataFrame, mode: str, exposure: float, gamma: float, *keys: str, bins: int = 64) -> DataFrame:
    """Counts by bin of luminance of pixels (keys, r, g, b): 'display' after exposure and gamma, 'linear' of the values as they are."""
    if mode not in ("display", "linear"):
        raise ValueError(f"no such mode: {mode}")
    r, g, b = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "rgb")
    if mode == "display":
        r, g, b = (P.displayed(c, exposure, gamma) for c in (r, g, b))
    return histogram(px.withColumn("_lum", P.luminance(r, g, b)), "_lum", *keys, bins=bins)


def shaded(v: Column, exposure: float, gamma: float) -> Column:
    """A channel as the shader gives it: exposed, not below 0, to the power 1 / gamma, within 0 and 1."""
    return F.least(F.greatest(P.displayed(F.coalesce(v, F.lit(0.0)), exposure, gamma), F.lit(0.0)), F.lit(1.0))


def flipped(y: Column, height: Column) -> Column:
    """Rows counted from the bottom."""
    return height - 1 - y


def renderer_preference(query: Column) -> Column:
    """The value of ?renderer= in a query string, in lower case; auto where there is none or an unknown one."""
    text = F.when(F.startswith(query, F.lit("?")), query).otherwise(F.concat(F.lit("?"), query))
    asked = F.lower(F.try_parse_url(F.concat(F.lit("http://x/"), text), F.lit("QUERY"), F.lit("renderer")))
    return F.when(asked.isin("webgl2", "cpu", "auto"), asked).otherwise(F.lit("auto"))


RECT = "struct<x:int,y:int,width:int,height:int>"


def _rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def _size(w: Column) -> tuple[Column, Column]:
    return G.extent(w["x_min"], w["x_max"]), G.extent(w["y_min"], w["y_max"])


def data_rect(data: Column, display: Column) -> Column:
    """The data window in the display window's space; the data window stands in for a display window that isn't there."""
    ref = F.coalesce(display, data)
    return F.when(data.isNotNull(), _rect(data["x_min"] - ref["x_min"], data["y_min"] - ref["y_min"], *_size(data)))


def guarded_rect(rect: Column, width: Column, height: Column) -> Column:
    """The rectangle, if decoded pixels have its size; else null."""
    return F.when((rect["width"] == width) & (rect["height"] == height), rect)


def display_rect(data: Column, display: Column) -> Column:
    """The display window (or else the data window) from the origin."""
    return F.when(data.isNotNull(), _rect(F.lit(0), F.lit(0), *_size(F.coalesce(display, data))))


def same_rect(a: Column, b: Column) -> Column:
    """Are both there and equal?"""
    return F.coalesce(a == b, F.lit(False))


def pixel_at(mx: Column, my: Column, pan_x: Column, pan_y: Column, scale: Column, rect: Column) -> Column:
    """The pixel of the data window under a place on the screen; null outside of it."""
    x = F.floor((mx - pan_x) / scale - rect["x"]).cast("int")
    y = F.floor((my - pan_y) / scale - rect["y"]).cast("int")
    return F.when((x >= 0) & (x < rect["width"]) & (y >= 0) & (y < rect["height"]), F.struct(x.alias("x"), y.alias("y")))
