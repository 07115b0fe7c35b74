"""Queries over pixels: every embedding is an 8 x 8 image of one channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import geometry as G
from scanweave.functions import pixels as P
from scanweave.operators import codecs as C
from scanweave.operators import imaging as I
from scanweave.plans.registry import query, table

# the pixels in DuckDB
PX = """px AS (SELECT vec_id, label, (i - 1) % 8 AS x, (i - 1) // 8 AS y, embedding[i]::DOUBLE AS v
        FROM embeddings, range(1, 65) AS r(i))"""
# red, green and blue from three neighbouring embeddings
RGB = f"""{PX}, rgb AS (SELECT vec_id // 3 AS img, x, y, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS r,
        max(CASE WHEN vec_id % 3 = 1 THEN v END) AS g, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS b FROM px GROUP BY 1, 2, 3)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.block_pixels(table(spark, sf_dir, "embeddings"), "embedding", 8, "vec_id", "label")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("c", F.pmod("vec_id", F.lit(3)))
    of = lambda k: F.max(F.when(F.col("c") == k, F.col("v")))
    return px.groupBy(F.expr("vec_id div 3").alias("img"), "x", "y").agg(of(0).alias("r"), of(1).alias("g"), of(2).alias("b"))


def _lum(v: str) -> str:
    return f"({v} * 0.2126 + {v} * 0.7152 + {v} * 0.0722)"


def _bin(lum: str) -> str:
    return f"CASE WHEN isnan({lum}) THEN 0 WHEN {lum} >= 1 THEN 63 ELSE trunc({lum} * 64)::INT END"


@query(f"WITH {PX}, s AS (SELECT label, greatest(v, 0.0) AS v FROM px) SELECT label, {_bin(_lum('v'))} AS bin, count(*) AS n FROM s GROUP BY ALL")
def luminance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("v", P.displayed(F.col("v"), 0.0, 1.0))
    return I.histogram(px.withColumn("lum", P.luminance(F.col("v"), F.col("v"), F.col("v"))), "lum", "label")


@query(
    f"""WITH {PX}, s AS (SELECT label, pow(greatest(v * 4.0, 0.0), 1 / 2.2) AS v FROM px), h AS (SELECT label, {_bin(_lum('v'))} AS bin, count(*) AS n FROM s GROUP BY ALL),
    p AS (SELECT label, max(n) AS peak FROM h GROUP BY 1)
    SELECT p.label, b.bin::INT AS bin, coalesce(h.n, 0) AS n, coalesce(h.n, 0) / greatest(p.peak, 1) AS bar
    FROM p CROSS JOIN range(64) AS b(bin) LEFT JOIN h ON h.label = p.label AND h.bin = b.bin"""
)
def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("v", P.displayed(F.col("v"), 2.0, 2.2))
    return I.dense_histogram(I.histogram(px.withColumn("lum", P.luminance(F.col("v"), F.col("v"), F.col("v"))), "lum", "label"), "label")


@query(f"WITH {RGB}, s AS (SELECT greatest(coalesce(r, 0), 0) * 0.2126 + greatest(coalesce(g, 0), 0) * 0.7152 + greatest(coalesce(b, 0), 0) * 0.0722 AS l FROM rgb) SELECT {_bin('l')} AS bin, count(*) AS n FROM s GROUP BY ALL")
def rgb_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [P.displayed(F.coalesce(c, F.lit(0.0)), 0.0, 1.0) for c in ("r", "g", "b")]
    return I.histogram(rgb(spark, sf_dir).select(P.luminance(*shown).alias("lum")), "lum")


def _byte(c: str) -> str:
    v = f"pow(greatest(coalesce({c}, 0.0) * 2.0, 0.0), 1 / 2.2)"
    return f"CASE WHEN {v} >= 1 THEN 255 ELSE trunc({v} * 255)::INT END AS {c}"


@query(f"WITH {RGB} SELECT img, x::INT AS x, y::INT AS y, {_byte('r')}, {_byte('g')}, {_byte('b')}, least(greatest(trunc((1 + g) * 255), 0), 255)::INT AS a FROM rgb WHERE g IS NOT NULL")
def tone_map_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = rgb(spark, sf_dir).filter("g IS NOT NULL")
    return I.tone_mapped(px, F.col("r"), F.col("g"), F.col("b"), 1 + F.col("g"), 1.0, 2.2, "img", "x", "y")


@query(f"WITH {PX} SELECT vec_id, x::INT AS x, y::INT AS y, (x // 2)::INT AS sx, (y // 2)::INT AS sy, v FROM px WHERE x % 2 = 0 AND y % 2 = 0")
def subsample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, zero, two = pixels(spark, sf_dir), F.lit(0), F.lit(2)
    kept = px.filter(G.is_sampled(F.col("x"), zero, two) & G.is_sampled(F.col("y"), zero, two))
    return kept.select("vec_id", "x", "y", G.sampled_row(F.col("x"), zero, two).alias("sx"), G.sampled_row(F.col("y"), zero, two).alias("sy"), "v")


@query(
    """WITH w AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_partkey % 50 - 25)::INT AS lo, (l_partkey % 50 - 25 + l_suppkey % 40 - 2)::INT AS hi, (l_linenumber - 2)::INT AS s FROM lineitem),
    g AS (SELECT *, CASE WHEN s <= 0 THEN 1 ELSE s END AS e FROM w), f AS (SELECT *, lo + (((-lo) % e) + e) % e AS first_at FROM g)
    SELECT lo, hi, s, first_at::INT AS first_at, CASE WHEN hi < first_at THEN 0 ELSE (hi - first_at) // e + 1 END::INT AS n, greatest(0, least(16, hi - lo + 1))::INT AS lines, count(*) AS c FROM f GROUP BY ALL"""
)
def sample_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lo, hi, s = F.col("lo"), F.col("hi"), F.col("s")
    w = li.select((F.pmod("l_partkey", F.lit(50)) - 25).cast("int").alias("lo"), (F.pmod("l_partkey", F.lit(50)) - 25 + F.pmod("l_suppkey", F.lit(40)) - 2).cast("int").alias("hi"), (F.col("l_linenumber") - 2).cast("int").alias("s"))
    w = w.groupBy("lo", "hi", "s").agg(F.count("*").alias("c"))
    return w.select("lo", "hi", "s", G.first_sample(lo, s).cast("int").alias("first_at"), G.sample_count(lo, hi, s).alias("n"), G.lines_in_chunk(lo, hi, F.lit(16)).alias("lines"), "c")


@query(
    f"""WITH {PX}, g AS (SELECT e.vec_id, x, y, least(greatest(floor(x / 2.0 + 0.5)::INT, 0), 3) AS sx, least(greatest(floor(y / 2.0 + 0.5)::INT, 0), 3) AS sy
        FROM embeddings e, range(8) AS a(x), range(8) AS b(y))
    SELECT g.vec_id, g.x::INT AS x, g.y::INT AS y, px.v FROM g JOIN px ON px.vec_id = g.vec_id AND px.x = 2 * g.sx AND px.y = 2 * g.sy"""
)
def nearest_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter("embedding", lambda v, i: (F.pmod(i, F.lit(8)) % 2 == 0) & (F.floor(i / 8) % 2 == 0))
    small = table(spark, sf_dir, "embeddings").select("vec_id", kept.alias("s"))
    return I.upsampled(small, "vec_id", "s", 8, 8, 2, 2, 4, 4)


@query(f"WITH {RGB} SELECT img, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, 0.0::DOUBLE AS a, 103 AS file_x, 45 AS file_y FROM rgb WHERE x = 3 AND y = 5")
def pixel_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir).withColumn("img", F.expr("vec_id div 3")).withColumn("channel", F.element_at(F.array(F.lit("R"), F.lit("G"), F.lit("B")), (F.pmod("vec_id", F.lit(3)) + 1).cast("int")))
    return I.inspected(px, "img", 3, 5, 100, 40)


@query("SELECT label, count(*) AS n, min(s) AS s, min(ox) AS ox, min(oy) AS oy, min(zs) AS zs, min(zp) AS zp FROM (SELECT label, least(640.0 / (100 + label), 480.0 / (50 + label)) AS s, (640 - (100 + label) * least(640.0 / (100 + label), 480.0 / (50 + label))) / 2 AS ox, (480 - (50 + label) * least(640.0 / (100 + label), 480.0 / (50 + label))) / 2 AS oy, least(greatest(0.5 * 1.1, 0.005), 50.0)::DOUBLE AS zs, label - (label - 10.0) * 1.1::DOUBLE AS zp FROM embeddings) GROUP BY label")
def view_fit_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    scale, ox, oy = I.view(100 + F.col("label"), 50 + F.col("label"), 640.0, 480.0)
    zs, zp = I.zoomed(F.lit(0.5), F.lit(10.0), F.col("label").cast("double"), F.lit(True))
    return e.groupBy("label").agg(F.count("*").alias("n")).select("label", "n", scale.alias("s"), ox.alias("ox"), oy.alias("oy"), zs.alias("zs"), F.round(zp, 9).alias("zp"))


_BASIS = "SELECT u, i, (CASE WHEN u = 0 THEN sqrt(1 / 8.0) ELSE 0.5 END) * cos((2 * i + 1) * u * pi() / 16) AS m FROM range(8) AS a(u), range(8) AS b(i)"


@query(
    f"""WITH {PX}, basis AS ({_BASIS}), h AS (SELECT vec_id, y, i AS x, sum(v * m) AS h FROM px JOIN basis ON px.x = u GROUP BY ALL)
    SELECT vec_id, x::INT AS x, i::INT AS y, round(sum(h * m), 4) + 0.0 AS v FROM h JOIN basis ON h.y = u GROUP BY ALL"""
)
def idct8x8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", C.idct(F.col("embedding")).alias("e"))
    return I.block_pixels(e, "e", 8, "vec_id").withColumn("v", F.round("v", 4) + 0.0)


@query(
    f"WITH z(i, p) AS (VALUES {', '.join(f'({i}, {p})' for i, p in enumerate(C.zigzag()))}) SELECT vec_id, (p % 8)::INT AS x, (p // 8)::INT AS y, embedding[i + 1]::DOUBLE AS v FROM embeddings, z"
)
def zigzag_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", C.unzigzagged(F.col("embedding")).alias("e"))
    return I.block_pixels(e, "e", 8, "vec_id")


@query(f"WITH {RGB} SELECT img, x::INT AS x, y::INT AS y, round(r + 1.5747 * b, 9) AS red, round(r - 0.1873 * g - 0.4682 * b, 9) AS green, round(r + 1.8556 * g, 9) AS blue FROM rgb WHERE b IS NOT NULL")
def csc709(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.csc709(F.col("r"), F.col("g"), F.col("b"))
    return rgb(spark, sf_dir).filter("b IS NOT NULL").select("img", "x", "y", *(F.round(c, 9).alias(n) for c, n in zip(out, ("red", "green", "blue"), strict=True)))


@query(f"WITH {PX} SELECT vec_id, x::INT AS x, y::INT AS y, round(sign(v) * CASE WHEN abs(v * 5) <= 1 THEN pow(abs(v * 5), 2.2) ELSE pow(pow(2.7182818, 2.2), abs(v * 5) - 1) END, 8) + 0.0 AS v FROM px")
def dwa_to_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("vec_id", "x", "y", F.round(P.to_linear(F.col("v") * 5), 8).alias("v"))


@query(f"WITH {PX}, t AS (SELECT label, CASE WHEN x < 4 THEN 'left' ELSE 'right' END AS view, v FROM px) SELECT label, view, min(v) AS lo, max(v) AS hi, round(avg(v), 9) AS mean, count(*) AS n FROM t GROUP BY ALL")
def plane_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pixels(spark, sf_dir).withColumn("view", F.when(F.col("x") < 4, "left").otherwise("right"))
    return t.groupBy("label", "view").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.round(F.avg("v"), 9).alias("mean"), F.count("*").alias("n"))


_SHOWN = f"{RGB}, c AS (SELECT img, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM rgb)"


def _hist(value: str) -> str:
    lum = " + ".join(f"{value.format(c=c)} * {w}" for c, w in zip("rgb", P.LUMINANCE, strict=True))
    return f"WITH {_SHOWN}, s AS (SELECT img, {lum} AS l FROM c) SELECT img, {_bin('l')} AS bin, count(*) AS n FROM s GROUP BY ALL"


@query(_hist("pow(greatest({c} * 2.0, 0.0), 1 / 2.2)"))
def histogram_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rendered_histogram(rgb(spark, sf_dir), "display", 1.0, 2.2, "img")


@query(_hist("{c}"))
def histogram_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rendered_histogram(rgb(spark, sf_dir), "linear", 1.0, 2.2, "img")


@query(f"WITH {PX} SELECT vec_id, x::INT AS x, (7 - y)::INT AS y, round(least(greatest(pow(greatest(v * 4.0, 0.0), 1 / 2.2), 0.0), 1.0), 9) AS v FROM px")
def shader_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    return px.select("vec_id", "x", I.flipped(F.col("y"), F.lit(8)).alias("y"), F.round(I.shaded(F.col("v"), 2.0, 2.2), 9).alias("v"))


_WINDOWS = "w AS (SELECT vec_id, (label - 3)::INT AS dx0, (2 - label)::INT AS dy0, (label + 4)::INT AS dx1, (9 - label)::INT AS dy1, CASE WHEN vec_id % 3 > 0 THEN (CASE WHEN vec_id % 3 = 1 THEN -3 ELSE label - 3 END)::INT END AS px0, (CASE WHEN vec_id % 3 = 1 THEN 0 ELSE 2 - label END)::INT AS py0, (CASE WHEN vec_id % 3 = 1 THEN 20 ELSE label + 4 END)::INT AS px1, (CASE WHEN vec_id % 3 = 1 THEN 11 ELSE 9 - label END)::INT AS py1 FROM embeddings)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data windows of 8 x 8 pixels, with no display window, with another, and with the same."""
    e, label, kind = table(spark, sf_dir, "embeddings"), F.col("label"), F.pmod("vec_id", F.lit(3))
    box = lambda *c: F.struct(*(F.when(kind == 1, a).otherwise(b).cast("int").alias(n) for (a, b), n in zip(c, ("x_min", "y_min", "x_max", "y_max"), strict=True)))
    own = (label - 3, 2 - label, label + 4, 9 - label)
    return e.select("vec_id", box(*((v, v) for v in own)).alias("data"), F.when(kind > 0, box(*zip((F.lit(-3), F.lit(0), F.lit(20), F.lit(11)), own, strict=True))).alias("display"))


@query(
    f"""WITH {_WINDOWS}, r AS (SELECT vec_id, dx0 - coalesce(px0, dx0) AS x, dy0 - CASE WHEN px0 IS NULL THEN dy0 ELSE py0 END AS y, CASE WHEN px0 IS NULL THEN 8 ELSE px1 - px0 + 1 END AS w, CASE WHEN px0 IS NULL THEN 8 ELSE py1 - py0 + 1 END AS h FROM w),
    p AS (SELECT *, (vec_id % 23 - 4.0) AS mx, (vec_id % 19 - 2.0) AS my FROM r), q AS (SELECT *, floor((mx - 1.5) / 0.5 - x)::INT AS ix, floor((my - 0.25) / 0.5 - y)::INT AS iy FROM p)
    SELECT vec_id, x::INT AS x, y::INT AS y, CASE WHEN vec_id % 5 > 0 THEN 8 END AS guarded, w::INT AS width, h::INT AS height, (x = 0 AND y = 0 AND w = 8 AND h = 8) AS equal, CASE WHEN ix BETWEEN 0 AND 7 AND iy BETWEEN 0 AND 7 THEN ix END AS px, CASE WHEN ix BETWEEN 0 AND 7 AND iy BETWEEN 0 AND 7 THEN iy END AS py FROM q"""
)
def window_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows(spark, sf_dir).withColumn("rect", I.data_rect(F.col("data"), F.col("display"))).withColumn("shown", I.display_rect(F.col("data"), F.col("display")))
    decoded = F.when(F.pmod("vec_id", F.lit(5)) > 0, 8).otherwise(9)
    at = I.pixel_at(F.pmod("vec_id", F.lit(23)) - 4.0, F.pmod("vec_id", F.lit(19)) - 2.0, F.lit(1.5), F.lit(0.25), F.lit(0.5), F.col("rect"))
    w = w.withColumn("at", at).withColumn("guard", I.guarded_rect(F.col("rect"), decoded, decoded))
    return w.select("vec_id", "rect.x", "rect.y", F.col("guard.width").alias("guarded"), "shown.width", "shown.height", I.same_rect(F.col("rect"), F.col("shown")).alias("equal"), F.col("at.x").alias("px"), F.col("at.y").alias("py"))


@query("SELECT DISTINCT (['?renderer=CPU', '?a=1&renderer=webgl2', 'renderer=vulkan', '', '?renderer=', '?renderer=auto&x=2'])[(event_id % 6 + 1)::INT] AS q, (['cpu', 'webgl2', 'auto', 'auto', 'auto', 'auto'])[(event_id % 6 + 1)::INT] AS preference FROM events")
def renderer_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(*map(F.lit, ("?renderer=CPU", "?a=1&renderer=webgl2", "renderer=vulkan", "", "?renderer=", "?renderer=auto&x=2")))
    q = table(spark, sf_dir, "events").select(F.get(given, F.pmod("event_id", F.lit(6))).alias("q")).distinct()
    return q.select("q", I.renderer_preference(F.col("q")).alias("preference"))
