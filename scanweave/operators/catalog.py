"""Catalogues of files and channels: frame sequences, layers, channel mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanweave.functions.pixels import padded


def is_image_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.exr$")


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def natural_key(path: Column) -> Column:
    """Sorts runs of digits by their number, and text between them by Unicode's collation, case and accents aside: digits get leading zeros up to 20 places."""
    wide = F.regexp_replace(path, r"(\d+)", "00000000000000000000$1")
    return F.collate(F.regexp_replace(wide, r"0*(\d{20})(?!\d)", "$1"), "UNICODE_CI_AI")


def described(files: DataFrame, path: str = "path") -> DataFrame:
    """files with name, sequence_path, extension, frame_digits, frame_number and sequence_key.

    The stem's last run of digits is the frame number; files that differ in it
    alone, case aside, are one sequence.
    """
    p = normal_path(F.col(path))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    folder = F.regexp_extract(p, r"^(.*/)[^/]*$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    seq = F.concat(folder, F.substring(stem, F.lit(1), F.length(stem) - F.length(digits)))
    out = files.withColumn("name", name).withColumn("sequence_path", seq).withColumn("extension", ext).withColumn("frame_digits", digits)
    out = out.withColumn("frame_number", F.when(F.col("frame_digits") != "", F.expr("try_cast(frame_digits AS BIGINT)")))
    mark = F.when(F.col("frame_digits") != "", F.lit("#")).otherwise(F.lit(""))
    return out.withColumn("sequence_key", F.concat(F.lower("sequence_path"), mark, F.lower("extension")))


def sources(frames: DataFrame, path: str = "path") -> DataFrame:
    """One row a sequence: key, frames, first and last frame number, label."""
    first = lambda c: F.min_by(c, F.struct(F.col("frame_number").isNull(), "frame_number", path))
    g = frames.groupBy("sequence_key").agg(
        F.count("*").alias("frames"),
        F.min("frame_number").alias("first_frame"),
        F.max("frame_number").alias("last_frame"),
        F.max(F.length("frame_digits")).alias("digits"),
        first("sequence_path").alias("sequence_path"),
        first("extension").alias("extension"),
        first(path).alias("only"),
    )
    width = F.greatest("digits", F.length(F.col("first_frame").cast("string")), F.length(F.col("last_frame").cast("string")), F.lit(1))
    numbered = F.concat("sequence_path", F.lit(".["), padded(F.col("first_frame"), width), F.lit("-"), padded(F.col("last_frame"), width), F.lit("]"), "extension")
    label = F.when(F.col("first_frame").isNotNull(), numbered).when(F.col("frames") == 1, F.col("only")).otherwise(F.concat("sequence_path", "extension"))
    return g.select("sequence_key", "frames", "first_frame", "last_frame", label.alias("label"))


def ordered_frames(frames: DataFrame, path: str = "path") -> DataFrame:
    """frames with their place in the sequence, from 0: by number, then by natural order of the path."""
    w = Window.partitionBy("sequence_key").orderBy(F.col("frame_number").asc_nulls_last(), natural_key(F.col(path)), path)
    return frames.withColumn("place", F.row_number().over(w) - 1)


def layer(name: Column) -> Column:
    """What stands before the last dot of a channel's name."""
    return F.when(F.instr(name, ".") > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit("(root)"))


def layers(channels: DataFrame, *keys: str, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Channels by layer, in file order: keys, layer, channels."""
    got = channels.groupBy(*keys, layer(F.col(name)).alias("layer")).agg(F.sort_array(F.collect_list(F.struct(ordinal, name))).alias("c"))
    return got.select(*keys, "layer", F.array_join(F.col(f"c.{name}"), ",").alias("channels"))


# Names of red, green, blue and alpha in order of preference.
GUESSES = {"r": ("R", "r", "Red", "red"), "g": ("G", "g", "Green", "green"), "b": ("B", "b", "Blue", "blue"), "a": ("A", "a", "Alpha", "alpha")}
LAYER_GUESSES = {"r": ("R", "r", "X", "x"), "g": ("G", "g", "Y", "y"), "b": ("B", "b", "Z", "z"), "a": ("A", "a")}


def _best(name: Column, ordinal: Column, rank: Column) -> Column:
    return F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), ordinal.alias("ordinal"), name.alias("name"))))["name"]


def _guess_rank(name: Column, wanted: tuple[str, ...]) -> Column:
    """Preference of a name: the wanted names in order, each exact before as a suffix."""
    rank = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(wanted))):
        rank = F.when(name == w, 2 * i).when(name.endswith(f".{w}") | name.endswith(f".{w.upper()}"), 2 * i + 1).otherwise(rank)
    return rank


def guessed(channels: DataFrame, *keys: str, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """Which channels to show as r, g, b and a; without any of r, g, b the first three channels, or the first for those missing."""
    n, o = F.col(name), F.col(ordinal)
    first = F.sort_array(F.collect_list(F.struct(o, n)))
    g = channels.groupBy(*keys).agg(*(_best(n, o, _guess_rank(n, w)).alias(k) for k, w in GUESSES.items()), first.alias("all"))
    none = F.coalesce("r", "g", "b").isNull()
    nth = lambda i: F.coalesce(F.get("all", F.lit(i))[name], F.get("all", F.lit(0))[name])
    pick = [F.when(none, nth(i)).otherwise(F.coalesce(k, F.lit(""))).alias(k) for i, k in enumerate("rgb")]
    return g.select(*keys, *pick, F.coalesce("a", F.lit("")).alias("a"))


def layer_mapped(channels: DataFrame, *keys: str, name: str = "name", ordinal: str = "ordinal", layer_: str | None = None) -> DataFrame:
    """For each layer (or one of them), its channels to show.

    Without any known name a layer shows as grey the first channel of the image
    whose name starts with the layer's prefix, be it in a layer below; the root
    has no prefix, so it shows the first channel of all.
    """
    n, o = F.col(name), F.col(ordinal)
    tagged = channels.withColumn("layer", layer(n)).withColumn("_s", F.substring_index(n, ".", -1))

    def rank(wanted: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("int")
        for i, w in reversed(list(enumerate(wanted))):
            out = F.when(F.col("_s") == w, i).otherwise(out)
        return out

    g = tagged.groupBy(*keys, "layer").agg(*(_best(n, o, rank(w)).alias(k) for k, w in LAYER_GUESSES.items()))
    if layer_ is not None:
        g = g.filter(F.col("layer") == layer_)
    names = channels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(o.alias("o"), n.alias("n")))).alias("_all"))  # the channels of one image
    g = g.join(names, list(keys)) if keys else g.crossJoin(names)
    prefix = F.when(F.col("layer") == "(root)", F.lit("")).otherwise(F.concat("layer", F.lit(".")))
    first = F.get(F.filter("_all", lambda c: F.startswith(c["n"], prefix)), F.lit(0))["n"]
    none = F.coalesce("r", "g", "b").isNull()
    return g.select(*keys, "layer", *(F.when(none, first).otherwise(F.coalesce(k, F.lit(""))).alias(k) for k in "rgb"), F.coalesce("a", F.lit("")).alias("a"))


def grey(channel: Column) -> list[Column]:
    """One channel shown as red, green and blue, without alpha."""
    return [channel.alias("r"), channel.alias("g"), channel.alias("b"), F.lit("").alias("a")]


def shown(mapping: DataFrame, *keys: str, view: str = "rgb") -> DataFrame:
    """What a view shows of a mapping (r, g, b, a): the colours, or alpha as grey; always opaque."""
    if view == "alpha":
        return mapping.select(*keys, *grey(F.col("a")))
    return mapping.select(*keys, "r", "g", "b", F.lit("").alias("a"))


def ranked_sources(sources_: DataFrame) -> DataFrame:
    """sources with their place in the list: most frames first, then by natural order of the label."""
    w = Window.orderBy(F.desc("frames"), natural_key(F.col("label")), "label", "sequence_key")
    return sources_.withColumn("place", F.row_number().over(w) - 1)  # one row a sequence


def default_source(sources_: DataFrame) -> DataFrame:
    """The source that is opened: the first of ranked_sources."""
    return sources_.orderBy(F.desc("frames"), natural_key(F.col("label")), "label", "sequence_key").limit(1)


def frame_label(current: Column, place: Column, last: Column, n: Column) -> Column:
    """'current / last', padded to the length of last; frames without a number count from 1."""
    total = F.coalesce(last, n).cast("string")
    now = F.coalesce(current, place + 1)
    return F.concat(padded(now, F.greatest(F.length(total), F.lit(1))), F.lit(" / "), total)


def part_label(kind: Column) -> Column:
    """A part's type without its first 'image'."""
    at = F.instr(kind, "image")
    return F.when(at > 0, F.concat(F.substring(kind, F.lit(1), at - 1), F.substring(kind, at + 5, F.length(kind)))).otherwise(kind)
