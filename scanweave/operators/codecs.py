"""Steps of the image codecs as relational operators: rows in, rows out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UP_TO_HERE = (Window.unboundedPreceding, 0)


def running_sum(df: DataFrame, value: str, order: list[str], by: list[str], modulus: int, out: str) -> DataFrame:
    """Differences to values: the sum so far, modulo a power of two."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*UP_TO_HERE)
    return df.withColumn(out, F.pmod(F.sum(value).over(w), F.lit(modulus)))


def predicted(df: DataFrame, value: str, order: list[str], by: list[str], out: str) -> DataFrame:
    """Undo the byte predictor: every byte but the first is a difference, stored with 128 added."""
    w = Window.partitionBy(*by).orderBy(*order)
    place = F.row_number().over(w) - 1
    total = F.sum(value).over(w.rowsBetween(*UP_TO_HERE))
    return df.withColumn(out, F.pmod(total - 128 * place, F.lit(256)).cast("int"))


def deinterleaved(place: Column, n: Column) -> Column:
    """Where a byte goes whose block holds the even places first and then the odd ones."""
    half = F.ceil(n / 2)
    return F.when(place < half, 2 * place).otherwise(2 * (place - half) + 1).cast("int")


def runs(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """Runs of equal neighbours (gaps and islands): by, run, value, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0))
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(*UP_TO_HERE)))
    return marked.groupBy(*by, "run").agg(F.min(value).alias(value), F.count("*").alias("n"))


def expanded(runs_: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Runs to rows again: by, place, value."""
    w = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs_.withColumn("_first", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return placed.select(*by, value, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)).alias("place"))


def lookup(present: DataFrame, value: str) -> DataFrame:
    """Dense numbers of the values in use, 0 always among them: index, value."""
    zero = present.sparkSession.range(1).select(F.lit(0).cast(present.schema[value].dataType).alias(value))
    used = present.select(value).union(zero).distinct()
    # values are of 16 bits, so there are 65536 at most
    return used.select((F.row_number().over(Window.orderBy(value)) - 1).alias("index"), value)


def canonical_codes(lengths: DataFrame, symbol: str, length: str, longest: int = 58) -> DataFrame:
    """Canonical Huffman codes from code lengths: symbol, length, code.

    The first code of a length is half of what the longer lengths use up; codes
    then count upwards with the symbols.  With c(l) = (c(l+1) + n(l+1)) >> 1,
    halving rounds down at every step, so the fold over lengths is kept as one.
    """
    per_length = lengths.filter(F.col(length) > 0).groupBy(length).agg(F.count("*").alias("n"))
    counts = per_length.agg(F.map_from_entries(F.collect_list(F.struct(F.col(length).cast("int"), F.col("n")))).alias("counts"))  # at most `longest` entries
    step = lambda acc, l: F.struct(F.shiftright(acc["c"] + F.coalesce(F.element_at("counts", l), F.lit(0)), 1).alias("c"), F.concat(acc["out"], F.array(F.struct(l.alias("l"), acc["c"].alias("c")))).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.expr("cast(array() as array<struct<l:int,c:bigint>>)").alias("out"))
    firsts = counts.select(F.inline(F.aggregate(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), start, step, lambda a: a["out"])))
    rank = F.row_number().over(Window.partitionBy(length).orderBy(symbol)) - 1
    coded = lengths.filter(F.col(length) > 0).withColumn("_k", rank).join(F.broadcast(firsts), F.col(length) == F.col("l"))
    return coded.select(symbol, length, (F.col("c") + F.col("_k")).alias("code"))


def zigzag() -> list[int]:
    """Place in the block (row-major, 8 x 8) of each coefficient in diagonal order."""
    return [y * 8 + x for s in range(15) for y, x in (sorted(((i, s - i) for i in range(8) if 0 <= s - i < 8), reverse=s % 2 == 0))]


def unzigzagged(values: Column) -> Column:
    """An array of coefficients in diagonal order as a row-major block."""
    back = {place: i for i, place in enumerate(zigzag())}
    order = F.array(*(F.lit(back[p]) for p in range(64)))
    return F.transform(order, lambda i: F.get(values, i))


def idct(block: Column) -> Column:
    """Inverse cosine transform of an 8 x 8 block given as a row-major array: rows first, then columns.  A block stays in its row, so nothing is shuffled."""
    basis = F.array(*(F.lit((math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * i + 1) * u * math.pi / 16)) for u in range(8) for i in range(8)))
    eight, all_ = F.sequence(F.lit(0), F.lit(7)), F.sequence(F.lit(0), F.lit(63))

    def half(values: Column, at) -> Column:
        """Sums over u of what stands at at(place, u) times the basis."""
        return F.transform(all_, lambda p: F.aggregate(eight, F.lit(0.0), lambda acc, u: acc + F.get(values, at(p, u)[0]).cast("double") * F.get(basis, at(p, u)[1])))

    row, col = lambda p: F.floor(p / 8).cast("int"), lambda p: F.pmod(p, F.lit(8))
    rows = half(block, lambda p, u: (row(p) * 8 + u, u * 8 + col(p)))
    # the rows are a variable of one lambda, so that they are made once a block
    return F.get(F.transform(F.array(rows), lambda r: half(r, lambda p, u: (u * 8 + col(p), u * 8 + row(p)))), F.lit(0))


#: Rules of the lossy transform codec for files that carry none (suffix, scheme, colour index; -1: none).
LEGACY_RULES = (
    ("r", "lossy", 0),
    ("red", "lossy", 0),
    ("g", "lossy", 1),
    ("grn", "lossy", 1),
    ("green", "lossy", 1),
    ("b", "lossy", 2),
    ("blu", "lossy", 2),
    ("blue", "lossy", 2),
    ("y", "lossy", -1),
    ("by", "lossy", -1),
    ("ry", "lossy", -1),
    ("a", "rle", -1),
)


def rule_matched(channels: DataFrame, name: str, *keys: str) -> DataFrame:
    """The first rule whose suffix is what follows the last dot of a channel's name, case aside; channels without one are of unknown scheme."""
    rules = F.broadcast(channels.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(LEGACY_RULES)], "rule int, suffix string, scheme string, csc int"))  # a fixed table
    hit = channels.withColumn("_suffix", F.lower(F.substring_index(name, ".", -1))).join(rules, F.col("_suffix") == F.col("suffix"), "left")
    first = F.row_number().over(Window.partitionBy(*keys, name).orderBy(F.col("rule").asc_nulls_last()))
    return hit.withColumn("_first", first).filter("_first = 1").select(*keys, name, F.coalesce("scheme", F.lit("unknown")).alias("scheme"), F.coalesce("csc", F.lit(-1)).alias("csc"))
