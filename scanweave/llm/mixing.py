"""Mixing sources to target weights, in fixed-length blocks of words.

1. The words of each source form one stream (documents in a pseudorandom but
   fixed order), cut into blocks of ``block`` words.
2. The mix is made of output shards of equally many slots.  Each shard draws
   how many of its slots each source gets from a multinomial distribution of
   the targets.  What a source has drawn over its quota in the last shards
   goes to the sources that are short, in a closing shard, so the mix hits its
   targets whatever the draw.
3. The slots of a source are numbered through all shards, so the draws say
   which shard a slot lies in.  Slot number n reads block perm(n mod blocks) in
   round n div blocks, where perm is a keyed pseudorandom permutation of that
   source's blocks and round (a Feistel network with cycle walking), so no list
   of blocks is ever shuffled.  Within its shard a slot has a place, by a
   permutation of the shard's places.
4. Slots and blocks meet in an equi-join by source and block index.  What comes
   out is the mix: rows by shard and place, each with the words of a document
   that it reads.  How much the mix takes of a document, and the documents that
   it reads, are summed up from these rows.

Targets share the size of all sources by weight; a target stops at ``most``
times its source's size, and the rest is shared again by weight.  A block is
drawn at most ``most`` times, so a document is too.

Sources, targets and draws stay tables, whatever the number of sources: draws
go to groups of GROUP sources first, and then to the sources of each group,
which is the same distribution.

Defined results: a null text has no words; a document without words is taken
0 times; the null source is the last one; a very long text lies in many blocks;
repeated rows are documents of their own, and ones that are alike may change
places; an empty table gives no rows; other columns go along in one struct, so
names can't clash.  A source smaller than a block misses its target by less
than a block's words times ``most``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from scanweave.llm.common import BLANK_CLASS, BLANKS, mix64, small_batches, table, tidy, written
from scanweave.llm.textstats import Text

BLOCK = 64
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = 20_261
#: Slots of an output shard; there are at most MAX_SHARDS shards, so larger mixes have larger shards.
SHARD_SLOTS, MAX_SHARDS = 8192, 65_536
#: Ranges into which each source's documents are dealt for running sums.
DEALT = 4096
#: Sources of one group of a draw.
GROUP = 4096


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_CLASS + "+", -1))).cast("long")


def permuted(n: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..size-1, applied to n: a Feistel network over the next even number of bits, walked until it falls below size."""
    if size <= 1:
        return np.zeros_like(n)
    half = ((size - 1).bit_length() + 1) // 2
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x, todo = n.astype(np.uint64), np.ones(len(n), bool)
    while todo.any():
        left, right = x[todo] >> shift, x[todo] & mask
        for round_ in range(6):
            left, right = right, left ^ (mix64(right ^ mix64(np.full(1, (key * 64 + round_) % (1 << 64), np.uint64))) & mask)
        x[todo] = (left << shift) | right
        todo &= x >= np.uint64(size)
    return x.astype(np.int64)


def sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """A row for each source, by code point with null last: no, source, source_size, target, blocks and the quota of slots.

    Sources in the order in which they reach their bound get it, until one's
    share of what is left, by weight, is less; the others get their shares.
    The running sums go over one narrow row a source.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("no", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("no", F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("w", F.when(F.col("source_size") > 0, weight).otherwise(0.0)).withColumn("bound", most * F.col("source_size").cast("double"))
    first = Window.orderBy(F.when(F.col("w") > 0, F.col("bound") / F.col("w")).otherwise(-1.0), "no")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = each.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    sums = sums.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    share = F.col("left") * F.col("w") / F.col("w_left")
    # the first source that stays below its bound fixes the share of a unit of weight for itself and all after it
    sums = sums.withColumn("unit", F.when((F.col("w") > 0) & (share < F.col("bound")), F.col("left") / F.col("w_left")))
    sums = sums.withColumn("unit", F.first("unit", ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, 0)))
    out = sums.withColumn("target", F.when(F.col("w") == 0, 0.0).otherwise(F.least("bound", F.coalesce(F.col("unit") * F.col("w"), F.col("bound")))))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    quota = F.least((most * F.col("blocks")).cast("long"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
    return out.select("no", "source", "source_size", "target", "blocks", F.when(F.col("blocks") > 0, quota).otherwise(F.lit(0).cast("long")).alias("quota"))


def shards(known: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(shard, no, blocks, first, slots, at, size): the slots of each source in each output shard; first is the number of the source's slots in shards before, at that of the shard's slots of sources before, size that of all its slots."""
    spark = known.sparkSession
    entries = F.sort_array(F.collect_list(F.struct("no", "quota", "blocks")))
    groups = known.filter("quota > 0").groupBy(F.expr(f"no div {group}").alias("g")).agg(entries.alias("own"), F.sum("quota").alias("n"))
    groups = written(groups, "groups")
    sums = groups.select("g", "n").orderBy("g").toPandas()  # a row for each GROUP sources
    total = int(sums["n"].sum())
    per = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    n = -(-total // per) if total else 0
    gs, share = sums["g"].to_numpy(np.int64), sums["n"].to_numpy(float) / max(1, total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(min(per, total - int(shard) * per), share)
                own = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": int(shard), "g": gs[own], "slots": drawn[own]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, g, slots, own in batch[["shard", "g", "slots", "own"]].itertuples(index=False):
                no, quota, blocks = (np.array([x[k] for x in own]) for k in ("no", "quota", "blocks"))
                drawn = np.random.default_rng([seed, int(shard), int(g), 1]).multinomial(slots, quota / quota.sum())
                hit = np.flatnonzero(drawn)
                yield pd.DataFrame({"shard": shard, "no": no[hit], "quota": quota[hit], "blocks": blocks[hit], "slots": drawn[hit]})

    drawn = spark.range(0, n, 1, max(1, min(n, 512))).mapInPandas(draw, "shard long, g long, slots long")
    dealt = drawn.join(groups.select("g", "own"), "g").select("shard", "g", "slots", "own").mapInPandas(deal, "shard long, no long, quota long, blocks long, slots long")
    by = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = written(dealt, "dealt")
    kept = dealt.withColumn("first", F.coalesce(F.sum("slots").over(by), F.lit(0)))
    kept = kept.withColumn("slots", F.least("slots", F.col("quota") - F.col("first"))).filter("slots > 0").select("shard", "no", "blocks", "first", "slots")
    got = dealt.groupBy("no").agg(F.sum("slots").alias("got"))
    short = known.join(got, "no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("quota > got")
    closing = short.select(F.lit(n).cast("long").alias("shard"), "no", "blocks", F.col("got").alias("first"), (F.col("quota") - F.col("got")).alias("slots"))
    # a shard has at most as many sources as slots, and the closing one a row a source
    own = Window.partitionBy("shard")
    before = own.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return kept.unionByName(closing).withColumn("at", F.coalesce(F.sum("slots").over(before), F.lit(0).cast("long"))).withColumn("size", F.sum("slots").over(own))


def slots(known: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(shard, place, no, slot, round, block): the block that each slot of each shard reads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, no, blocks, first, count, before, size in batch[["shard", "no", "blocks", "first", "slots", "at", "size"]].itertuples(index=False):
                for at in range(first, first + count, 65_536):
                    slot = np.arange(at, min(first + count, at + 65_536))
                    round_, n = np.divmod(slot, blocks)
                    block = np.empty(len(slot), np.int64)
                    for r in np.unique(round_):
                        block[round_ == r] = permuted(n[round_ == r], int(blocks), ((seed * 1_000_003 + int(no)) * 64 + int(r)))
                    place = permuted(slot - first + before, int(size), -(seed * 1_000_003 + int(shard)) - 1)
                    yield pd.DataFrame({"shard": shard, "place": place, "no": no, "slot": slot, "round": round_, "block": block})

    spread = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards(known, seed, group).repartition(spread, "shard", "no").mapInPandas(read, "shard long, place long, no long, slot long, round int, block long")


def streams(sized: DataFrame, known: DataFrame) -> DataFrame:
    """sized with no, source_size, target and begin: the number of its source's words before a document.

    Documents of a source stand in DEALT ranges by a hash, so the running sums
    of a source that holds most rows are spread over as many tasks.
    """
    facts = known.select("no", F.col("source").alias("known"), "source_size", "target")
    dealt = sized.join(facts, F.col("source").eqNullSafe(F.col("known"))).drop("known").withColumn("range", F.pmod(F.xxhash64("doc_id", "tie", F.lit(SEED)), F.lit(DEALT)))
    before = lambda *by: Window.partitionBy("no", *by).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("no", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.select("no", "range", F.coalesce(F.sum("n").over(before().orderBy("range")), F.lit(0)).alias("base"))
    inside = dealt.withColumn("begin", F.coalesce(F.sum("size").over(before("range").orderBy("doc_id", "size", "tie", "row_id")), F.lit(0)))
    return inside.join(ranges.hint("merge"), ["no", "range"]).withColumn("begin", F.col("begin") + F.col("base")).drop("base", "range", "tie")


def placed(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(streams of the documents, the sources' table)."""
    known = written(sources(sized, weights, most, block), "sources")
    return streams(sized, known), known


def mix(streamed: DataFrame, known: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix: (shard, place, part, no, round, block, row_id, from, words), a row for each document that a slot's block reads, part by part; written by shard."""
    parts = streamed.filter("size > 0").select("row_id", "no", "begin", "size", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"))
    first = F.greatest(F.col("begin"), F.col("block") * block)
    parts = parts.select("row_id", "no", "block", (first - F.col("block") * block).cast("int").alias("part"), (first - F.col("begin")).alias("from"), (F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - first).alias("words"))
    # either side grows with the words, so neither is broadcast
    rows = parts.join(slots(known, seed).hint("merge"), ["no", "block"])
    return written(rows.select("shard", "place", "part", "no", "round", "block", "row_id", "from", "words"), "mix")


def drawn(mixture: DataFrame) -> DataFrame:
    """(row_id, draws): what the mix reads of each document, as parts (from, words, times)."""
    times = mixture.groupBy("row_id", "from", "words").agg(F.count("*").cast("int").alias("times"))
    return times.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("from", "words", "times"))).alias("draws"))


def drawn_from(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Rows (row_id, doc_id, source, size, tie) with size, source_size, target, begin, and draws, from the rows of the mix."""
    streamed, known = placed(sized, weights, most, block)
    draws = drawn(mix(streamed, known, block, seed))
    return streamed.join(draws.hint("merge"), "row_id", "left").select("row_id", "doc_id", "size", "source_size", "target", "no", "begin", "draws")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> list[Column]:
    t = F.col(text)
    return [F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(t).alias("size"), F.xxhash64(t).alias("tie")]


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """drawn_from for every document."""
    # the texts are read once; a row's id is written with it, so it stays what it is
    sized = written(docs.select(*_sized(docs, key, text, source)).withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    return drawn_from(sized, **options)


def taken() -> Column:
    return F.coalesce(F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"] * d["times"]), F.lit(0).cast("long"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, cut) for rows (row, text, draws): a row for each round, with the words that it reads and the white space after them; a text read whole stays as it is."""
    for batch in batches:
        raws = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        t = Text(raws)
        starts = t.starts - np.repeat(t.begins, t.n_words)
        index, cuts = [], []
        for i, draws in enumerate(batch.column(2).to_pylist()):
            own = starts[t.first_word[i] : t.first_word[i] + t.n_words[i]].tolist() + [len(raws[i])]
            for round_ in range(1, max(d["times"] for d in draws) + 1):
                read = [(d["from"], d["from"] + d["words"]) for d in draws if d["times"] >= round_]
                whole = sum(e - b for b, e in read) == len(own) - 1
                cuts.append(raws[i] if whole else b"".join(raws[i][own[b] : own[e]] for b, e in read))
                index.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), pa.array(cuts, pa.binary()).cast(pa.string())], names=["row", "cut"])


def mixed_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as rows with the columns of docs: a row for each round that reads some of a document, its text cut to what is read.

    A document read whole once stays as it is; one read whole twice is there
    twice; one that is not read at all is gone.
    """
    small_batches(docs.sparkSession)
    # each row is one struct here, so that its columns can't clash with ours
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    base = written(docs.select(kept, F.col(text).alias("text"), *_sized(docs, "doc_id", text, "source")).withColumn("row_id", F.monotonically_increasing_id()), "documents", compression="zstd")
    got = drawn_from(base.select("row_id", "doc_id", "source", "size", "tie"), **options).filter("draws IS NOT NULL").select("row_id", "draws")
    both = base.select("row_id", "row", "text").join(got.hint("merge"), "row_id").select("row", "text", "draws")
    cut = both.mapInArrow(tidy(_cut), StructType([StructField("row", base.schema["row"].dataType), StructField("cut", StringType())]))
    new = {text: F.col("cut"), "n_chars": F.length("cut").cast("long")}
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", taken().alias("taken"))
