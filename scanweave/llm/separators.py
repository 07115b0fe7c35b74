"""Token counts of documents in flat token files, by a scan for separators.

A flat file is nothing but ids in a row, each document ended by one id that
stands nowhere else; there is no index.  The file is read as blocks of fixed
size that know nothing of documents.  Each block is searched for end ids in one
vectorised comparison.  A document that ends in a block but starts in an
earlier one lacks what lies before; a prefix scan over the blocks' heads (how
many ends they hold, and where the last one is) gives each block the number of
documents and the place of the last end before it, and so stitches documents
that cross one block or thousands.

Prefix scans run in two steps (groups of GROUP blocks, then inside a group), so
a file of any length needs no single task for all its blocks.

Defined results: ids after the last end of a file are an unended document,
given with ended = false; two ends in a row are a document of one id, which is
what a null or empty text is; a very long text spans many blocks; an empty file
or table has no documents; repeated rows are documents of their own; blocks
need not hold equally many ids; no column but id and text is read, so other
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import small_batches, table, written
from scanweave.llm.tokens import encoder, with_end
from scanweave.sources.scan import Ranges

BLOCK_IDS = 1 << 18
GROUP = 1024
#: Blocks that one task reads one after the other.
RUN = 64

BLOCKS = "file int, block long, ids binary"


def end_of(file: str) -> tuple[int, str]:
    """(end id, type of ids) of flat files of a tokenizer: 16 bits with 2**16-1 where that is no id of its vocabulary, otherwise 32 bits."""
    short = encoder(file).tokenizer.get_vocab_size() < 1 << 16
    return (0xFFFF, "<u2") if short else (0xFFFF_FFFF, "<u4")


def read_flat(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks (file, block, ids) of flat token files at path, of any size; file is its path.

    Spark lists the files; runs of RUN blocks are dealt to tasks, each of which
    reads its runs by offset, so no byte is read twice and no task holds more
    than a block.
    """
    size = width * block_ids
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.col("path").alias("file"), "length")
    runs = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size * RUN}"))).alias("run"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with Ranges(file, length) as source:
                    for block in range(run * RUN, min((run + 1) * RUN, -(-length // size))):
                        ids = source.read(block * size, min(size, length - block * size))
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([bytes(ids)], pa.binary())], names=["file", "block", "ids"])

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartition(spread, "file", "run").mapInArrow(read, "file string, block long, ids binary")


def flat_files(docs: DataFrame, file: str, block_ids: int = BLOCK_IDS, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Tokenise into flat files, one for each task: (the blocks of ids as BLOCKS, the order of documents in each file)."""
    end, dtype = end_of(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, rest, block, place = TaskContext.get().partitionId(), encoder(file), b"", 0, 0
        width = np.dtype(dtype).itemsize * block_ids

        def rows(blocks: list[bytes], docs: pa.Array) -> pa.RecordBatch:
            b, d = len(blocks), len(docs)
            cols = [
                pa.array(np.full(b + d, part), pa.int32()),
                pa.array([*range(block, block + b), *[None] * d], pa.int64()),
                pa.array([*blocks, *[None] * d], pa.binary()),
                pa.array([*[None] * b, *range(place, place + d)], pa.int64()),
                pa.concat_arrays([pa.nulls(b, pa.int64()), docs]),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["file", "block", "ids", "doc_no", "doc_id"])

        for batch in batches:
            flat, _ = with_end(*enc.encode_column(batch.column(1)), end)
            rest += flat.astype(dtype).tobytes()
            n = len(rest) // width
            yield rows([rest[i * width : (i + 1) * width] for i in range(n)], batch.column(0))
            rest, block, place = rest[n * width :], block + n, place + batch.num_rows
        if rest:
            yield rows([rest], pa.nulls(0, pa.int64()))

    small_batches(docs.sparkSession)
    both = written(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "file int, block long, ids binary, doc_no long, doc_id long"), "flat", compression="zstd")
    return both.filter("block IS NOT NULL").select("file", "block", "ids"), both.filter("doc_no IS NOT NULL").select("file", "doc_no", "doc_id")


def _scanned(blocks: DataFrame, end: int, dtype: str) -> DataFrame:
    """(file, block, n, ends): number of ids and the places of the end ids in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, b, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ids = np.frombuffer(raw, dtype)
                ends = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays([pa.array([f], batch.schema.field(0).type), pa.array([b], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "n", "ends"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", "block", "ids").mapInArrow(run, f"file {kind}, block long, n long, ends array<long>")


def token_counts(blocks: DataFrame, end: int, dtype: str = "<u2", group: int = GROUP) -> DataFrame:
    """(file, doc_no, start, n_tokens, ended) of every document in flat files given as blocks; n_tokens has the end id."""
    seen = written(_scanned(blocks, end, dtype), "ends")
    heads = seen.select("file", "block", F.expr(f"block div {group}").alias("g"), "n", F.size("ends").cast("long").alias("k"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = heads.groupBy("file", "g").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    w = before("file").orderBy("g")
    groups = groups.select("file", "g", F.coalesce(F.sum("n").over(w), zero).alias("g_n"), F.coalesce(F.sum("k").over(w), zero).alias("g_k"))
    w = before("file", "g").orderBy("block")
    base = heads.join(groups, ["file", "g"])
    base = base.withColumn("base", F.col("g_n") + F.coalesce(F.sum("n").over(w), zero)).withColumn("docs", F.col("g_k") + F.coalesce(F.sum("k").over(w), zero))
    # where the last end before each block is: running maxima of places grow with the blocks, so they scan as sums do
    base = base.withColumn("last_at", F.col("base") + F.col("last"))
    tops = base.groupBy("file", "g").agg(F.max("last_at").alias("top"))
    tops = tops.select("file", "g", F.max("top").over(before("file").orderBy("g")).alias("g_last"))
    base = base.join(tops, ["file", "g"]).withColumn("open_from", F.coalesce(F.max("last_at").over(w), F.col("g_last"), F.lit(-1)) + 1)
    spots = seen.join(base.select("file", "block", "base", "docs", "open_from"), ["file", "block"])
    ends = spots.select("file", "base", "docs", "open_from", "ends", F.posexplode("ends").alias("i", "at"))
    start = F.when(F.col("i") == 0, F.col("open_from")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    whole = ends.select("file", (F.col("docs") + F.col("i")).alias("doc_no"), start.alias("start"), (F.col("base") + F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    total = base.groupBy("file").agg(F.max(F.col("base") + F.col("n")).alias("total"), F.sum("k").alias("doc_no"), (F.coalesce(F.max("last_at"), F.lit(-1)) + 1).alias("start"))
    rest = total.filter("total > start").select("file", "doc_no", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = public_tokenizers.path("byte_bpe_50k.json")
    blocks, order = flat_files(table(spark, sf_dir, "documents"), file)
    return order.join(token_counts(blocks, *end_of(file)), ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
