"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

A document longer than a sequence is cut into whole sequences and a rest.
Pieces are then placed longest first, each into the open sequence with the
least room that still holds it; a segment tree over remaining capacities finds
that room in logarithmic time.

A piece's length is all that matters for its place, and there are at most
``length`` lengths.  So the plan is made from the counts of each length: runs
of equal pieces go into runs of equally filled sequences at once, which gives
the very bins that placing them one by one gives.  What the driver sees is one
count a length, whatever the size of the corpus, and the plan is a table of
runs, whose number also depends on the sequence length alone.  Each piece then
finds its run by its rank among the pieces of its length.

Defined results: a null text is empty; an empty document is its end id alone; a
very long text is many pieces; which of equally long pieces comes first is
open, as their places are alike; repeated rows, and rows without an id, are
packed once each; an empty table packs nothing; no column but id and text is
read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import small_batches, table, tidy, written
from scanweave.llm.tokens import encoder, with_end

LENGTH = 2048
END = 0

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, seq long"
PLAN = "length int, first long, last long, bin long, offset int"


def tokenised(docs: DataFrame, file: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: PIECES, where ids are little-endian unsigned 32-bit and seq numbers the pieces of one length in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, enc = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), encoder(file)
        for batch in batches:
            flat, at = with_end(*enc.encode_column(batch.column(1)), end)
            n = np.diff(at)
            pieces = -(-n // length)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(length, n[doc] - piece * length)
            # pieces of equal length are numbered on from those of earlier batches
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=length + 1)
            seq = np.empty(len(size), np.int64)
            seq[order] = np.arange(len(size)) - (np.cumsum(counts) - counts - seen)[size[order]]
            seen += counts
            ends = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u4"))])
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(piece * length), pa.array(size, pa.int32()), ids, pa.array(np.full(len(size), part), pa.int32()), pa.array(seq)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids", "part", "seq"])
        enc.forget()

    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), PIECES)


class RoomTree:
    """Segment tree over rooms 0..size: which rooms have open sequences, and the least such room from a given one on."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, room: int, count: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += count
            node >>= 1

    def tightest(self, room: int) -> int | None:
        """The least room of at least so much that some open sequence has."""
        node = self.leaves + room
        if self.open[node]:
            return room
        while node > 1:  # up until a right neighbour holds something, then down its left edge
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, last, bin, offset): piece first+k of that length goes into sequence bin+k at offset."""
    rooms, tree, runs, bins = [[] for _ in range(length + 1)], RoomTree(length), [], 0
    for size in sorted(counts, reverse=True):
        at, left = 0, counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:  # no open sequence has room: open as many as these pieces fill, several to each
                each = length // size
                full, rest = divmod(left, each)
                for k in range(each):
                    n = full + (k < rest)
                    if n:
                        runs.append((size, at, at + n - 1, bins, k * size))
                        at += n
                for first, n, used in ((bins, full, each), (bins + full, 1 if rest else 0, rest)):
                    if n and used * size < length:
                        rooms[length - used * size].append((first, n))
                        tree.add(length - used * size, n)
                bins += full + (1 if rest else 0)
                left = 0
                continue
            first, n = rooms[room].pop()
            take = min(n, left)
            if take < n:
                rooms[room].append((first + take, n - take))
            tree.add(room, -take)
            runs.append((size, at, at + take - 1, first, length - room))
            if room > size:
                rooms[room - size].append((first, take))
                tree.add(room - size, take)
            at, left = at + take, left - take
    return runs


def placed(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """pieces (with length, part, seq) with sequence_id and offset; the other columns stay."""
    spark = pieces.sparkSession
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    runs = plan(counts, length)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("seq"))

    # the runs of one length, by first rank; the table's size depends on the sequence length only
    order: dict[int, list] = {}
    for size, first, _, at, offset in sorted(runs):
        order.setdefault(size, []).append((first, at, offset))
    table_ = spark.sparkContext.broadcast({k: np.array(v, np.int64).T.copy() for k, v in order.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        size, rank = lengths.to_numpy(), ranks.to_numpy()
        ids, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size):
            own = size == n
            first, at, offset = table_.value[int(n)]
            k = np.searchsorted(first, rank[own], "right") - 1
            ids[own], offsets[own] = at[k] + rank[own] - first[k], offset[k]
        return pd.DataFrame({"sequence_id": ids, "offset": offsets})

    kept = [c for c in pieces.columns if c not in ("part", "seq")]
    return ranked.withColumn("_at", place("length", "rank")).select(*kept, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, file: str, length: int = LENGTH, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return placed(written(tokenised(docs, file, length, end, key, text), "pieces", compression="zstd"), length)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = written(tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces", compression="zstd")
    # the digest is taken before the join, so that the ids themselves are not shuffled
    digests = pieces.select("doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"), "part", "seq")
    return placed(digests).withColumn("length", F.col("length").cast("long"))
