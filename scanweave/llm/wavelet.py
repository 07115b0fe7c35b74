"""Token ids in compressed shards: one wavelet matrix a shard.

A wavelet matrix keeps a sequence of n ids of b bits as b bit planes of n bits.
Plane 0 holds the top bit of every id in order; each further plane holds the
next bit, with all ids whose bit above was 0 moved in front of those whose bit
was 1.  With counts of ones for each block of a plane (rank), one file answers
what id stands at a place, how often an id occurs up to a place, and where its
k-th occurrence is, without being unpacked.

A shard image (bytes, little-endian) is

    8 bytes   magic "SWWM0002"
    5 x u64   n ids, n documents, documents without an id (they come first),
              bits b, block size of the rank counts
    n docs    i64 document ids (0 for none), then u64 lengths
    b planes  u64 number of zeros, u32 ones before each block, the bits

Shards hold whole documents in ascending document order, at least SHARD_IDS
ids each but for the last of a task.  Images are written through Spark, as rows
(part, shard, image) of Parquet files, so they can lie in any store that Spark
reaches, and a lost task writes its shards again.

Defined results: a null or empty text is its end id alone; a very long text is
one document of one shard, which is then longer than others; repeated rows are
kept, one after the other in any order; documents without an id come first; an
empty table gives no shard; no column but id and text is read, so other names
can't clash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import small_batches, table, written
from scanweave.llm.tokens import encoder, with_end

MAGIC = b"SWWM0002"
SHARD_IDS = 1 << 19
RANK_BLOCK = 512
END = 0


def build(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, bits: int | None = None, without: int = 0) -> bytes:
    """The image of one shard, whose first `without` documents have no id."""
    bits = bits or max(1, int(ids.max(initial=0)).bit_length())
    out = [MAGIC, struct.pack("<5Q", len(ids), len(docs), without, bits, RANK_BLOCK), docs.astype("<i8").tobytes(), lengths.astype("<u8").tobytes()]
    x = ids.astype(np.uint32 if bits > 16 else np.uint16)
    for level in range(bits - 1, -1, -1):
        one = (x >> level & 1).astype(bool)
        zero = ~one
        packed = np.packbits(one, bitorder="little")
        counts = np.zeros(-(-len(one) // RANK_BLOCK) * (RANK_BLOCK // 8), np.uint8)
        counts[: len(packed)] = np.bitwise_count(packed)
        before = np.concatenate([np.zeros(1, np.uint32), np.cumsum(counts.reshape(-1, RANK_BLOCK // 8).sum(1, dtype=np.uint32), dtype=np.uint32)])
        x = np.concatenate([x[zero], x[one]])
        out += [struct.pack("<Q", int(zero.sum())), before.astype("<u4").tobytes(), packed.tobytes()]
    return b"".join(out)


class Shard:
    """Access to one image, which stays compressed."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a shard")
        self.n, n_docs, self.without, self.bits, self.block = struct.unpack_from("<5Q", image, 8)
        at = 48
        self.docs = np.frombuffer(image, "<i8", n_docs, at)
        self.lengths = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.zeros, self.before, self.plane = [], [], []
        n_blocks, n_bytes = -(-self.n // self.block), -(-self.n // 8)
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", image, at)[0])
            self.before.append(np.frombuffer(image, "<u4", n_blocks + 1, at + 8))
            at += 8 + 4 * (n_blocks + 1)
            self.plane.append(np.frombuffer(image, np.uint8, n_bytes, at))
            at += n_bytes

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.plane[level], count=self.n, bitorder="little").view(bool)

    def rank1(self, level: int, at: int) -> int:
        """Ones among the first `at` bits of a plane."""
        block = at // self.block
        start = block * self.block // 8
        bits = np.unpackbits(self.plane[level][start : -(-at // 8)], bitorder="little")[: at - block * self.block]
        return int(self.before[level][block]) + int(bits.sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        before = self.before[level].astype(np.int64)
        if not bit:
            before = np.minimum(np.arange(len(before)) * self.block, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        first = block * self.block
        bits = np.unpackbits(self.plane[level][first // 8 : -(-min(first + self.block, self.n) // 8)], bitorder="little")[: self.n - first]
        return first + int(np.flatnonzero(bits == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(self.bits):
            one = self.plane[level][at // 8] >> (at % 8) & 1
            ones = self.rank1(level, at)
            at = self.zeros[level] + ones if one else at - ones
            value = value << 1 | int(one)
        return value

    def _narrowed(self, value: int, to: int) -> tuple[int, int]:
        """Below the last plane: where the id's occurrences start, and where those among the first `to` ids end."""
        first = 0
        for level in range(self.bits):
            a, b = self.rank1(level, first), self.rank1(level, to)
            if value >> (self.bits - 1 - level) & 1:
                first, to = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, to = first - a, to - b
        return first, to

    def count(self, value: int, to: int | None = None) -> int:
        """Occurrences of an id among the first `to` ids."""
        if value >> self.bits or not self.n:
            return 0
        first, last = self._narrowed(value, self.n if to is None else to)
        return last - first

    def find(self, value: int, k: int = 0) -> int | None:
        """The place of the k-th (from 0) occurrence of an id."""
        if k >= self.count(value):
            return None
        at = self._narrowed(value, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        x = np.zeros(self.n, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one, up = self._bits(level), np.empty(self.n, np.uint32)
            zeros = self.zeros[level]
            up[~one] = x[:zeros]
            up[one] = x[zeros:] | np.uint32(1 << (self.bits - 1 - level))
            x = up
        return x


def encode_shards(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, shard, first_doc, n_ids, image) of all documents, parts and shards in ascending document order."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, enc = TaskContext.get().partitionId(), 0, encoder(file)
        names: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            keys = pa.concat_arrays(names)
            marks = keys.fill_null(0).to_numpy()
            one = build(np.concatenate(held), marks, np.concatenate(lengths), without=keys.null_count)
            cols = ([part], [shard], [keys[0].as_py()], [sum(map(len, held))], [one])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "shard", "first_doc", "n_ids", "image"])

        size = 0
        for batch in batches:
            flat, at = with_end(*enc.encode_column(batch.column(1)), end)
            first = 0
            while first < batch.num_rows:
                # up to the document that fills the shard
                last = min(int(np.searchsorted(at, at[first] + shard_ids - size)), batch.num_rows)
                names.append(batch.column(0).slice(first, last - first))
                held.append(flat[at[first] : at[last]])
                lengths.append(np.diff(at[first : last + 1]))
                size += int(at[last] - at[first])
                first = last
                if size >= shard_ids:
                    yield image()
                    names, held, lengths, size, shard = [], [], [], 0, shard + 1
        if names:
            yield image()

    return ordered.mapInArrow(run, "part int, shard int, first_doc long, n_ids long, image binary")


def places(shards: DataFrame) -> DataFrame:
    """(part, shard, start): ids in all shards before.  Sums are taken by part first, so no task sees more than the parts or one part's shards."""
    heads = shards.select("part", "shard", "n_ids")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    per_part = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)))
    inside = heads.withColumn("own", F.coalesce(F.sum("n_ids").over(earlier.partitionBy("part").orderBy("shard")), F.lit(0)))
    return inside.join(per_part, "part").select("part", "shard", (F.col("base") + F.col("own")).alias("start"))


def decode_shards(shards: DataFrame) -> DataFrame:
    """(part, shard, doc_id, begin, ids) of every document, from the images; begin counts the ids before it in its shard, ids are unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, image in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                one = Shard(image)
                ids, ends = one.ids().astype("<u4", copy=False), np.cumsum(one.lengths)
                begins = ends - one.lengths
                docs = pa.array(one.docs, mask=np.arange(len(one.docs)) < one.without)
                for at in range(0, len(docs), 1000):
                    to = min(at + 1000, len(docs))
                    base = int(begins[at])
                    places = (4 * (np.append(begins[at:to], ends[to - 1]) - base)).astype(np.int32)
                    own = pa.BinaryArray.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(places), pa.py_buffer(ids[base : ends[to - 1]])])
                    cols = [pa.array(np.full(to - at, part), pa.int32()), pa.array(np.full(to - at, shard), pa.int32()), docs.slice(at, to - at), pa.array(begins[at:to]), own]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "shard", "doc_id", "begin", "ids"])

    return shards.select("part", "shard", "image").mapInArrow(run, "part int, shard int, doc_id long, begin long, ids binary")


def op6_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = written(encode_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "shards")
    found = decode_shards(files).select("part", "shard", "doc_id", "begin", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return found.join(places(files), ["part", "shard"]).select("doc_id", (F.col("start") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")
