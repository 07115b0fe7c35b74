"""Near-duplicate groups by SetSketch registers.

1. Sketch.  A text is the set of its distinct shingles of k words.  Register i
   of its sketch is floor(1 - log_b(m_i)), cut to 0..255, where m_i is the least
   of exponentially distributed values, one for each shingle: truncated,
   exponentially spaced minima.  The sketch of a union is the registers'
   maximum, and two sketches agree in a register with a probability close to
   the sets' Jaccard similarity.
2. Copies.  Texts of equal word sequence are one representative from here on.
3. Bands.  Runs of ROWS register values are bucket keys; representatives that
   share a bucket are candidates.  Buckets are never expanded into pairs: each
   links its members to its least one, and the connected parts of these links
   are clusters that hold every pair that shares a bucket.
4. Clusters.  A cluster is solved exactly: one member after another is tested
   against all others, but pairs that are joined already need no test.  The
   test is a likelihood test first: how many registers are equal, larger and
   smaller, with both sizes, must not rule out the similarity; what remains is
   verified on the full shingle sets.  The members outside the largest part
   are tested against all, so no link between parts is lost.
5. Large clusters.  A cluster of more than CLUSTER members is dealt into
   chunks, each with the cluster's HUBS members that share most buckets.
   Chunks are solved by themselves; the hubs join their large parts.  The
   members outside the cluster's largest part after that, its fringe, meet the
   members of other parts that they share a bucket with: first by registers
   alone, bucket by bucket, in pieces of at most about SIDE members a side.
   What the likelihood test leaves is verified on the texts, in groups of one
   chunk and one block of about FRINGE fringe members, and only members that
   it left are sent there.  So every pair that shares a bucket is tested, as
   without chunks.

Pairs of documents are never made; the links found are at most as many as the
members, and connected parts are found by passing the least name on along the
links, with halving of paths.

The banding misses a pair at the very limit of similarity with a probability
of about 1e-7 at 0.85 and 7e-5 at 0.8 (BANDS bands of ROWS registers).

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; a text of fewer than k words is one shingle; a very long text is
sketched and verified as a whole; equal word sequences are copies, whatever
their white space and case (A-Z); rows without an id have their number of
shingles and no component, as there is no name to link (deduplicated() names
rows itself, so there they count like others); repeated rows with one id are
one document (its texts should be equal; otherwise the greatest counts); an
empty table gives no rows; no column but id and text is read, and other columns
go along in one struct, so names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import SALTS, mix64, salts, small_batches, spread_join, table, tidy, written
from scanweave.llm.textstats import Text, chunks

BANDS, ROWS = 48, 8
REGISTERS = BANDS * ROWS
#: Base of the registers, and the value that has register 0: sets of 1 to 10**7 shingles stay within 0..255.
BASE, TOP = 1.1, 8.0
CLUSTER, HUBS = 2048, 8
#: A chunk holds CLUSTER members of about so many shingles on average, or fewer larger ones.
SHINGLES = 1024
#: Fringe members of a block, on average, and those that are tested at once.
FRINGE = 512
#: Members of each side that share a bucket and are compared by registers in one piece, on average.
SIDE = 4096
#: The likelihood test passes pairs whose estimate is this many standard errors below the limit.
ERRORS = 5.0

SKETCH = "doc_id long, n long, words binary, registers binary"

_rng = np.random.Generator(np.random.PCG64(20_261))
_XOR = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingles(text: Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, sorted by text and hash."""
    h = text.word_hashes()
    at, window = text.windows(h, k)
    owner = text.text_of_words()[at]
    short = np.flatnonzero((text.n_words > 0) & (text.n_words < k))
    if len(short):
        one = np.zeros(len(short), np.uint64)
        for i in range(k - 1):
            has = text.n_words[short] > i
            one[has] = mix64(one[has] * np.uint64(0x9E3779B97F4A7C15) + h[text.first_word[short[has]] + i] + np.uint64(i + 1))
        owner, window = np.concatenate([owner, short]), np.concatenate([window, one])
    order = np.lexsort((window, owner))
    owner, window = owner[order], window[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1])
    return owner[new], window[new]


def registers(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The sketch of each of n texts, a row of REGISTERS values each; texts without shingles have zeros."""
    out = np.zeros((n, REGISTERS), np.uint8)
    if not len(owner):
        return out
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    least = np.empty((REGISTERS, len(starts)), np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(REGISTERS):
        least[i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], starts)
    value = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32)
    level = np.floor(1 - (np.log(value) - np.log(TOP)) / np.log(BASE))
    out[owner[starts]] = np.clip(level, 0, 255).astype(np.uint8).T
    return out


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, raws in chunks(texts):
                text = Text(raws, lower=True)
                h = text.word_hashes()
                owner, window = shingles(text, k)
                sketch = registers(owner, window, text.n)
                # two 64-bit digests of the word sequence
                place = np.arange(len(h)) - np.repeat(text.first_word, text.n_words)
                salted = [mix64(h + mix64(place.astype(np.uint64) * np.uint64(2) + np.uint64(s))) for s in (1, 2)]
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(s)]) for s in salted]
                keys = np.stack([s[text.first_word + text.n_words] - s[text.first_word] for s in sums], 1)
                cols = (ids.slice(first, text.n), pa.array(np.bincount(owner, minlength=text.n)), pa.array([keys[i].tobytes() for i in range(text.n)], pa.binary()), pa.array([sketch[i].tobytes() for i in range(text.n)], pa.binary()))
                yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "n", "words", "registers"])

    return run


def sketched(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SKETCH of every document: number of shingles, a digest of its word sequence, and its registers."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(_sketcher(k)), SKETCH)


def _buckets(regs: list[bytes]) -> np.ndarray:
    """The bucket of each sketch in each band."""
    words = np.frombuffer(b"".join(regs), "<u8").reshape(-1, BANDS, ROWS // 8)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), words.shape[:2])
    for i in range(ROWS // 8):
        key = mix64(key ^ mix64(words[:, :, i]))
    return key.view(np.int64)


def _bander(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of every band of the registers in the first column, after the other columns."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            some = batch.slice(at, 2000)
            key = _buckets(some.column(0).to_pylist())
            row = pa.array(np.repeat(np.arange(some.num_rows), BANDS))
            carried = [c.take(row) for c in some.columns[1:]]
            yield pa.RecordBatch.from_arrays([*carried, pa.array(key.reshape(-1))], names=[*batch.schema.names[1:], "bucket"])


def banded(reps: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, carried columns, bucket) of every band of each row."""
    rows = reps.select("registers", "doc_id", *carried)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes[1:])
    return rows.mapInArrow(tidy(_bander), f"{schema}, bucket long")


def _with_least(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b) with m, the least b of their a.  The edges of one a are dealt to parts, and only the parts' least ones meet."""
    salt = F.pmod(F.xxhash64("b", F.lit("salt")), F.lit(salts(edges.sparkSession))).cast("int")
    # one shuffle serves the distinct rows, the parts and the join
    dealt = edges.withColumn("salt", salt).repartition("a", "salt").distinct()
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    parts = parts.withColumn("m", F.min("m").over(Window.partitionBy("a")))
    return dealt.join(parts, ["a", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that it reaches.

    Every round links each node's neighbours to the least of them, first the
    greater ones and then the smaller ones, until nothing changes.  Rows of one
    round are at most as many as the links; those of a hub are dealt to several
    tasks.  Each round is written to the shared folder.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b")
        # the smaller neighbours, and the node itself, go to the least of them
        small = _with_least(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def may_be_similar(a: np.ndarray, na: float, regs: np.ndarray, n: np.ndarray, limit: float) -> np.ndarray:
    """Could each of the sets be as similar to one set as limit?  A likelihood test on registers and sizes.

    Larger, smaller and equal registers are counted.  With sizes known, the
    likelihood of these counts is concave in the similarity, so its maximum
    lies above a value where its slope there is positive.  The value is the
    limit less ERRORS standard errors.
    """
    u, v = na / (na + n), n / (na + n)
    j = max(0.0, limit - ERRORS * np.sqrt(limit * (1 - limit) / REGISTERS))
    j = np.minimum(j, np.minimum(na, n) / np.maximum(na, n) * (1 - 1e-9))
    more, less = (a > regs).sum(1), (a < regs).sum(1)
    c = (BASE - 1) / BASE

    def chance(x):  # of a larger register, with its slope in j up to the factor of x's slope
        y = 1 - c * np.maximum(x, 1e-12)
        return -np.log(y) / np.log(BASE), c / (y * np.log(BASE))

    (p, dp), (q, dq) = chance(u - v * j), chance(v - u * j)
    slope = -more * dp * v / p - less * dq * u / q + (REGISTERS - more - less) * (dp * v + dq * u) / np.maximum(1 - p - q, 1e-12)
    return (slope >= 0) & (np.minimum(na, n) >= (limit - 1e-9) * np.maximum(na, n))


class _Members:
    """Members of one cluster or chunk: ids, shingle sets and registers."""

    def __init__(self, ids: list[int], texts: list[str], regs: list[bytes], k: int):
        self.ids = np.array(ids, np.int64)
        sets: list[np.ndarray] = []
        for _, raws in chunks(texts):
            owner, window = shingles(Text(raws, lower=True), k)
            sets += np.split(window, np.searchsorted(owner, np.arange(1, len(raws))))
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.first = np.cumsum(self.n) - self.n
        self.all = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.regs = np.frombuffer(b"".join(regs), np.uint8).reshape(-1, REGISTERS)

    def set_of(self, i: int) -> np.ndarray:
        return self.all[self.first[i] : self.first[i] + self.n[i]]

    def similar(self, own: np.ndarray, regs: np.ndarray, among: np.ndarray, percent: int) -> np.ndarray:
        """Those of the members `among` that are similar to a set: 100 * intersection >= percent * union."""
        if not len(among) or not len(own):
            return among[:0]
        among = among[may_be_similar(regs, float(len(own)), self.regs[among], self.n[among].astype(float), percent / 100)]
        if not len(among):
            return among
        lengths = self.n[among]
        first = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(first - self.first[among], lengths)
        items = self.all[at]
        spot = np.minimum(np.searchsorted(own, items), len(own) - 1)
        common = np.add.reduceat((own[spot] == items).astype(np.int64), first)
        return among[100 * common >= percent * (len(own) + lengths - common)]


def _parts(m: _Members, percent: int) -> np.ndarray:
    """The part of each member, exactly: parts are the connected components of all similar pairs."""
    n = len(m.ids)
    part = np.arange(n)
    size = np.ones(n, np.int64)
    todo = np.ones(n, bool)
    while True:
        largest = int(np.argmax(size))
        # a pair of different parts has a member outside the largest part, so these are tested against all
        rest = np.flatnonzero(todo & (part != largest)) if size[largest] > 1 else np.flatnonzero(todo)
        if not len(rest):
            return part
        # members whose registers agree with most are likely hubs, but any order is right
        i = int(rest[0])
        todo[i] = False
        others = np.flatnonzero(part != part[i])
        for p in np.unique(part[m.similar(m.set_of(i), m.regs[i], others, percent)]):
            a, b = int(part[i]), int(p)
            if size[a] < size[b]:
                a, b = b, a
            part[part == b] = a
            size[a] += size[b]
            size[b] = 0


def _grouped(columns: int) -> callable:
    """Rows of batches sorted by their first two columns, group by group."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
        key, held = None, [[] for _ in range(columns)]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if key is not None:
                        yield key, held
                    key, held = row[:2], [[] for _ in range(columns)]
                for c, x in zip(held, row[2:], strict=True):
                    c.append(x)
        if key is not None:
            yield key, held

    return groups


def _solver(k: int, percent: int):
    """(a, b) links that join the parts of each chunk: each member and the least of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, texts, regs) in _grouped(3)(batches):
            m = _Members(ids, texts, regs, k)
            part = _parts(m, percent)
            least = np.full(len(part), np.iinfo(np.int64).max)
            np.minimum.at(least, part, m.ids)
            root = least[part]
            own = root != m.ids
            yield pa.RecordBatch.from_arrays([pa.array(m.ids[own]), pa.array(root[own])], names=["a", "b"])

    return run


def _fringe_solver(k: int, percent: int):
    """(a, b) links of a block of fringe members to members of a chunk: for each, one link to each part among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (ids, texts, regs, roots, fringe) in _grouped(5)(batches):
            is_fringe = np.array(fringe, bool)
            own, other = np.flatnonzero(~is_fringe), np.flatnonzero(is_fringe)
            if not len(own) or not len(other):
                continue
            pick = lambda c, at: [c[i] for i in at]
            m = _Members(pick(ids, own), pick(texts, own), pick(regs, own), k)
            root = np.array(pick(roots, own), np.int64)
            for at in range(0, len(other), FRINGE):
                some = other[at : at + FRINGE]
                f = _Members(pick(ids, some), pick(texts, some), pick(regs, some), k)
                found: list[tuple[int, int]] = []
                for i, j in enumerate(some):
                    hits = m.similar(f.set_of(i), f.regs[i], np.flatnonzero(root != roots[j]), percent)
                    _, one = np.unique(root[hits], return_index=True)
                    found += [(int(f.ids[i]), int(m.ids[h])) for h in hits[one]]
                cols = list(zip(*found, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _meeting(percent: int):
    """(doc_id, chunk, block, fringe) of the fringe members and members of other parts that share a bucket and pass the likelihood test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), (ids, n, regs, root, chunk, block, outer, fringe) in _grouped(8)(batches):
            ids, n, root, is_fringe = np.array(ids), np.array(n, float), np.array(root), np.array(fringe, bool)
            chunk, block, outer = np.array(chunk), np.array(block), np.array(outer, bool)
            own, other = np.flatnonzero(~is_fringe), np.flatnonzero(is_fringe)
            keys = _buckets(regs)
            band = int(np.argmax(keys[0] == bucket))
            regs = np.frombuffer(b"".join(regs), np.uint8).reshape(-1, REGISTERS)
            seats: set[tuple[int, int, int, bool]] = set()
            for i in other:
                # a pair of two fringe members is tested once, and every pair in the first bucket that it shares
                at = own[(root[own] != root[i]) & (~outer[own] | (ids[own] > ids[i]))]
                at = at[~(keys[at, :band] == keys[i, :band]).any(1)]
                hits = at[may_be_similar(regs[i], n[i], regs[at], n[at], percent / 100)]
                seats.update((int(ids[i]), int(c), int(block[i]), True) for c in np.unique(chunk[hits]))
                seats.update((int(ids[h]), int(chunk[h]), int(block[i]), False) for h in hits)
            cols = list(zip(*seats, strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "chunk", "block", "fringe"])

    return run


def _meetings(rooted: DataFrame, reps: DataFrame, percent: int, fringe: int, spread: int) -> DataFrame:
    """(cluster, place, doc_id, root, fringe): the groups of one chunk and one block in which the fringe of large clusters is verified.

    rooted has (doc_id, cluster, root, chunk) of every member of a large cluster.
    """
    largest = rooted.groupBy("cluster", "root").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("main"))
    sided = rooted.join(largest, "cluster").withColumn("outer", F.col("root") != F.col("main")).join(reps.select("doc_id", "n", "registers"), "doc_id")
    load = F.greatest(F.count("*") / fringe, F.sum("n") / (fringe * SHINGLES))
    blocks = sided.filter("outer").groupBy("cluster").agg(F.ceil(load).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("n_blocks")).cast("int")
    sided = written(sided.join(blocks, "cluster").withColumn("block", block).select("doc_id", "n", "registers", "cluster", "root", "chunk", "outer", "n_blocks", "block"), "sided")

    # buckets with fringe members and more than one part, each side dealt into pieces; the members' bands are
    # made from their registers once more, as that needs no shuffle of all bands
    held = written(banded(sided, "root", "chunk", "block", "outer"), "held")
    many = held.groupBy("bucket").agg(F.count("*").alias("m"), F.count_if("outer").alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("f > 0 AND lo < hi")
    pieces = [F.ceil(F.col(c) / SIDE).cast("int") for c in ("m", "f")]
    dealt = held.join(many.select("bucket", pieces[0].alias("ms"), pieces[1].alias("fs")), "bucket").withColumn("deal", F.xxhash64("doc_id", F.lit("side")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    inner = dealt.withColumn("fringe", F.lit(False)).withColumn("other", every("fs")).withColumn("piece", F.pmod("deal", "ms") * F.col("fs") + F.col("other"))
    fringed = dealt.filter("outer").withColumn("fringe", F.lit(True)).withColumn("other", every("ms")).withColumn("piece", F.col("other") * F.col("fs") + F.pmod("deal", "fs"))
    pairs = inner.unionByName(fringed).join(sided.select("doc_id", "n", "registers"), "doc_id").select("bucket", "piece", "doc_id", "n", "registers", "root", "chunk", "block", "outer", "fringe")
    pairs = pairs.repartition(spread, "bucket", "piece").sortWithinPartitions("bucket", "piece")
    seats = written(pairs.mapInArrow(tidy(_meeting(percent)), "doc_id long, chunk int, block int, fringe boolean"), "meetings").distinct()
    place = F.col("chunk").cast("long") * F.col("n_blocks") + F.col("block")
    return seats.join(sided.select("doc_id", "cluster", "root", "n_blocks"), "doc_id").select("cluster", place.alias("place"), "doc_id", "root", "fringe")


LINKS = "a long, b long"


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", cluster: int = CLUSTER, fringe: int = FRINGE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, from links of 100 * intersection >= percent * union of k-word shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    all_ = written(sketched(docs, k, key, text), "sketches")
    sketches = all_.filter("doc_id IS NOT NULL")
    firsts = sketches.filter("n > 0").groupBy("words").agg(F.min("doc_id").alias("rep"))
    chosen = sketches.join(firsts.select(F.col("words").alias("_w"), F.col("rep").alias("doc_id")), "doc_id", "left_semi").filter("n > 0")
    reps = written(chosen.groupBy("doc_id").agg(F.max(F.struct("n", "registers")).alias("r")).select("doc_id", "r.n", "r.registers"), "representatives")

    # buckets of two members or more, with their least member
    bands = written(banded(reps), "bands")
    buckets = bands.groupBy("bucket").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    joined = bands.join(buckets, "bucket")
    shared = written(joined.groupBy("doc_id", "first").agg(F.sum("size").alias("weight")), "shared")
    clusters = components(shared.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    clusters = written(clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")), "clusters")

    # chunks: members of large clusters are dealt by hash, with the cluster's hubs in every chunk
    load = F.greatest(F.count("*") / cluster, F.sum("n") / (cluster * SHINGLES))
    sizes = clusters.join(reps.select("doc_id", "n"), "doc_id").groupBy("cluster").agg(F.ceil(load).cast("int").alias("n_chunks"))
    dealt = clusters.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int"))
    weights = shared.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    big = dealt.filter("n_chunks > 1")
    # the first of each part of a cluster, and of these the first of all
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), F.asc("doc_id")))).filter(F.col("rank") <= HUBS)
    weighed = big.join(weights, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(SALTS)))
    hubs = best(best(weighed, "cluster", "part"), "cluster")
    more = hubs.select("doc_id", "cluster", "n_chunks", "chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("other")).filter("other != chunk")
    seats = written(dealt.select("doc_id", "cluster", "chunk", "n_chunks").unionByName(more.select("doc_id", "cluster", F.col("other").cast("int").alias("chunk"), "n_chunks")), "seats")

    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    facts = reps.select("doc_id", "registers")
    members = written(texts.join(clusters.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")).join(facts, "doc_id"), "members")
    seated = seats.join(members, "doc_id")
    placed = seated.select("cluster", "chunk", "doc_id", "text", "registers").repartition(spread, "cluster", "chunk").sortWithinPartitions("cluster", "chunk", "doc_id")
    links = written(placed.mapInArrow(tidy(_solver(k, percent)), LINKS), "links")

    # what is outside the largest part of a large cluster meets the members of other parts that share a bucket
    wide = seats.filter("n_chunks > 1")
    if wide.limit(1).count():
        parts = components(links.join(wide.select(F.col("doc_id").alias("a")).distinct(), "a", "left_semi"))
        rooted = wide.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        rooted = written(rooted.withColumn("home", F.pmod(F.xxhash64("doc_id"), F.col("n_chunks")).cast("int")).filter("home = chunk"), "rooted")
        met = _meetings(rooted.select("doc_id", "cluster", "root", "chunk"), reps, percent, fringe, spread).join(members, "doc_id")
        met = met.select("cluster", "place", "doc_id", "text", "registers", "root", "fringe").repartition(spread, "cluster", "place").sortWithinPartitions("cluster", "place", "doc_id")
        links = links.unionByName(written(met.mapInArrow(tidy(_fringe_solver(k, percent)), LINKS), "fringe"))
        roots = components(links)
    else:  # every cluster was solved in one piece: a link's end is the root
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))

    by_rep = firsts.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("words", F.coalesce("root", "rep").alias("root"))
    own = sketches.groupBy("doc_id").agg(F.max(F.struct("n", "words")).alias("s")).select("doc_id", F.col("s.n").alias("n_shingles"), F.col("s.words").alias("words"))
    found = spread_join(own.filter("n_shingles > 0"), by_rep, "words", "doc_id", "left").select("doc_id", "n_shingles", "root")
    blank = own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root"))
    unnamed = all_.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(blank).select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")).unionByName(unnamed)


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one of least id, rows without an id last.

    Rows get names of their own first, so rows that share an id, or have none,
    are compared like others.
    """
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("row")
    base = written(docs.select(F.monotonically_increasing_id().alias("name"), F.col(text).alias("text"), F.col(key).alias("id"), others), "named", compression="zstd")
    groups = near_duplicates(base, k, percent, key="name")
    grouped = groups.join(base.select(F.col("name").alias("doc_id"), "id"), "doc_id")
    kept = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "doc_id")).alias("best")).select(F.col("best.doc_id").alias("name"))
    return base.join(kept, "name", "left_semi").select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
