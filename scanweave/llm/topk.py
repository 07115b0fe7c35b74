"""Exact top-k search by inner product over vectors bucketed by length.

Vectors are sorted by length (Euclidean norm) and cut into buckets of similar
length; queries are packed into blocks.  A query first meets the bucket of the
longest vectors, which gives a score that its k-th best must reach.  A bucket
whose longest vector times the query's length stays below it is never read for
that query.  In the others the score becomes a local threshold of the cosine,
score / (query length x longest vector):

* above COORDINATE, few vectors can pass, and they must agree with the query in
  its largest coordinates: products over these coordinates plus the lengths of
  what is left bound each score, and only the survivors are verified;
* below, vectors are cut by their own length only, which costs nothing.

What is left is verified by exact integer products.  Each bucket gives at most
k rows a query, and the best k of all buckets are the answer.

Blocks and buckets meet in the cells of a grid: a row of it has ROWS blocks, a
column has COLUMNS buckets.  A block goes to each column that has a bucket that
may hold one of its best, once, and a bucket to each row; so neither is sent
once for every partner.  Blocks of a cell are held, buckets stream past them.
Rows never meet rows.  Every query reads all buckets that could hold one of its
best, so the result is exact.

Defined results: a vector that is null or holds a null or non-finite component
takes no part, nor does one without an id; vectors of different dimension don't
meet; among equal scores the smaller id comes first; a row with the query's id
is the query's own; with fewer than k candidates all are given; repeated rows
are candidates each; an empty table gives no rows; no column but id and vector
is read, so other names can't clash.  A scaled component beyond 64 bits counts
as the greatest or least of them, and so does a score; products of large
components are made of whole numbers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import spread_join, table, written

K = 5
SCALE = 256
BUCKET, QUERIES = 2048, 256
#: Blocks of a row and buckets of a column of the grid.
ROWS, COLUMNS = 16, 64
COORDINATE, LEADING = 0.8, 16
#: Bytes of the longest buckets of all dimensions that are broadcast at most.
BROADCAST = 32 << 20
SLACK = 1e-9  # for rounding in bounds; scores themselves are exact
#: Products of lengths below this are exact sums of doubles; below the next, of 64-bit integers.
DOUBLES, LONGS = 2.0**52, 2.0**62

PACKED = "no long, dim int, n int, top double, ids binary, payload binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v, norm) of the vectors that take part; v holds floor(scale * x)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    named = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"))
    sound = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    # beyond 64 bits floor() would give the nearest long, too; the bounds keep that the same everywhere
    most = F.lit(2**63 - 1).cast("long")
    whole = lambda c: F.when(c * scale >= 2.0**63, most).when(c * scale < -(2.0**63), -most - 1).otherwise(F.floor(F.least(F.greatest(c * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return named.filter(sound).select("id", F.transform("x", whole).alias("v")).withColumn("norm", norm)


def _packer(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[int, list, float]]] = {}

        def row(dim: int) -> pa.RecordBatch:
            nonlocal seq
            own = held.pop(dim)
            ids, v = np.array([o[0] for o in own], "<i8"), np.array([o[1] for o in own], "<i8").reshape(len(own), dim)
            # 32 bits where they are enough
            small = not v.size or max(int(v.max()), -int(v.min())) < 1 << 31
            cols = ([part << 32 | seq], [dim], [len(own)], [max(o[2] for o in own)], [ids.tobytes()], [v.astype("<i4" if small else "<i8").tobytes()])
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=["no", "dim", "n", "top", "ids", "payload"])

        for batch in batches:
            for i, v, norm in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                held.setdefault(len(v), []).append((i, v, norm))
                if len(held[len(v)]) == size:
                    yield row(len(v))
        for dim in list(held):
            yield row(dim)

    return run


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors from the longest down in rows of `size`: PACKED."""
    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = vectors.select("id", "v", "norm").repartitionByRange(parts, F.desc("norm"), F.asc("id")).sortWithinPartitions(F.desc("norm"), F.asc("id"))
    return ordered.mapInArrow(_packer(size), PACKED)


def _unpacked(dim: int, n: int, ids: bytes, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, lengths); vectors are doubles where these hold their components exactly."""
    wide = len(payload) > 4 * n * dim
    v = np.frombuffer(payload, "<i8" if wide else "<i4").reshape(n, dim)
    f = v.astype(float)
    return np.frombuffer(ids, "<i8"), v if wide else f, np.sqrt((f * f).sum(1))


def _products(v: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products as 64-bit integers; top is no less than any product of their lengths."""
    if top < DOUBLES:  # sums of doubles that are integers below 2**53 are exact
        return (v.astype(float, copy=False) @ q.astype(float, copy=False).T).astype(np.int64)
    a, b = v.astype(np.int64), q.astype(np.int64)
    if top < LONGS:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64).reshape(len(v), len(q))


def _survivors(v: np.ndarray, norms: np.ndarray, q: np.ndarray, need: float) -> np.ndarray:
    """Rows whose score may reach need, from the coordinates in which q is largest."""
    lead = np.argsort(-np.abs(q), kind="stable")[:LEADING]
    part = v[:, lead]
    rest = np.sqrt(np.maximum(norms * norms - (part * part).sum(1), 0) + 1e-6) * np.sqrt(max((q * q).sum() - (q[lead] ** 2).sum(), 0) + 1e-6)
    return np.flatnonzero(part @ q[lead] + rest >= need - SLACK * max(1.0, abs(need)))


def best(ids: np.ndarray, v: np.ndarray, norms: np.ndarray, qids: np.ndarray, q: np.ndarray, qnorms: np.ndarray, need: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, id, score): the k best of a bucket for each query that reach what it needs."""
    if not len(ids) or not len(qids):
        return
    top = float(norms.max())
    local = np.where(need > 0, need / np.maximum(qnorms * top, 1e-300), -1.0)
    exact = top * float(qnorms.max()) * (1 + SLACK)
    # bounds over a few coordinates are for products that doubles hold
    wide = np.flatnonzero((local <= COORDINATE) | ((local <= 1 + SLACK) & (exact >= DOUBLES)))
    order = np.argsort(-norms, kind="stable")
    ids, v, norms = ids[order], v[order], norms[order]
    cut = np.searchsorted(-norms, -np.where(need > 0, need / np.maximum(qnorms, 1e-300), 0) * (1 - SLACK), "right")
    scores = _products(v[: cut[wide].max()], q[wide], exact) if len(wide) else None
    near = np.flatnonzero((local > COORDINATE) & (local <= 1 + SLACK)) if exact < DOUBLES else []
    for place, i in enumerate([*wide, *near]):
        if place < len(wide):
            rows, got = np.arange(cut[i]), scores[: cut[i], place]
        else:
            rows = _survivors(v, norms, q[i], need[i])
            got = _products(v[rows], q[i : i + 1], exact)[:, 0] if len(rows) else np.zeros(0, np.int64)
        own = (got >= need[i]) & (ids[rows] != qids[i])
        rows, got = rows[own], got[own]
        if len(got) > k:
            least = np.partition(got, len(got) - k)[len(got) - k]
            rows, got = rows[got >= least], got[got >= least]
        for r in np.lexsort((ids[rows], -got.astype(object) if exact >= LONGS else -got))[:k]:
            yield int(qids[i]), int(ids[rows[r]]), int(got[r])


def _needs(k: int):
    """For each block, after the bucket of the longest vectors: the score that each query's k-th best must reach, and the least length that may hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, dim, n, _, ids, payload, b_n, b_ids, b_payload in zip(*(batch.column(c).to_pylist() for c in range(9)), strict=True):
                qids, q, qnorms = _unpacked(dim, n, ids, payload)
                bids, v, norms = _unpacked(dim, b_n, b_ids, b_payload)
                need = np.full(n, -np.inf)
                found: dict[int, list[int]] = {}
                for query, _, score in best(bids, v, norms, qids, q, qnorms, need, k):
                    found.setdefault(query, []).append(score)
                for i, query in enumerate(qids.tolist()):
                    if len(found.get(query, ())) == k:
                        need[i] = found[query][-1]
                shortest = float(np.where(need > 0, need / np.maximum(qnorms, 1e-300), 0).min()) * (1 - SLACK)
                cols = ([no], [dim], [n], [ids], [payload], [need.astype("<f8").tobytes()], [shortest])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "dim", "n", "ids", "payload", "need", "least"])

    return run


def _searched(k: int):
    """The best of each cell, whose rows come sorted: (cell, kind, n, dim, ids, payload, need, bound), blocks (kind 0) before buckets (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, blocks = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                now, kind, n, dim, ids, payload, need, bound = (batch.column(c)[row].as_py() for c in range(8))
                if now != cell:
                    cell, blocks = now, []
                own = _unpacked(dim, n, ids, payload)
                if kind == 0:
                    blocks.append((*own, np.frombuffer(need, "<f8"), bound))
                    continue
                # bound: the least length that a block's best may have, and the bucket's greatest
                got = [x for qids, q, qnorms, needs, least in blocks if bound >= least for x in best(*own, qids, q, qnorms, needs, k)]
                cols = list(zip(*got, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE, bucket: int = BUCKET, block: int = QUERIES, rows: int = ROWS, columns: int = COLUMNS, broadcast: int = BROADCAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for each of those whose id `queries` accepts (a condition on column id)."""
    spark = vectors.sparkSession
    all_ = quantised(vectors, key, vector, scale)
    buckets = written(packed(all_, bucket), "buckets")
    blocks = packed(all_.filter(queries), block)
    # one bucket a dimension, of at most `bucket` vectors: few are broadcast, many are brought to the parts that blocks are dealt into
    longest = buckets.groupBy("dim").agg(F.max_by(F.struct("n", "ids", "payload"), F.struct("top", -F.col("no"))).alias("b"))
    bytes_ = longest.agg(F.coalesce(F.sum(F.length("b.payload") + F.length("b.ids")), F.lit(0)).alias("n")).first()["n"]
    # blocks that are read twice are written first, as numbers of blocks may differ from one run to the next
    first = blocks.join(F.broadcast(longest), "dim") if bytes_ <= broadcast else spread_join(written(blocks, "queries"), longest, "dim", "no")
    seeds = first.select("no", "dim", "n", "top", "ids", "payload", "b.n", "b.ids", "b.payload").toDF("no", "dim", "n", "top", "ids", "payload", "b_n", "b_ids", "b_payload")
    needs = written(seeds.mapInArrow(_needs(k), "block long, dim int, n int, ids binary, payload binary, need binary, least double"), "blocks")

    # places in the grid: heads are a row a block or bucket; neighbours in it have similar lengths
    by_least = F.row_number().over(Window.partitionBy("dim").orderBy("least", "block")) - 1
    row = needs.select("block", "dim", "least").withColumn("row", F.expr("0") + F.floor(by_least / rows)).select("block", "dim", "least", "row")
    by_top = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("top"), "no")) - 1
    column = buckets.select("no", "dim", "top").withColumn("column", F.floor(by_top / columns)).select("no", "dim", "top", "column")
    row_heads = row.groupBy("dim", "row").agg(F.min("least").alias("row_least"))
    column_heads = column.groupBy("dim", "column").agg(F.max("top").alias("column_top"))
    # a row meets the columns from the longest on down to the last that may hold one of its best: columns fall in length, so these are a range
    tops = column_heads.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("column", "column_top"))).alias("tops"))
    cells = row_heads.join(tops, "dim").select("dim", "row", F.explode(F.filter("tops", lambda t: t["column_top"] >= F.col("row_least"))).alias("t")).select("dim", "row", "t.column")
    cells = written(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    sent_blocks = cells.join(row, ["dim", "row"]).select("cell", "block").join(needs, "block").select("cell", F.lit(0).alias("kind"), "n", "dim", "ids", "payload", "need", F.col("least").alias("bound"))
    sent_buckets = cells.join(column, ["dim", "column"]).select("cell", "no").join(buckets, "no").select("cell", F.lit(1).alias("kind"), "n", "dim", "ids", "payload", F.lit(None).cast("binary").alias("need"), F.col("top").alias("bound"))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = sent_blocks.unionByName(sent_buckets).repartition(spread, "cell").sortWithinPartitions("cell", "kind")
    found = met.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
