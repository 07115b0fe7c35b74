"""Ranked lexical search over a two-level quantised index.

A document's share of a score for a term is ``saturated``: a whole number below
TOP that grows with the term's occurrences and falls with the document's
length.  A score sums weight x saturated over the terms of an item.

1. Sizes.  One pass counts documents with terms and all their terms.
2. Index.  Each block of documents (see postings) stores for each of its terms
   the documents that hold it, in two levels: a byte for the saturated share,
   rounded up to a multiple of STEP, and the occurrences themselves.
3. Weights.  Every task adds up in how many of its documents the terms of the
   items stand; their sums give the weights.
4. Search.  In each block, an item's bytes, weighted and summed, bound every
   document's score from above and, less a STEP for each term, from below.  The
   k-th greatest lower bound, and the k-th best score that the task has found in
   earlier blocks, must be reached: every document whose upper bound does so is
   rescored from the second level, in whole numbers.  A task keeps k documents
   an item, and the best k of all tasks are the answer.  A document is left
   out only where k others are known to score more, so the result is exact.

Items go to the tasks in slices of a bounded number of terms.  Documents and
items never meet in a join.

Defined results: null, empty and blank texts have no terms, and neither count
as documents nor are found; an item without terms has no rows; a very long
document is a block by itself; of equal scores the smaller doc_id comes first,
one that is null last; repeated documents are documents each; items of one id
are items each; empty tables give no rows; no column but id and text is read,
so other names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave.llm.common import SALTS, small_batches, table
from scanweave.llm.decontam import runs, slices
from scanweave.llm.postings import blocks_of, found, lists, row_of, spread, stored, terms_of

K = 10
#: Terms of a slice of items.
SLICE = 1 << 16
#: Shares of a score are below TOP; a byte stands for multiples of STEP.
TOP = 10**6
STEP = -(-TOP // 255)

INDEX = "block long, ids array<long>, sizes binary, keys binary, counts binary, slots binary, impacts binary, occurrences binary"
_HEADS = {"keys": "<u8", "counts": "<i4"}
_LISTS = {"sizes": "<i8", "slots": "<i4", "impacts": "u1", "occurrences": "<i4"}


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """A term's share of the score of documents of n terms that hold it tf times."""
    m = 100 - 90 + (90 * n * docs) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in batches:
            for _, own, _ in terms_of(batch.column(0).to_pylist(), hashed=False):
                n, terms = n + int((own > 0).sum()), terms + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    small_batches(docs.sparkSession)
    got = docs.select(text).mapInArrow(count, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return got["n"] or 0, got["terms"] or 0


def index(docs: DataFrame, n_docs: int, n_terms: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of all documents, written to the shared folder: INDEX."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, ids, n, hashes in blocks_of(batches):
            owner = np.repeat(np.arange(len(n)), n)
            order = np.argsort(hashes, kind="stable")  # owners stay in order within a term
            h, slot = hashes[order], owner[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (slot[1:] != slot[:-1])]))
            tf = np.diff(first, append=len(h))
            keys, counts = lists(h[first])
            slot = slot[first]
            impact = -(-saturated(tf, n[slot], n_docs, n_terms) // STEP) if len(slot) else tf
            own = (n.astype("<i8"), keys.astype("<u8"), counts.astype("<i4"), slot.astype("<i4"), impact.astype("u1"), tf.astype("<i4"))
            cols = [pa.array([no]), pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([x.tobytes()], pa.binary()) for x in own)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in INDEX.split(", ")])

    small_batches(docs.sparkSession)
    return stored(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(build, INDEX), "impacts")


def _frequencies(shared):
    """(term, n): in how many documents of the task each term of the slice stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value[0]
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own = row_of(batch, k, _HEADS)
                at, here = found(own["keys"], terms)
                total[here] += own["counts"][at[here]]
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["term", "n"])

    return run


class _Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.score, self.unnamed, self.doc = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def need(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        s, u, d = np.concatenate([self.score, score]), np.concatenate([self.unnamed, unnamed]), np.concatenate([self.doc, doc])
        order = np.lexsort((d, u, -s))[: self.k]
        self.score, self.unnamed, self.doc = s[order], u[order], d[order]


def searched(block: dict[str, np.ndarray], ids: np.ndarray, unnamed: np.ndarray, terms: np.ndarray, weights: np.ndarray, items: list[np.ndarray], best: list[_Best], docs: int, all_terms: int) -> None:
    """Bring a block's documents into the best of each item."""
    at, here = found(block["keys"], terms)
    counts = block["counts"].astype(np.int64)
    starts = np.cumsum(counts) - counts
    n_docs = len(block["sizes"])
    for own, kept in zip(items, best, strict=True):
        own = own[here[own] & (weights[own] > 0)]
        if not len(own):
            continue
        n = counts[at[own]]
        place = spread(starts[at[own]], n)
        slot, w = block["slots"][place], np.repeat(weights[own], n)
        # sums of whole numbers below 2**53 are exact as doubles
        upper = np.bincount(slot, w * block["impacts"][place], n_docs).astype(np.int64) * STEP
        need = kept.need()
        if np.count_nonzero(upper) >= kept.k:
            lower = upper - np.bincount(slot, w, n_docs).astype(np.int64) * (STEP - 1)
            need = max(need, int(np.partition(lower, n_docs - kept.k)[n_docs - kept.k]))
        reach = upper >= need
        if not reach.any():
            continue
        own = reach[slot]
        slot, w, tf = slot[own], w[own], block["occurrences"][place[own]].astype(np.int64)
        score = np.zeros(n_docs, np.int64)
        np.add.at(score, slot, w * saturated(tf, block["sizes"][slot], docs, all_terms))
        got = np.flatnonzero(score)
        kept.add(score[got], unnamed[got], ids[got])


def _searcher(shared, docs: int, all_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, weights = shared.value
        best = [_Best(k) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].values
                searched(row_of(batch, r, _HEADS | _LISTS), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), terms, weights, items, best, docs, all_terms)
        no = np.repeat(np.arange(len(items)), [len(b.score) for b in best])
        score, unnamed, doc = (np.concatenate([np.zeros(0, kind), *(getattr(b, c) for b in best)]) for c, kind in (("score", np.int64), ("unnamed", bool), ("doc", np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(no), pa.array(doc, pa.int64(), mask=unnamed), pa.array(score)], names=["no", "doc_id", "score"])

    return run


def search(impacts: DataFrame, items: DataFrame, n_docs: int, n_terms: int, key: str = "item_id", text: str = "text", k: int = K, most: int = SLICE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item."""
    spark = impacts.sparkSession
    out = []
    for rows in slices(runs(items, None, key, text), most):
        owns = [np.frombuffer(r["words"], "<u8") for r in rows]
        terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *owns]))
        places = [np.searchsorted(terms, o) for o in owns]
        shared = spark.sparkContext.broadcast((terms,))
        df = np.zeros(len(terms), np.int64)
        # a row for each term of the slice
        for r in impacts.select("keys", "counts").mapInArrow(_frequencies(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            df[r["term"]] = r["n"]
        weights = np.array([weight(n_docs, int(d)) if d else 0 for d in df], np.int64)
        shared = spark.sparkContext.broadcast((terms, places, weights))
        got = impacts.mapInArrow(_searcher(shared, n_docs, n_terms, k), "no long, doc_id long, score long")
        # every task gives k rows an item: the best of parts of the tasks first, then of all
        ranked = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        best = ranked(ranked(got.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "no", "part"), "no")
        # a row for each item of the slice
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "no long, item_id long")
        out.append(best.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n, terms = sizes(docs)
    return search(index(docs, n, terms), table(spark, sf_dir, "benchmark"), n, terms)
