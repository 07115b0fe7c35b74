"""Benchmark decontamination by a distributed positional index.

1. Index.  Each block of documents (see postings) stores, for each of its terms,
   the sorted positions of the term in the block's run of words.
2. Windows.  An item's windows are its runs of WINDOW words; a shorter item is
   one window.  Windows go to the tasks in slices of a bounded number of
   windows; a longer item is cut over several slices.
3. Phrases.  In each block, a window's terms are put in order from the rarest
   there.  The positions of the rarest, each less its offset in the window, are
   where the window may start; they are intersected with the lists of the other
   terms, again less their offsets, from the rarest on.  What is left after the
   last list are exactly the occurrences.  A window with a term that the block
   doesn't have is gone at once.
4. Proximity (near()).  Instead of fixed offsets, all terms must stand within a
   number of words, in any order: from the rarest term's positions, stretches
   that begin with any of the terms are tested against each list.

All windows of a slice meet a block at once, in array operations, a bounded
number of candidates at a time.  There is no shuffle, but for items of more
than one slice, where each document's hits are put together.

Defined results: null, empty and blank texts have no words, so documents have no
hits and items no windows; a very long document is a block by itself; an item
whose id repeats is one item with all these rows' windows; an item without an id
marks words as hit, but isn't counted or named; repeated documents have a row
each, and so have those without an id; empty items leave all documents clean,
and an empty table gives no rows; no column but id and text is read, so other
names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.llm.common import small_batches, table, written
from scanweave.llm.postings import blocks_of, found, lists, row_of, spread, stored, terms_of

WINDOW = 10
#: Windows of a slice, and of a run of an item's words; candidates held at once.
SLICE, RUN, CANDIDATES = 1 << 16, 1 << 12, 1 << 21

INDEX = "block long, ids array<long>, sizes binary, keys binary, counts binary, positions binary"
_PARTS = {"sizes": "<i8", "keys": "<u8", "counts": "<i4", "positions": "<i4"}
HITS = "block long, slot int, doc_id long, n_words long, spans array<struct<begin:long,end:long>>, items array<long>"


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for no, ids, sizes, hashes in blocks_of(batches):
        order = np.argsort(hashes, kind="stable")
        keys, counts = lists(hashes[order])
        own = (sizes.astype("<i8"), keys.astype("<u8"), counts.astype("<i4"), order.astype("<i4"))
        cols = [pa.array([no]), pa.ListArray.from_arrays([0, len(ids)], ids), *(pa.array([x.tobytes()], pa.binary()) for x in own)]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", *_PARTS])


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all documents, written to the shared folder: INDEX."""
    small_batches(docs.sparkSession)
    return stored(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_indexer, INDEX), "positions")


class Block:
    """The lists of one block."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.keys, self.counts, self.positions = keys, counts.astype(np.int64), positions.astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.span = int(self.first[-1]) + 1
        # term and position in one number: sorted, as lists are
        self.places = np.repeat(np.arange(len(keys)), self.counts) * self.span + self.positions

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Does each term stand at each position?"""
        return found(self.places, term * self.span + at)[1]

    def following(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first position of each term that is not before `at`, or one beyond the block."""
        place = np.searchsorted(self.places, term * self.span + at)
        near = self.places[np.minimum(place, len(self.places) - 1)]
        return np.where((place < len(self.places)) & (near // self.span == term), near % self.span, self.span)

    def ordered(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows whose terms are all here, their terms, the order of their terms from the rarest on; padding comes last)."""
        term, here = found(self.keys, words)
        inside = np.arange(words.shape[1]) < lengths[:, None]
        rows = np.flatnonzero((here | ~inside).all(1) & (lengths > 0))
        n = np.where(inside[rows], self.counts[term[rows]] if len(self.counts) else 0, np.iinfo(np.int64).max)
        return rows, term[rows], np.argsort(n, 1, kind="stable")

    def seeds(self, term: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, position of its rarest term), at most about CANDIDATES at a time."""
        rarest = term[np.arange(len(term)), order[:, 0]]
        n = self.counts[rarest]
        run = np.cumsum(n) // CANDIDATES
        for r in np.unique(run):
            own = np.flatnonzero(run == r)
            yield np.repeat(own, n[own]), self.positions[spread(self.starts[rarest[own]], n[own])]

    def phrases(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, where it starts) of every occurrence in one document."""
        rows, term, order = self.ordered(words, lengths)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for w, at in self.seeds(term, order):
            start = at - order[w, 0]
            w, start = w[start >= 0], start[start >= 0]
            fits = start + lengths[rows[w]] <= self.first[self.doc_of(start) + 1]
            w, start = w[fits], start[fits]
            for r in range(1, words.shape[1]):
                offset = order[w, r]
                keep = offset >= lengths[rows[w]]  # padding
                keep |= self.holds(term[w, offset], start + offset)
                w, start = w[keep], start[keep]
            out.append((rows[w], start))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def stretches(self, words: np.ndarray, lengths: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of stretches of at most `within` words of a document that begin with one of the row's terms and hold them all; they end with the last of these."""
        rows, term, order = self.ordered(words, lengths)
        none = np.zeros(0, np.int64)
        out = [(none, none, none)]
        for w, at in self.seeds(term, order) if len(rows) else ():
            # any term may begin a stretch that holds this place of the rarest
            for back in range(within):
                begin = at - back
                own, b = w[begin >= 0], begin[begin >= 0]
                starts_here, end = np.zeros(len(own), bool), b.copy()
                for j in range(words.shape[1]):
                    real = j < lengths[rows[own]]
                    next_ = self.following(term[own, j], b)
                    starts_here |= real & (next_ == b)
                    end = np.where(real, np.maximum(end, next_), end)
                keep = starts_here & (end < b + within) & (end < self.span - 1)
                own, b, end = own[keep], b[keep], end[keep]
                same = self.doc_of(b) == self.doc_of(end)
                out.append((rows[own[same]], b[same], end[same] + 1))
        row, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
        _, once = np.unique(np.stack([row, begin]), axis=1, return_index=True)
        return row[once], begin[once], end[once]


def runs(items: DataFrame, window: int | None, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, words): runs of each item's words with at most RUN windows each; without a window, the item's distinct terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sizes, hashes in terms_of(batch.column(1).to_pylist()):
                row, n, words = [], [], []
                for i, end in enumerate(np.cumsum(sizes).tolist()):
                    own = hashes[end - sizes[i] : end]
                    own = own if window else np.unique(own)
                    for at in range(0, max(min(1, len(own)), len(own) - window + 1) if window else min(1, len(own)), RUN):
                        some = own[at : at + RUN + window - 1] if window else own
                        row.append(first + i)
                        n.append(max(1, len(some) - window + 1) if window else len(some))
                        words.append(some.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(words, pa.binary())], names=["item_id", "n", "words"])

    small_batches(items.sparkSession)
    named = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return named.mapInArrow(cut, "item_id long, n long, words binary")


def slices(rows: DataFrame, most: int = SLICE) -> Iterator[list]:
    """rows (item_id, n, words), written, as lists whose n add up to about `most`, or of one row; one empty list if there are none."""
    kept = written(rows.withColumn("row", F.monotonically_increasing_id()), "slices")
    total = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-total // most))
    while parts > 1:  # dealt by a hash: more parts until none is much larger than asked
        part = F.pmod(F.xxhash64("row"), F.lit(parts))
        if not kept.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter((F.col("n") > 2 * most) & (F.col("rows") > 1)).head(1):
            break
        parts *= 2
    for p in range(parts):
        some = kept.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p) if parts > 1 else kept
        yield some.select("item_id", "n", "words").collect()


def _windows(rows: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """(distinct windows, their lengths; windows and items that belong together; ids of items) of a slice."""
    names = list(dict.fromkeys(r["item_id"] for r in rows))
    number = {name: i for i, name in enumerate(names)}
    words, lengths, owner = [np.zeros((0, window), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows:
        own = np.frombuffer(r["words"], "<u8")
        padded = np.concatenate([own, np.zeros(max(0, window - len(own)), np.uint64)])
        words.append(np.lib.stride_tricks.sliding_window_view(padded, window))
        lengths.append(np.full(len(words[-1]), min(window, len(own))))
        owner.append(np.full(len(words[-1]), number[r["item_id"]]))
    marked = np.column_stack([np.concatenate(words), np.concatenate(lengths).astype(np.uint64)])
    distinct, which = np.unique(marked, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.reshape(-1), np.concatenate(owner)]), axis=1)
    return np.ascontiguousarray(distinct[:, :-1]), distinct[:, -1].astype(np.int64), pairs[0], pairs[1], names


def _matcher(shared, window: int):
    """Hits of a slice's windows in each block: HITS, a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths, of_window, of_item, names = shared.value
        first_pair = np.searchsorted(of_window, np.arange(len(lengths) + 1))
        for batch in batches:
            for k in range(batch.num_rows):
                own = row_of(batch, k, _PARTS)
                block = Block(**own)
                n_docs = len(own["sizes"])
                w, start = block.phrases(words, lengths)
                end = start + lengths[w]
                # occurrences that meet or overlap are one span
                mark = np.zeros(block.span + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, end, -1)
                hit = np.diff((np.cumsum(mark) > 0).astype(np.int8), prepend=0)
                begins, ends = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                # a span over the end of a document is one of each
                cuts = np.setdiff1d(block.first, np.concatenate([begins, ends]))
                inside = np.searchsorted(begins, cuts, "right") - 1
                cuts = cuts[(inside >= 0) & (cuts < ends[np.maximum(inside, 0)])] if len(begins) else cuts[:0]
                begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
                doc = block.doc_of(begins)
                base = block.first[doc]
                # distinct pairs of document and item
                count = first_pair[w + 1] - first_pair[w]
                pairs = np.unique(np.stack([np.repeat(block.doc_of(start), count), of_item[spread(first_pair[w], count)]]), axis=1)
                by_doc = lambda of: np.searchsorted(of, np.arange(n_docs + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(begins - base), pa.array(ends - base)], ["begin", "end"])
                cols = [
                    pa.array(np.full(n_docs, batch.column("block")[k].as_py())), pa.array(np.arange(n_docs, dtype=np.int32)), batch.column("ids")[k].values, pa.array(own["sizes"]),
                    pa.ListArray.from_arrays(by_doc(doc), spans), pa.ListArray.from_arrays(by_doc(pairs[0]), pa.array([names[i] for i in pairs[1]], pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in ("block", "slot", "doc_id", "n_words", "spans", "items")])

    return run


def matches(positions: DataFrame, items: DataFrame, window: int = WINDOW, most: int = SLICE) -> DataFrame:
    """HITS for every document of the index: the spans of its words that are hit, and the items whose windows occur in it."""
    sc = positions.sparkSession.sparkContext
    each = [positions.mapInArrow(_matcher(sc.broadcast(_windows(rows, window)), window), HITS) for rows in slices(runs(items, window), most)]
    if len(each) == 1:
        return each[0]
    both = reduce(DataFrame.unionByName, each).groupBy("block", "slot").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return both.withColumn("items", F.array_distinct("items")).withColumn("spans", merged(F.col("spans")))


def merged(spans: Column) -> Column:
    """Spans that meet or overlap as one."""
    kind = "array<struct<begin:long,end:long>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["begin"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)


def near(positions: DataFrame, items: DataFrame, within: int, most: int = SLICE) -> DataFrame:
    """(doc_id, item_id, begin, end) of every stretch of at most `within` words of a document that holds all terms of an item, in any order; it begins with one of them and ends with the last that it needs."""
    sc = positions.sparkSession.sparkContext

    def matcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, lengths, names = shared.value
            for batch in batches:
                for k in range(batch.num_rows):
                    block = Block(**row_of(batch, k, _PARTS))
                    row, begin, end = block.stretches(words, lengths, within)
                    doc = block.doc_of(begin)
                    cols = [batch.column("ids")[k].values.take(pa.array(doc)), pa.array([names[i] for i in row], pa.int64()), pa.array(begin - block.first[doc]), pa.array(end - block.first[doc])]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "begin", "end"])

        return run

    # an item of more terms than a stretch has words can't match
    each = []
    for rows in slices(runs(items, None).filter(F.col("n") <= within), most):
        words = np.zeros((len(rows), max((r["n"] for r in rows), default=1)), np.uint64)
        for i, r in enumerate(rows):
            words[i, : r["n"]] = np.frombuffer(r["words"], "<u8")
        shared = sc.broadcast((words, np.array([r["n"] for r in rows], np.int64), [r["item_id"] for r in rows]))
        each.append(positions.mapInArrow(matcher(shared), "doc_id long, item_id long, begin long, end long"))
    return reduce(DataFrame.unionByName, each)


def report(hits: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of HITS."""
    named = F.filter("items", lambda i: i.isNotNull())
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.transform(named, lambda i: i.cast("string"))), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(matches(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")))
