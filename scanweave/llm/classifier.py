"""A quality classifier: a generalised additive model with pairwise interactions.

Texts are described by a few shares and counts (FEATURES).  Each feature is cut
into quantile bins, and the model is one lookup table of logits a feature, plus
one for each of the strongest pairs of features.  The tables are learnt by
cyclic boosting: round after round, each table in turn gets a small step in the
direction of a shallow tree over its bins, fitted to what is still unexplained.
The first rounds go over the features alone.  Then the pairs are chosen whose
tree explains most of what is left, and the further rounds go over features and
pairs alike; a pair's tree cuts the square of both features' bins.  Scoring a
text is adding up table entries, vectorised over texts.

The model is fitted on at most SAMPLE labelled documents, those with the least
hash of the document id, one row each, whatever the size of the input; scoring
covers every text.  Labels, language, source and document id are no features.

Defined results: a null text is an empty one; a very long text is counted like
any other; a text without words has a score like any other; of documents of one
id with different texts one is learnt from, that of least counts; without
labels of both kinds every score is 0.5; repeated rows are scored each; an
empty table gives no rows; no column but id and text is read, so other names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scanweave.llm.common import small_batches, table
from scanweave.llm.textstats import COUNTS, COUNTS_SCHEMA, add_counts, counts

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES, LEAST = 150, 0.15, 4, 10
#: Share of the rounds that go over the features alone, before pairs are chosen.
ALONE = 0.6

FEATURES = ("words", "word_length", "symbols", "marks", "upper", "digits", "dup_lines", "repeats", "fresh", "line_words")


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """FEATURES of texts, a column each."""
    w, ch, ln = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    # the share of words seen for the first time, which falls with the length; the pair with the length makes up for that
    fresh = (c["n_words"] - c["n_again"] + 1) / (w + 1)
    return np.stack([np.log(w), ch / w, c["n_symbols"] / ch, c["n_marks"] / w, c["n_upper"] / ch, c["n_digits"] / ch, c["n_dup_lines"] / ln, c["n_repeat_words"] / w, fresh, w / ln], 1)


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            logit += t[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for p in self.pairs for j in p}
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            logit += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, weight: np.ndarray, count: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, float]:
    """The steps of a tree over a table of bins (of one axis or two), and its gain.

    The box with the cut of largest gain is cut, along either axis, again and
    again; every leaf holds LEAST texts at least.
    """
    grad, weight, count = (np.asarray(v, float).reshape(len(grad), -1) for v in (grad, weight, count))
    sums = [np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (grad, weight, count)]

    def of(v: np.ndarray, a, b, c, d):
        return v[b, d] - v[a, d] - v[b, c] + v[a, c]

    def best_cut(box: tuple[int, int, int, int]) -> tuple[float, tuple, tuple]:
        a, b, c, d = box
        g, h, _ = (of(v, *box) for v in sums)
        best = (1e-9, (), ())
        for lo, hi, part in ((a, b, lambda x, y: (x, y, c, d)), (c, d, lambda x, y: (a, b, x, y))):
            m = np.arange(lo + 1, hi)
            if not len(m):
                continue
            one, two = ([of(v, *part(*ends)) for v in sums] for ends in ((np.full_like(m, lo), m), (m, np.full_like(m, hi))))
            gain = one[0] ** 2 / (one[1] + 1) + two[0] ** 2 / (two[1] + 1) - g**2 / (h + 1)
            gain = np.where(np.minimum(one[2], two[2]) >= LEAST, gain, -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), part(lo, int(m[k])), part(int(m[k]), hi))
        return best

    boxes = [(0, grad.shape[0], 0, grad.shape[1])]
    cuts = {boxes[0]: best_cut(boxes[0])}
    total = 0.0
    while len(boxes) <= leaves:
        box = max(boxes, key=lambda x: cuts[x][0])
        gain, one, two = cuts[box]
        if not one:
            break
        total += gain
        boxes.remove(box)
        boxes += [one, two]
        cuts |= {one: best_cut(one), two: best_cut(two)}
    step = np.zeros(grad.shape)
    for a, b, c, d in boxes:
        step[a:b, c:d] = of(sums[0], a, b, c, d) / (of(sums[1], a, b, c, d) + 1)
    return step, total


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """Cyclic boosting of the feature tables, and then of these and the tables of the chosen pairs."""
    y = y.astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model()
    m = Model(base=float(np.log(y.mean() / (1 - y.mean()))))
    m.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.pair_edges)]
    logit = np.full(len(y), m.base)

    def tree(cell: np.ndarray, shape: tuple[int, ...]) -> tuple[np.ndarray, float]:
        p, n = 1 / (1 + np.exp(-logit)), int(np.prod(shape))
        step, gain = _tree(*(np.bincount(cell, v, n).reshape(shape) for v in (y - p, p * (1 - p), np.ones(len(y)))))
        return step.reshape(shape), gain

    def cycle(slots: list[tuple[np.ndarray, np.ndarray]], n: int) -> None:
        for _ in range(n):
            for cell, t in slots:
                step = rate * tree(cell, t.shape)[0]
                t += step
                logit[:] += step.ravel()[cell]

    own = list(zip(at, m.tables, strict=True))
    alone = int(rounds * ALONE)
    cycle(own, alone)
    shape = lambda a, b: (len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)
    cell = lambda a, b: coarse[a] * shape(a, b)[1] + coarse[b]
    every = [(a, b) for a in range(x.shape[1]) for b in range(a)]
    m.pairs = sorted(every, key=lambda ab: -tree(cell(*ab), shape(*ab))[1])[:PAIRS]
    m.pair_tables = [np.zeros(shape(*ab)) for ab in m.pairs]
    cycle(own + [(cell(*ab), t) for ab, t in zip(m.pairs, m.pair_tables, strict=True)], rounds - alone)
    return m


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents that are not held out, at most `sample` of them."""
    small_batches(docs.sparkSession)
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("text", "doc_id").join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "quality")  # at most `sample` rows
    got = texts.mapInArrow(add_counts, f"doc_id long, quality int, {COUNTS_SCHEMA}")
    # a row a document, however often it stands there: so the driver gets `sample` rows at most
    got = got.groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("quality", "c.*").toPandas()
    got = got.sort_values([*COUNTS, "quality"])
    return fit(features({c: got[c].to_numpy() for c in COUNTS}), got["quality"].to_numpy())


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                s = model.score(features(counts(some.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    small_batches(docs.sparkSession)
    read = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return read.mapInArrow(run, StructType([StructField("key", read.schema["key"].dataType), StructField("score", DoubleType())]))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return rows.select(F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
