"""Phrase search, ranked search and clustering against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from scanweave.llm import centroids, decontam, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


LONG = " ".join(f"w{i % 613}" for i in range(40_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, None), (2, ""), (3, " .,; \n"), (4, f"before {PASSAGE} after"), (4, f"before {PASSAGE} after"), (5, PASSAGE.upper()), (6, "one two three"),
    (7, "short item"), (None, f"x {PASSAGE} y {PASSAGE}"), (8, "four five six seven eight nine ten eleven twelve one two three"), (9, LONG), (10, "é ñ ß 漢字 😀 É \x1c\xa0x"),
    (11, "a " * 500), (12, "one-two,three four\nfive(six)seven eight: nine ten"), (13, "short item short item one item"), (14, "b a b a b a"),
]
ITEMS = [
    (1, PASSAGE), (2, "Short item"), (2, "a a a a a a a a a a a a"), (3, None), (4, " - "), (None, "three four five six seven eight nine ten eleven twelve"), (5, "漢字 😀"),
    (6, " ".join(f"w{i % 613}" for i in range(600, 640))), (7, "a"), (70, "never seen words at all"), (8, PASSAGE), (9, LONG),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*d, "x", 7, 1) for d in DOCS], "doc_id long, text string, block string, slot int, `a.b` int").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "x", 7) for i in ITEMS], "item_id long, text string, words string, n int").repartition(2)


def plain_report(doc, text, window):
    words, hit, ids = terms(text), set(), set()
    for item, own in ITEMS:
        w = terms(own)
        n = min(window, len(w))
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                ids.add(item)
    named = sorted(str(i) for i in ids if i is not None)
    return doc, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("window, most", [(10, 1 << 16), (10, 500), (2, 1 << 16), (1, 3000)])
def test_decontamination_equals_a_plain_search(docs, items, window, most):
    got = decontam.report(decontam.matches(decontam.index(docs), items, window, most)).collect()
    want = [plain_report(*d, window) for d in DOCS]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_decontamination_of_empty_tables(spark, docs, items):
    index = decontam.index(docs)
    got = decontam.report(decontam.matches(index, items.limit(0))).collect()
    assert len(got) == len(DOCS) and not any(r.contaminated for r in got)
    assert decontam.report(decontam.matches(decontam.index(docs.limit(0)), items)).count() == 0
    assert decontam.near(decontam.index(docs.limit(0)), items, 5).count() == 0


@pytest.mark.parametrize("within", [1, 3, 12])
def test_proximity_equals_a_plain_search(docs, items, within):
    got = {tuple(r) for r in decontam.near(decontam.index(docs), items, within, 40).collect()}
    want = set()
    for doc, text in DOCS:
        words = terms(text)
        for item, own in ITEMS:
            need = set(terms(own))
            for b in range(len(words)) if need and len(need) <= within else ():
                if words[b] in need and need <= set(words[b : b + within]):
                    end = max(words.index(t, b) for t in need) + 1
                    want.add((doc, item, b, end))
    assert got == want


def plain_ranks(k):
    counted = [(d, Counter(terms(t))) for d, t in DOCS]
    sizes = [sum(c.values()) for _, c in counted]
    docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in ITEMS:
        scored = []
        for (doc, c), n in zip(counted, sizes, strict=True):
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (100 - 90 + 90 * n * docs // total))) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("k, most", [(10, 1 << 16), (2, 1 << 16), (3, 100)])
def test_ranked_search_equals_a_plain_one(docs, items, k, most):
    n, total = ranked.sizes(docs)
    got = ranked.search(ranked.index(docs, n, total), items, n, total, k=k, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_ranks(k), key=repr)


def test_ranked_search_of_empty_tables(docs, items):
    assert ranked.sizes(docs.limit(0)) == (0, 0)
    assert ranked.search(ranked.index(docs.limit(0), 0, 0), items, 0, 0).count() == 0
    n, total = ranked.sizes(docs)
    assert ranked.search(ranked.index(docs, n, total), items.limit(0), n, total).count() == 0


def test_bounds_leave_most_documents_unscored():
    """Bytes are rounded up, so they bound shares, and few documents reach the k-th bound."""
    rng = np.random.default_rng(3)
    tf, n = rng.integers(1, 50, 5000), rng.integers(50, 900, 5000)
    s = ranked.saturated(tf, n, 5000, int(n.sum()))
    b = -(-s // ranked.STEP)
    assert b.max() <= 255 and (s <= b * ranked.STEP).all() and (s > (b - 1) * ranked.STEP).all()
    assert (b * ranked.STEP >= np.sort((b - 1) * ranked.STEP + 1)[-10]).sum() < 300


def plain_nearest(v, c):
    d = ((v[:, None].astype(object) - c[None].astype(object)) ** 2).sum(2)
    return [min(range(len(c)), key=lambda j: (row[j], j)) for row in d], [min(row) for row in d]


@pytest.mark.parametrize("size", [3, 1000, 2**40])
def test_annulus_finds_the_nearest_and_ties(size):
    rng = np.random.default_rng(size)
    v = np.array(rng.integers(-size, size, (300, 3)))
    c = np.concatenate([v[:20], -v[:5], v[:2], np.zeros((1, 3), np.int64)])
    cluster, d, pairs = centroids.nearest(v, c)
    want, least = plain_nearest(v, c)
    assert cluster.tolist() == want and d.tolist() == least
    assert pairs <= v.shape[0] * len(c)


def test_annulus_prunes():
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(2000, 8)) * 10).astype(int) + np.arange(2000)[:, None]
    _, _, pairs = centroids.nearest(v, v[::20])
    assert pairs < 2000 * 100 // 5


@pytest.mark.parametrize("scale", [64, 1e9])
def test_clusters_equal_plain_rounds(spark, scale):
    rng = np.random.default_rng(7)
    vectors = [(int(i) if i % 9 else None, [float(x) for x in rng.normal(size=4)], 1) for i in range(120)]
    vectors += [(5, vectors[5][1], 1), (5, vectors[5][1], 1), (200, None, 1), (201, [1.0, None, 2.0, 3.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 1), (204, [1.0] * 5, 1), (205, [1e30, -1e30, 0.0, 1.0], 1), (206, [], 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, cluster int")
    kept = [(i, [min(max(math.floor(scale * x), -(2**63)), 2**63 - 1) for x in v]) for i, v, _ in vectors if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:6]]
    v = np.array([x for _, x in kept], object)
    for _ in range(3):
        at, _ = plain_nearest(v, np.array(c, object))
        for j in range(len(c)):
            own = [x for x, a in zip(v, at, strict=True) if a == j]
            c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else c[j]
    at, d = plain_nearest(v, np.array(c, object))
    most = 2**63 - 1
    want = [(i, a, min(x, most), min(sum(min(y, most) for y, b in zip(d, at, strict=True) if b == a), most), min(sum(min(y, most) for y in d), most), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)]
    got = centroids.clustered(df, k=6, dim=4, scale=scale).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_clusters_of_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert {r.cluster for r in centroids.clustered(df, dim=2).collect()} == {0, 1}
    assert centroids.clustered(df.limit(0), dim=2).count() == 0
    assert centroids.clustered(df, dim=3).count() == 0
