import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanweave.llm import neardup as N


def brute(rows, k, percent):
    """Components by all links, from Python sets of word tuples."""
    sets, parent = {}, {}
    for i, text in rows:
        if i is None:
            continue
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "percent", "cluster"), [(3, 85, 2048), (5, 80, 2)])
def test_documents(spark, sf_dir, k, percent, cluster):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(N.near_duplicates(docs, k, percent, cluster=cluster)) == brute(rows, k, percent)


def test_op1_keeps_the_least_of_each_group(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, root, root == i) for i, (n, root) in brute(rows, 3, 85).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.op1_minhash(spark, sf_dir).collect()} == want
    assert not all(kept for _, _, kept in want.values())


def test_recall_of_the_bands(spark):
    """Pairs of all similarities from the limit up, a few hundred: none is lost."""
    rng, rows = np.random.default_rng(11), []
    for i in range(300):
        words = [f"p{i}w{j}" for j in range(200)]
        other = list(words)
        # one edit costs up to three shingles of 198
        for at in rng.choice(np.arange(0, 200, 5), int(rng.integers(0, 6)), replace=False):
            other[at] = f"p{i}new{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(N.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_chain_of_edits_in_small_chunks(spark):
    """Near copies where few are similar to each other: links form chains, clusters are cut into many chunks."""
    rng, words, rows = np.random.default_rng(5), [f"w{i}" for i in range(120)], []
    for i in range(60):
        words = list(words)
        words[int(rng.integers(120))] = f"new{i}"
        rows.append((i * 7 % 61, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert got(N.near_duplicates(docs, 3, 85, cluster=4)) == want
    assert got(N.near_duplicates(docs, 3, 85)) == want


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(N.near_duplicates(odd, 3, 85)) == brute(rows, 3, 85)
    assert N.near_duplicates(none).count() == 0
    kept = N.deduplicated(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 8, 9, 10}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[200:2200])
    regs = N.registers(np.repeat([0, 1], 2000), np.concatenate([a, b]), 2)
    assert abs((regs[0] == regs[1]).mean() - 1800 / 2200) < 0.08
    both = N.registers(np.zeros(2200, int), np.sort(pool[:2200]), 1)
    assert (np.maximum(regs[0], regs[1]) == both[0]).all()
    may = N.may_be_similar(regs[0], 2000.0, regs[1:], np.array([2000.0]), 0.8)
    assert may.all()
    far = N.registers(np.zeros(2000, int), np.sort(rng.integers(0, 1 << 63, 2000).astype(np.uint64)), 1)
    assert not N.may_be_similar(regs[0], 2000.0, far, np.array([2000.0]), 0.8).any()


def templates(rng, n, own):
    """Texts of one long passage with `own` words of their own at the end: pairs are somewhat similar, none is linked."""
    passage = [f"p{i}" for i in range(200)]
    return [(i, " ".join([*passage, *(f"x{v}" for v in rng.integers(0, 10**9, own))])) for i in range(n)]


@pytest.mark.parametrize("own", [40, 80])
def test_templates_without_links_send_no_texts_to_all_chunks(spark, monkeypatch, tmp_path, own):
    """Templates at a similarity of about 0.7 and 0.55: one cluster by buckets, no links, so the whole cluster is fringe."""
    rows = templates(np.random.default_rng(own), 300, own)
    solver, folder = N._fringe_solver, str(tmp_path)

    def watched(k, percent):
        def run(batches):
            def seen():
                for b in batches:
                    with open(f"{folder}/{os.getpid()}", "a") as f:
                        f.writelines(f"{x} {y}\n" for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
                    yield b

            yield from solver(k, percent)(seen())

        return run

    monkeypatch.setattr(N, "_fringe_solver", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(N.near_duplicates(docs, 3, 85, cluster=32))
    assert found == brute(rows, 3, 85)
    assert len({c for _, c in found.values()}) == 300
    sent = Counter(line for p in tmp_path.iterdir() for line in p.read_text().splitlines())
    assert sum(sent.values()) <= 300  # before: each text went to each of about ten chunks
    assert max(sent.values(), default=0) <= 100  # and a task held all 300


def test_fringe_in_small_blocks_and_pieces(spark, monkeypatch):
    """Two large groups of near copies, chained by templates: the smaller group's links are found across blocks and pieces."""
    monkeypatch.setattr(N, "SIDE", 5)
    rng, rows = np.random.default_rng(9), []
    for i, text in templates(rng, 40, 60):
        rows.append((i, text))
    for first, of in ((100, 3), (200, 7)):
        for i in range(40):
            words = rows[of][1].split()
            words[int(rng.integers(260))] = f"new{first + i}"
            rows.append((first + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(N.near_duplicates(docs, 3, 85, cluster=8, fringe=3)) == brute(rows, 3, 85)


def test_spread_join_is_a_join(spark):
    """One key with most rows, a null key, a key without facts and one with two: as a plain join."""
    from scanweave.llm.common import spread_join

    rows = spark.createDataFrame([(1, i) for i in range(200)] + [(2, 7), (2, None), (3, 8), (None, 9), (4, 10), (1, 5)], "k long, v long")
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (4, "d"), (5, "e"), (None, "f")], "k long, f string")
    for how in ("inner", "left"):
        plain = sorted(map(str, rows.join(facts, "k", how).select("k", "v", "f").collect()))
        assert sorted(map(str, spread_join(rows, facts, "k", "v", how).select("k", "v", "f").collect())) == plain
    assert spread_join(rows.filter("k > 9"), facts, "k", "v", "left").count() == 0
