"""Quality rules, classifier, secrets, licences."""

import collections
import hashlib
import math
import pathlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.llm import classifier as C
from scanweave.llm import licenses as L
from scanweave.llm import rules as R
from scanweave.llm import secrets as S
from scanweave.llm.textstats import counts


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep)


def test_counts(spark, sf_dir, odd):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [r.text for r in odd.collect()]
    got = counts(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [brute_counts(t) for t in texts]


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.02), (3, 500, 0.02), (7, 2000, 0.005), (40, 50, 0.9)])
def test_binomial_tail(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(R.at_most(k, n, p) - exact) < 1e-9


def test_cutoffs_hold_their_bound():
    # 1000 good texts: 3 false rejections are certified at 2 %, 15 are not, and the sequence stops there
    assert R.certified(1000, np.array([0, 3, 15, 3]), np.array([10, 50, 60, 70]), 0.02, 0.01) == 1
    assert R.certified(1000, np.array([0, 3, 15]), np.array([50, 50, 60]), 0.02, 0.01) == 0  # the mildest that catches as many
    assert R.certified(50, np.array([0]), np.array([5]), 0.02, 0.01) is None


def test_rules_on_odd_rows(odd, none, labels):
    rows = R.judged(odd, labels).collect()
    assert len(rows) == odd.count()
    assert {r.key for r in rows if not r.base_failed} <= {6, 7}
    kept = R.filtered(odd, labels)
    assert kept.columns == odd.columns
    assert R.judged(none, labels).count() == 0 and R.filtered(none, labels).count() == 0


def plain_verdicts(docs, labels):
    """kept of every document by plain counts, plain cutoffs and plain comparisons."""
    values, base = {}, {}
    for i, text, _ in docs:
        n, chars, sym, dup, rep = brute_counts(text)
        t, words = text or "", re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda a, b: a / b if b else 0.0
        values[i] = {
            "symbols": share(sym, chars), "marks": share(sum(c in "!?" for c in t), n), "dup_lines": share(dup, len(lines)), "repeats": share(rep, n),
            "upper": share(sum("A" <= c <= "Z" for c in t), chars), "digits": share(sum("0" <= c <= "9" for c in t), chars),
        }
        base[i] = n < 50 or 100 * rep > 50 * n
        assert len(words) == n
    quality, lang = dict(labels), {i: lang for i, _, lang in docs}
    sample = [i for i, _, _ in docs if i in quality and not base[i]]
    strata = {lang[i] for i in sample}
    limits = {}
    for s in strata:
        good, bad = ([i for i in sample if lang[i] == s and quality[i] == q] for q in (1, 0))
        now, states = {}, []
        for name, k in R.steps():
            now = {**now, name: R.rules()[name][1][k]}
            false, caught = (sum(any(values[i][r] > c for r, c in now.items()) for i in some) for some in (good, bad))
            # the exact tail of the binomial distribution
            if sum(math.comb(len(good), j) * R.RISK**j * (1 - R.RISK) ** (len(good) - j) for j in range(false + 1)) > R.LEVEL / len(strata):
                break
            states.append((caught, now))
        if states and states[-1][0]:
            limits[s] = next(state for caught, state in states if caught >= R.ENOUGH * states[-1][0])
    return {i: not base[i] and not any(values[i][r] > c for r, c in limits.get(lang[i], {}).items()) for i, _, _ in docs}, limits


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_verdicts_of_op8_equal_plain_ones(spark, scale):
    sf = f"/root/testdata/sf{scale}"
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None]
    want, limits = plain_verdicts(docs, labels)
    assert {r.doc_id: r.kept for r in R.op8_quality_rules(spark, sf).collect()} == want
    if scale == "0.1":  # every language has cutoffs, and its labelled bad texts go
        assert len(limits) == len({lang for _, _, lang in docs})
        assert not [i for i, q in labels if q == 0 and want.get(i)]


def test_texts_that_the_base_rules_reject_spoil_no_certificate(spark):
    """Good labels on short texts that a rule would reject, too: the certificate counts only what the rules decide on."""
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(i, plain, "x", 1) for i in range(200)] + [(1000 + i, "###", "x", 1) for i in range(30)] + [(2000 + i, " ".join(f"word{j}######" for j in range(60)), "x", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    assert {r.key for r in R.judged(docs.drop("quality"), docs.select("doc_id", "quality")).filter("kept").collect()} == set(range(200))


def test_op8(spark, sf_dir):
    rows = {r.doc_id: r for r in R.op8_quality_rules(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, chars, sym, dup, rep = brute_counts(d.text)
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in C.op7_classifier(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.97 * len(held)


def test_classifier_on_odd_rows(odd, none, labels):
    assert C.scored(odd, C.train(odd, labels)).count() == odd.count()
    assert {r.score for r in C.scored(odd, C.train(none, labels)).collect()} == {0.5}
    assert C.scored(none, C.Model()).count() == 0


def test_pairs_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(C.FEATURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(int)
    m = C.fit(x, y, rounds=100)
    assert (2, 1) in m.pairs
    assert (((m.score(x) > 0.5) == y).mean()) > 0.9


def brute_spans(t):
    t = t or ""
    out = []
    for no, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, t):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), no, f"{r.kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, odd, none):
    texts = ["secret=abc token=abcdef", "token: token = abcdefgh", 'é API_KEY": "a1b2c3d4"', "AKIA" + "A" * 16 + " 0123456789abcdef0123456789", "PassWd:x", "x" * 9 + "deadbeef" * 4 + "\npassword='longer-one'", "-----BEGIN RSA PRIVATE KEY-----"]
    docs = odd.select("doc_id", "text", "blob").unionByName(spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(texts)] + [(None, texts[0], None)], "doc_id long, text string, blob string"))
    got = S.findings(docs, S.scan_unseen(docs, "doc_id", "text"), "doc_id", "text").select("path", S._written(F.col("spans")).alias("spans"))
    want = sorted((str(r.doc_id), brute_spans(r.text)) for r in docs.collect())
    assert sorted((str(r.path), r.spans) for r in got.collect()) == want
    assert S.findings(none, S.scan_unseen(none, "doc_id", "text"), "doc_id", "text").count() == 0
    clean = S.redact(docs, S.findings(docs, S.scan_unseen(docs, "doc_id", "text"), "doc_id", "text"))
    assert clean.columns == docs.columns
    by = {r.doc_id: r.text for r in clean.collect()}
    assert by[100] == "secret=abc [SECRET]" and by[8] == "[SECRET] end [SECRET]" and by[1] is None


def test_ledger_scans_unseen_blobs_only(spark, tmp_path):
    v1 = spark.createDataFrame([("a", "password=hunter22"), ("b", "nothing")], "path string, content string")
    v2 = spark.createDataFrame([("a", "password=hunter22"), ("c", "token=abcdefg"), ("d", "password=hunter22")], "path string, content string")
    folder = f"file://{tmp_path}/ledger"
    S.update_ledger(spark, v1, folder)
    assert S.scan_unseen(v2, ledger=spark.read.parquet(folder)).count() == 1
    assert S.scan_unseen(v2, ledger=spark.read.parquet(folder), rule_version="next").count() == 2
    got = {r.path: len(r.spans) for r in S.update_ledger(spark, v2, folder).collect()}
    assert got == {"a": 1, "c": 1, "d": 1}
    assert spark.read.parquet(folder).count() == 3


def test_licenses(spark, odd, none):
    texts = dict(reversed(L.KNOWN))
    mit = texts["MIT"] = L.KNOWN[0][1]
    wrapped = lambda t: "\n".join(t[i : i + 60] for i in range(0, len(t), 60))
    wrap_words = lambda t: re.sub(r"((?:\S+ ){9})", r"\1\n", t)
    curly = mit.replace('"Software"', "“Software”").replace('"AS IS"', "“AS IS”")
    cases = [
        ("Copyright (c) 2020 A\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(" ", "\n"), "MIT", "MIT"),
        (mit + " more", None, ""),
        ("text\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0.", None, "CC-BY-NC-4.0,MIT"),
        (None, None, ""),
        ("MIT License\n\nCopyright (c) 2021 Some Body\n\n" + wrap_words(mit), "MIT", "MIT"),
        ("The MIT License (MIT)\n\n" + wrap_words(curly), "MIT", "MIT"),
        (wrap_words(L._BSD_TERMS.replace("1. ", "* ").replace("2. ", "* ") + L._BSD_NAME.replace("3. ", "* ") + L._BSD_AS_IS), "BSD-3-Clause", "BSD-3-Clause"),
        ("// code\n\n" + wrap_words(L._FREE.format("General Public License", "3")) + "\n\nmore", None, "GPL-3.0-or-later"),
        (wrapped(mit) + ".", None, ""),  # words cut in two are other words
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    known = L.known_licenses(spark)
    got = {r.key: (r.license, r.notices) for r in L.found(docs, known).collect()}
    assert got == {i: (name, notices) for i, (_, name, notices) in enumerate(cases)}
    assert L.found(odd, known).filter("key = 1").first().digest == hashlib.sha256(b"").hexdigest()
    assert L.found(odd, known).count() == odd.count() and L.found(none, known).count() == 0


LONG_TEXTS = pathlib.Path("/usr/share/common-licenses")


@pytest.mark.skipif(not LONG_TEXTS.is_dir(), reason="no licence texts on this machine")
def test_long_texts_are_known_by_their_digests(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = {n: (LONG_TEXTS / f).read_text() for f, n in names.items()}
    assert set(map(tuple, L.digests_of(spark.createDataFrame(list(texts.items()), "license string, text string")).collect())) <= set(L.DIGESTS)
    # copyright lines are lines, so a paragraph that has one is not wrapped anew
    rewrapped = {n: "\n\n".join(p if "(c)" in p.lower() else " ".join(p.split()) for p in t.split("\n\n")).upper() for n, t in texts.items()}
    headed = {"Apache-2.0": texts["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright Some Body Inc."), "GPL-3.0": texts["GPL-3.0"][: texts["GPL-3.0"].index("How to Apply")]}
    rows = [(i, t) for i, t in enumerate([*rewrapped.values(), *headed.values()])]
    got = {r.key: r.license for r in L.found(spark.createDataFrame(rows, "doc_id long, text string"), L.known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [*rewrapped, *headed]


def test_notices_identifiers_and_holders(spark):
    mit = L.KNOWN[0][1]
    cases = [
        ("SPDX-License-Identifier: MIT", "MIT", "MIT"),  # the whole text is a known one
        ("x = 1\n// SPDX-License-Identifier: GPL-2.0-only\ny = 2", None, "GPL-2.0"),
        ("This project is licensed under the MIT License - see the LICENSE file for details.", None, "MIT"),
        ("Some words. This software is distributed under the terms of the Apache License, Version 2.0! More words.", None, "Apache-2.0"),
        ("Copyright Foo Bar Inc.\n\n" + mit, "MIT", "MIT"),
        ("MIT License\n\nCopyright Foo Bar Inc.\nAll rights reserved.\n\n" + mit, "MIT", "MIT"),
        (mit + "\n\nCopyright the authors\n", "MIT", "MIT"),
        ("copyright is a word\nof this text", None, ""),
        ("We like the MIT License.", None, ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.key: (r.license, r.notices) for r in L.found(docs, L.known_licenses(spark)).collect()}
    assert got == {i: (name, named) for i, (_, name, named) in enumerate(cases)}


def test_notices_of_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (1, "x\nLicensed under CC BY 4.0."), (None, "x\nReleased under CC0 1.0.")], "doc_id long, text string")
    assert sorted((str(r.key), r.notices) for r in L.found(docs, L.known_licenses(spark)).collect()) == [("1", "CC-BY-4.0"), ("1", "MIT"), ("None", "CC0-1.0")]


def test_every_known_text_has_a_stem():
    assert all(any(s in t.lower().replace("license", "licence") or s in t.lower() for s in L.stems(L.variants())) for _, t in L.variants())
    assert "" not in L.stems(L.variants())


def test_few_labels_have_cutoffs_for_all_rules_together(spark):
    """200 good labels of each of four languages: the risk is spent once, so their bad texts are rejected; 100 are too few."""
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(f"{lang}{i}", plain if i < n else " ".join(f"word{j}###########" for j in range(60)), lang, int(i < n)) for lang, n in (("a", 200), ("b", 200), ("c", 200), ("d", 100)) for i in range(n + 20)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id string, quality int")
    kept = {r.key for r in R.judged(docs, labels).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[3] or r[2] == "d"}
    assert R.least_labels(4) == 144


def test_union_of_rejections_is_what_is_certified(spark):
    """Cutoffs are those of a plain run through the sequence, on counted texts that several rules reject."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        bad = i % 6 == 0
        words = [f"w{v}" for v in rng.integers(0, 400, 80)] + ["#$"] * int(rng.integers(0, 60 if bad else 4)) + ["LOUD"] * int(rng.integers(0, 50 if bad else 6))
        rows.append((i, " ".join(words), "x" if i % 2 else None, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    counted = R.counted(docs).filter(~R.base_failed()).select("lang", "quality", *(v.alias(k) for k, (v, _) in R.rules().items())).collect()
    want = {}
    for s in ("x", None):
        good, bad = ([r for r in counted if r.lang == s and r.quality == q] for q in (1, 0))
        now, states = {}, []
        for name, i in R.steps():
            now = {**now, name: R.rules()[name][1][i]}
            false, caught = (sum(any(r[k] > c for k, c in now.items()) for r in some) for some in (good, bad))
            if R.at_most(false, len(good), R.RISK) > R.LEVEL / 2:
                break
            states.append((caught, now))
        if states and states[-1][0]:
            want[s] = next(state for caught, state in states if caught >= R.ENOUGH * states[-1][0])
    got = {r.limit_of: r for r in R.cutoffs(R.counted(docs)).collect()}
    assert want and {s: {n: r[f"max_{n}"] for n in R.rules() if r[f"max_{n}"] is not None and not math.isnan(r[f"max_{n}"])} for s, r in got.items()} == want
    for r in got.values():  # the bound, by plain sums of binomial terms
        assert sum(math.comb(r.good, i) * R.RISK**i * (1 - R.RISK) ** (r.good - i) for i in range(r.false + 1)) <= R.LEVEL / 2
