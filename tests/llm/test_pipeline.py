"""The pipeline, stage by stage, against plain versions."""

import bisect
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scanweave.llm import common
from scanweave.llm import mixing as M
from scanweave.llm import secrets as S
from tests.llm.test_neardup import brute
from tests.llm.test_text_operators import plain_verdicts
from tests.llm.test_token_operators import plain_mix

STAGES = dict(corpus_pipeline.STAGES)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir, odd):
    """Documents, odd rows with other ids, repeated rows, one text beyond a batch of 4 MB, and columns whose names clash or hold a dot."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strange = odd.withColumn("doc_id", F.col("doc_id") + 10_000).select(*base.columns)
    rows = base.unionByName(strange).unionByName(base.limit(5))
    long = " ".join(f"token{i % 9973} word{i * 7 % 8191}" for i in range(400_000))
    assert len(long) > 4 << 20
    more = spark.createDataFrame([(20_000, long, "en", "a", len(long)), (None, "a text without an id " + " ".join(f"x{i}" for i in range(80)), "en", None, 1)], base.schema)
    rows = rows.unionByName(more).withColumn("row", F.lit(1)).withColumn("blob", F.lit("b")).withColumn("n_words", F.lit(2)).withColumn("a.b", F.lit("dot"))
    return common.written(rows, "odd-documents").coalesce(3)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "secret scans", "mixing", "packing"]


def test_quality_rules(spark, sf_dir, docs):
    rows = docs.collect()
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None]
    # repeated rows count each, as rows of their own
    named = [(i, r.text, r.lang) for i, r in enumerate(rows)]
    want, _ = plain_verdicts(named, [(i, dict(labels)[r.doc_id]) for i, r in enumerate(rows) if r.doc_id in dict(labels)])
    assert listed(STAGES["quality rules"](spark, docs, sf_dir)) == sorted((tuple(r) for i, r in enumerate(rows) if want[i]), key=repr)


def test_near_duplicates(spark, sf_dir, docs):
    rows = docs.collect()
    groups = {}
    for i, (n, root) in brute([(i, r.text) for i, r in enumerate(rows)], 5, 80).items():
        groups.setdefault(root if n else ("blank", i), []).append(i)
    least = [min((rows[i].doc_id is None, rows[i].doc_id or 0) for i in own) for own in groups.values()]
    got = STAGES["near duplicates"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(least)
    assert got.join(docs.select("doc_id", "text"), ["doc_id", "text"], "left_anti").filter("doc_id IS NOT NULL AND text IS NOT NULL").count() == 0


def redacted(text):
    spans, out, at = [], "", 0
    for r in S.RULES:
        spans += [m.span() for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least]
    merged = []
    for b, e in sorted(spans):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([b, e])
    for b, e in merged:
        out, at = out + text[at:b] + "[SECRET]", e
    return out + text[at:]


def test_secret_scans(spark, sf_dir, docs):
    want = []
    for r in docs.collect():
        text = None if r.text is None else redacted(r.text)
        want.append(tuple((r.asDict() | {"text": text, "n_chars": None if text is None else len(text)}).values()))
    got = STAGES["secret scans"](spark, docs, sf_dir)
    assert got.columns == docs.columns and listed(got) == sorted(want, key=repr)


def test_mixing(spark, sf_dir, docs):
    """Each row's words are those that a plain mix reads of it, round by round."""
    some = docs.filter("doc_id < 60 OR doc_id > 9999 AND doc_id < 20000 OR doc_id IS NULL")
    base = common.written(some.withColumn("row_id", F.monotonically_increasing_id()), "mixed")
    sized = base.select("row_id", *M._sized(base, "doc_id", "text", "source"))
    streamed, known = M.placed(sized)
    texts = {r.row_id: r.text for r in base.collect()}
    times = {}
    for words in plain_mix(streamed.collect(), known.collect(), M.BLOCK, M.SEED).values():
        for at in words:
            times[at] = times.get(at, 0) + 1
    want = []
    for row, text in texts.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for round_ in range(1, max([times.get((row, i), 0) for i in range(len(own))], default=0) + 1):
            want.append(" ".join(w for i, w in enumerate(own) if times.get((row, i), 0) >= round_))
    got = STAGES["mixing"](spark, some, sf_dir)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    # rows that are alike may change places, so these are compared as texts
    assert sorted(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows) == sorted(want)


def test_packing(spark, sf_dir, docs):
    some = docs.filter("doc_id IS NULL OR doc_id < 40 OR doc_id > 9999")
    rows = STAGES["packing"](spark, some, sf_dir).collect()
    want = []
    for r in some.collect():
        ids = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, i, s, tuple(ids[s : s + 2048])) for i, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows), key=repr) == sorted(want, key=repr)
    ends, rooms, n = {}, [], 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    for size in sorted((len(w[3]) for w in want), reverse=True):
        i = bisect.bisect_left(rooms, size)
        n, room = (n + 1, 2048 - size) if i == len(rooms) else (n, rooms.pop(i) - size)
        bisect.insort(rooms, room)
    assert len(ends) == n and max(ends.values()) <= 2048


def test_stages_of_empty_tables(spark, sf_dir, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.written(stage(spark, docs, sf_dir), "t")
        assert docs.columns == before.columns, name
    columns = ["doc_id", "piece", "start", "length", "sequence_id", "offset", F.crc32("ids").alias("crc")]
    want = listed(STAGES["packing"](spark, docs, sf_dir).select(*columns))
    first = common.mark()
    rows = corpus_pipeline.run(spark, sf_dir).select(*columns)
    got = listed(rows)
    key = lambda rows: sorted((r[0], r[1], r[2], r[3], r[6]) for r in rows)
    assert key(got) == key(want) and len({r[4] for r in got}) == len({r[4] for r in want})
    assert common.release(spark, first) > 0 and common.mark() == first
