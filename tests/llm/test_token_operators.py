"""Mixing, token counts, packing, token files, top-k search, and the pipeline."""

import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scanweave.llm import mixing as M
from scanweave.llm import packing as P
from scanweave.llm import separators as T
from scanweave.llm import topk as K
from scanweave.llm import wavelet as W
from scanweave.llm.tokens import Encoder

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain_ids(file, text):
    return Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_encoder_is_the_whole_text_encoding(spark, sf_dir, odd, file):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + [r.text for r in odd.collect()]
    texts += ["a  b", " a", "a ", "a\n\nb", "a \nb", "<|endoftext|> x", "don't I'd, they've!? x.", "tab\tx", "x y", "\x01 \x01 x", "a, b; c: d.", "1,000.5 x2. 3rd!", "ﬁ Ǆ İ Σας.", "word... next,"]
    e, plain = Encoder(file), Tokenizer.from_file(file)
    for _ in range(2):  # from the memo, too
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert got.tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def plain_targets(sizes, weights, most=3):
    """Shares by weight; whoever is above the bound gets the bound, and the rest is shared again, until none is above."""
    out, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = np.random.default_rng(seed)
    sizes = [[100, 100, 100], [10, 1000, 0], r.integers(0, 1000, 9).tolist(), (r.pareto(0.7, 30) * 10).astype(int).tolist()][seed]
    sized = spark.createDataFrame([(f"s{i:03d}" if i else None, s) for i, s in enumerate(sizes)], "source string, size long")
    got = {r.source: r for r in M.sources(sized).collect()}
    order = [*range(1, len(sizes)), 0]  # null comes last
    want = plain_targets([sizes[i] for i in order], [M.WEIGHTS[k % 3] for k in range(len(order))])
    for k, i in enumerate(order):
        row = got[f"s{i:03d}" if i else None]
        assert row.no == k and row.target == pytest.approx(want[k], rel=1e-9, abs=1e-9)
        assert row.quota <= 3 * row.blocks and abs(row.quota - (want[k] * row.blocks / sizes[i] if sizes[i] else 0)) <= 0.5 + 1e-6


def test_draws_by_groups_of_sources(spark):
    """Small groups of sources: every source gets its quota of slots exactly."""
    known = spark.createDataFrame([(i, f"s{i}", 640 * (i + 1), 1.0, 10 * (i + 1), 7 * i) for i in range(11)], "no long, source string, source_size long, target double, blocks long, quota long")
    rows = M.shards(known, group=3).groupBy("no").agg(F.sum("slots").alias("n")).collect()
    assert {r.no: r.n for r in rows} == {i: 7 * i for i in range(1, 11)}


def test_rows_of_one_id_keep_their_own_draws(spark):
    """Two texts of one id and size: what the mix has of each is what its draws say."""
    a, b = (" ".join(f"{c}{i}" for i in range(300)) for c in "ab")
    docs = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (1, b, "y"), (None, a, None)], "doc_id long, text string, source string")
    want = sum(r["taken"] for r in M.mixed(docs).select(M.taken().alias("taken")).collect())
    texts = [r.text for r in M.mixed_texts(docs).collect()]
    assert sum(len(t.split()) for t in texts) == want
    assert all(len({w[0] for w in t.split()}) == 1 for t in texts)


def plain_mix(rows, known, block, seed):
    """The mix by plain loops: draws shard by shard, slots numbered by source, streams cut into blocks."""
    quota = {k.no: k.quota for k in known if k.quota}
    order, total = sorted(quota), sum(quota.values())
    shards_, left = [], total
    for shard in range(-(-total // M.SHARD_SLOTS)):
        n = min(M.SHARD_SLOTS, left)
        left -= n
        # one group of sources: its draw is all of n, and the sources' draw has a seed of its own
        drawn = np.random.default_rng([seed, shard, 0, 1]).multinomial(n, np.array([quota[k] for k in order]) / total)
        shards_.append(dict(zip(order, drawn.tolist(), strict=True)))
    used, slots = dict.fromkeys(order, 0), []
    for shard, drawn in enumerate(shards_):
        for no, n in drawn.items():
            take = min(n, quota[no] - used[no])
            slots += [(shard, no, used[no] + i) for i in range(take)]
            used[no] += take
    slots += [(len(shards_), no, used[no] + i) for no in order for i in range(quota[no] - used[no])]
    blocks = {k.no: k.blocks for k in known}
    holds = {}
    for r in rows:
        for w in range(r.size):
            holds.setdefault((r.no, (r.begin + w) // block), []).append((r.row_id, w))
    read = {}
    for shard, no, slot in slots:
        round_, n = divmod(slot, blocks[no])
        at = int(M.permuted(np.array([n]), blocks[no], (seed * 1_000_003 + no) * 64 + round_)[0])
        read.setdefault((shard, no), []).extend(sorted(holds[no, at]))
    return {k: sorted(v) for k, v in read.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_a_plain_one(spark, sf_dir, odd, seed):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").limit(120).unionByName(odd.select("doc_id", "text", "source"))
    sized = M.written(docs.select(*M._sized(docs, "doc_id", "text", "source")).withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    streamed, known = M.placed(sized, block=16)
    # streams: by range of a hash, then by id
    want, begins = {}, streamed.withColumn("r", F.pmod(F.xxhash64("doc_id", F.lit(0)), F.lit(1))).collect()
    for r in sized.select("row_id", "doc_id", "source", "size", "tie", F.pmod(F.xxhash64("doc_id", "tie", F.lit(M.SEED)), F.lit(M.DEALT)).alias("range")).collect():
        want.setdefault(r.source, []).append((r.range, r.doc_id is not None, r.doc_id or 0, r.size, r.tie, r.row_id))
    begin = {}
    for own in want.values():
        at = 0
        for *_, size, _, row in sorted(own):
            begin[row], at = at, at + size
    assert {r.row_id: r.begin for r in begins} == begin
    rows = M.mix(streamed, known, 16, seed).collect()
    got = {}
    for r in rows:
        got.setdefault((r.shard, r.no), []).extend((r.row_id, r["from"] + i) for i in range(r.words))
    plain = plain_mix(begins, known.collect(), 16, seed)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in plain.items() if v}
    for shard in {r.shard for r in rows}:  # every place of a shard is taken once
        places = sorted({r.place for r in rows if r.shard == shard})
        assert places == list(range(len(places)))
    taken = {}
    for words in plain.values():
        for row, _ in words:
            taken[row] = taken.get(row, 0) + 1
    drawn = M.drawn_from(sized, block=16, seed=seed).select("row_id", M.taken().alias("t")).collect()
    assert {r.row_id: r.t for r in drawn if r.t} == taken


def test_seed_of_the_draw_changes_the_shards(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(640)), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    sized = M.written(docs.select(*M._sized(docs, "doc_id", "text", "source")).withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    streamed, known = M.placed(sized)
    counts = [{(r.shard, r.no): r.n for r in M.mix(streamed, known, seed=s).groupBy("shard", "no").agg(F.countDistinct("place").alias("n")).collect()} for s in (1, 1, 2)]
    assert counts[0] == counts[1] != counts[2]


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutation(size):
    got = M.permuted(np.arange(size), size, 99)
    assert sorted(got) == list(range(size))
    assert size < 17 or not np.array_equal(got, np.arange(size))


def check_mix(docs):
    rows = M.mixed(docs).select("doc_id", "size", "source_size", "target", M.taken().alias("taken"))
    got = rows.collect()
    assert len(got) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    by = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect()
    assert all(abs(r.t - r.target) <= 4 * M.BLOCK for r in by)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    texts = M.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert texts.select(F.sum(M.n_words(F.col("text")))).first()[0] == (sum(r["taken"] for r in got) or None)


def test_mix_of_documents(spark, sf_dir):
    check_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_mix_of_odd_rows(odd, none):
    check_mix(odd)
    assert M.mixed(none).count() == 0 and M.mixed_texts(none).count() == 0


def brute_fit(lengths, length):
    rooms, n = [], 0
    for size in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, size)
        if i == len(rooms):
            n, room = n + 1, length - size
        else:
            room = rooms.pop(i) - size
        bisect.insort(rooms, room)
    return n


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 65, 400) if seed % 2 else np.clip(r.geometric(0.1, 400), 1, 64)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    bins = {}
    for size, first, last, at, offset in P.plan(counts, 64):
        for k in range(last - first + 1):
            bins.setdefault(at + k, []).append((offset, size))
    assert sum(len(b) for b in bins.values()) == 400 and len(bins) == brute_fit(lengths, 64)
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 64


def test_packing(spark, odd, none):
    rows = P.pack(odd, WORD, 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    for d in odd.filter("doc_id NOT IN (7, 8)").collect():
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.piece)
        ids = plain_ids(WORD, d.text) + [0]
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == list(range(0, len(ids), 64))
    assert P.pack(none, WORD).count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (5, 2), (3000, 300), (1025, 50_000)):
        ids = r.integers(0, top, n)
        s = W.Shard(W.build(ids, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        assert s.ids().tolist() == ids.tolist()
        for at in r.integers(0, max(n, 1), 40) if n else []:
            v = int(ids[at])
            assert s.access(int(at)) == v and s.count(v, int(at)) == (ids[:at] == v).sum()
            k = int(r.integers((ids == v).sum()))
            assert s.find(v, k) == np.flatnonzero(ids == v)[k]
        assert s.count(10**9) == 0 and s.find(top + 5) is None


def test_token_files(spark, odd, none):
    files = W.written(W.encode_shards(odd, BYTE, shard_ids=50), "t")
    rows = W.decode_shards(files).join(W.places(files), ["part", "shard"]).withColumn("at", F.col("start") + F.col("begin")).orderBy("at").collect()
    want = sorted(odd.collect(), key=lambda d: d.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in want]
    at = 0
    for r, d in zip(rows, want, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == plain_ids(BYTE, d.text) + [0] and r["at"] == at
        at += len(r.ids) // 4
    assert W.encode_shards(none, BYTE).count() == 0


@pytest.mark.parametrize(("size", "group"), [(1, 3), (7, 5), (1000, 1024)])
def test_separator_scan(spark, size, group):
    r = np.random.default_rng(size)
    flat = np.concatenate([np.append(r.integers(1, 9, r.integers(0, 30)), 0) for _ in range(40)] + [[5, 5]]).astype("<u2")
    blocks = [(0, i, bytearray(flat[i * size : (i + 1) * size].tobytes())) for i in range(-(-len(flat) // size))] + [(1, 0, bytearray(b"\1\0\0\0"))]
    got = T.token_counts(spark.createDataFrame(blocks, T.BLOCKS), end=0, group=group).orderBy("file", "doc_no").collect()
    ends = np.concatenate([[-1], np.flatnonzero(flat == 0), [len(flat) - 1]])
    assert [x.n_tokens for x in got if x.file == 0] == np.diff(ends).tolist()
    assert [x.start for x in got if x.file == 0] == (ends[:-1] + 1).tolist()
    assert [(x.n_tokens, x.ended) for x in got if x.file == 1] == [(2, True)]


def test_token_counts_of_odd_rows(spark, odd, none):
    blocks, order = T.flat_files(odd, BYTE, block_ids=16)
    got = sorted((r.doc_id, r.n_tokens) for r in order.join(T.token_counts(blocks, *T.end_of(BYTE)), ["file", "doc_no"]).collect())
    assert got == sorted((d.doc_id, len(plain_ids(BYTE, d.text)) + 1) for d in odd.collect())
    assert T.token_counts(T.flat_files(none, BYTE)[0], *T.end_of(BYTE)).count() == 0


def test_topk_in_small_buckets(spark):
    r = np.random.default_rng(7)
    v = (r.standard_normal((300, 16)) * np.exp(r.standard_normal((300, 1)))).astype(np.float32)
    v[40:80] = v[3]  # one very common vector
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(1000, None), (1001, [float("nan")] * 16), (1002, [1.0, None] + [0.0] * 14), (1003, [1.0, 2.0]), (None, [1.0] * 16), (250, [0.0] * 16), (1050, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in K.search(df, F.col("id") % 50 == 0, bucket=32, block=4).collect())
    sound = [(i, np.floor(256 * np.array(e, float)).astype(int)) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = {}
    for q, a in sound:
        if q % 50 == 0:
            want.setdefault(q, []).extend((-int(a @ b), i) for i, b in sound if i != q and len(a) == len(b))
    # an id that stands twice gathers the candidates of both its rows
    want = sorted((q, n + 1, i, -s) for q, c in want.items() for n, (s, i) in enumerate(sorted(c)[:5]))
    assert got == want
    dealt = K.search(df, F.col("id") % 50 == 0, bucket=32, block=4, broadcast=0)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in dealt.collect()) == want
    assert K.search(df.filter("vec_id < 0"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [5.0e6, 3.0e12, 1.0e300])
def test_topk_of_large_components(spark, size):
    """Large finite components take part: products beyond doubles, and beyond 64 bits, where scores stop at their ends."""
    r = np.random.default_rng(3)
    v = r.standard_normal((120, 4)) * np.where(np.arange(120)[:, None] % 7 == 0, size, 1.0)
    df = spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in K.search(df, F.col("id") % 10 == 0, bucket=16, block=4, rows=2, columns=3).collect())
    top = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [[top(int(np.floor(256 * x))) for x in e] for e in v]
    want = []
    for q in range(0, 120, 10):
        scores = sorted((-top(sum(a * b for a, b in zip(whole[q], whole[i], strict=True))), i) for i in range(120) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == want


def test_queries_on_documents(spark, sf_dir):
    """op4, op5 and op6 against the plain tokenizer and plain best-fit decreasing, on all documents."""
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids = {f: dict(zip([d for d, _ in docs], [e.ids + [0] for e in Tokenizer.from_file(f).encode_batch_fast([t or "" for _, t in docs], add_special_tokens=False)], strict=True)) for f in (WORD, BYTE)}
    assert sorted((r.doc_id, r.n_tokens) for r in T.op4_token_counts(spark, sf_dir).collect()) == [(d, len(ids[BYTE][d])) for d, _ in docs]
    at, want = 0, []
    for d, _ in docs:
        want.append((d, at, len(ids[BYTE][d]), crc(ids[BYTE][d])))
        at += len(ids[BYTE][d])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in W.op6_wavelet(spark, sf_dir).collect()) == want
    pieces = P.op5_best_fit(spark, sf_dir).collect()
    cut = [(d, i, s, len(x[s : s + 2048]), crc(x[s : s + 2048])) for d, x in ids[WORD].items() for i, s in enumerate(range(0, len(x), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == sorted(cut)
    assert len({r.sequence_id for r in pieces}) == brute_fit([c[3] for c in cut], 2048)
    ends = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_flat_files_are_read_as_blocks(spark, tmp_path):
    ids = np.concatenate([np.append(np.arange(1, n), 0) for n in (5, 1, 40, 3)]).astype("<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = T.read_flat(spark, f"file://{tmp_path}", 2, block_ids=7)
    assert blocks.count() == 7
    assert [r.n_tokens for r in T.token_counts(blocks, 0).orderBy("doc_no").collect()] == [5, 1, 40, 3]


def test_flat_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of zeros but for its ends: read by offset, block by block."""
    end = 0xFFFF
    spots = [3, (1 << 30) + 5, (1 << 30) + (1 << 28)]
    with open(tmp_path / "huge.bin", "wb") as f:
        for at in spots:
            f.seek(2 * at)
            f.write(end.to_bytes(2, "little"))
    got = T.token_counts(T.read_flat(spark, f"file://{tmp_path}", 2, block_ids=1 << 24), end).orderBy("doc_no").collect()
    assert [r.n_tokens for r in got] == [4, (1 << 30) + 2, (1 << 28) - 5] and all(r.ended for r in got)


def test_any_id_is_an_id(spark):
    rows = [(-1, "a b"), (None, "c"), (-(2**63), "d"), (2**63 - 1, "e"), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = W.decode_shards(W.written(W.encode_shards(docs, BYTE), "t")).orderBy("part", "shard", "begin").collect()
    assert [r.doc_id for r in got] == [None, -(2**63), -1, 0, 2**63 - 1]


