"""Image files at size: files are made once, after their rows were dealt, and are scanned and decoded a batch at a time."""

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanweave.plans import QUERIES
from scanweave.sources import blocks as B
from scanweave.sources import exr, piz, writer
from scanweave.sources import scan as S
from scanweave.sources.blocks import FLOAT, HALF, UINT
from scanweave.sources.writer import encoded, multipart


@pytest.mark.parametrize("name", ["exr_roundtrip_pxr24_half", "exr_coded_dwaa_huffman", "exr_coded_rle", "exr_multipart"])
def test_files_are_made_once_and_after_rows_are_dealt(spark, sf_dir, name):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, sf_dir)._jdf.queryExecution(), "simple")
    assert plan.count("write(") == 1
    assert plan.count("_structures(substring") == 1
    # arrays are made of rows above the exchange, not in the few tasks that read the table
    assert "transform(" not in plan[plan.index("RoundRobinPartitioning") :]


def test_rows_go_to_python_in_batches_of_bounded_size(spark):
    images = spark.range(0, 400, 1, 1)
    values = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: i.cast("double"))  # 80 KB a row
    writer.small_batches(images)
    sizes = images.select(values.alias("v")).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) * 80_000 <= 2 * writer.BATCH_BYTES and sum(r.n for r in sizes) == 400


def test_batches_between_the_steps_hold_a_megabyte_at_most(spark):
    values = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: (i * (F.col("id") + 1)).cast("double"))  # files of 40 KB that all differ
    files = writer.image_files(spark.range(0, 400, 1, 1), "id", [("Y", FLOAT, values)], 100, 0).coalesce(1)
    told = lambda df: df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches), "bytes long").collect()
    assert max(r.bytes for r in told(files)) <= 1.2 * (1 << 20)
    planes = [np.arange(64 * 5000, dtype="<f4").reshape(64, 5000)]  # 64 chunks of 20 KB
    content = encoded(planes, [FLOAT], ["Y"], 0)
    df = spark.createDataFrame([(f"f{i}.exr", len(content), bytearray(content)) for i in range(4)], "path string, length long, content binary").coalesce(1)
    batches = exr._plan_rows(exr.structure(df), None).toArrow().combine_chunks().to_batches()
    out = list(exr._chunker(iter(batches)))
    assert max(b.nbytes for b in out) <= 1.2 * (1 << 20) and sum(b.num_rows for b in out) == 4 * 65
    assert max(r.bytes for r in told(exr.scanlines(exr.chunks(exr.structure(df))))) <= 1.2 * (1 << 20)


def test_headers_that_are_alike_are_walked_once(monkeypatch):
    walks = []
    one = exr._structure
    monkeypatch.setattr(exr, "_structure", lambda content: walks.append(1) or one(content))
    small, large = (encoded([np.zeros((4, n), "<f4")], [FLOAT], ["Y"], 0) for n in (4, 5))
    bare = small[: small.index(b"lineOrder\0lineOrder\0") + 25]  # a header without its end
    files = [small, large, small, bare, small, large, b"", None, bare + b"x\0int\0\4\0\0\0\1\0\0\0\0" + bytes(90)]
    got = exr._structures(pa.array(files, pa.binary())).to_pylist()
    assert got == [pa.array([one(f or b"")], exr._STRUCTURE).to_pylist()[0] for f in files]
    assert len(walks) == 6


def test_chunks_of_a_batch_equal_those_of_each_file(spark):
    planes = [np.arange(33 * 5).reshape(33, 5).astype(t) for t in ("<f2", "<f4", "<u4")]
    whole = [encoded(planes, [HALF, FLOAT, UINT], ["A", "B", "C"], c) for c in (0, 1, 3, 5)]
    two = multipart([([planes[0]], [HALF], ["H"], 3), ([planes[1]], [FLOAT], ["F"], 0)])
    files = [*whole, two, multipart([([planes[0]], [HALF], ["H"], 3), ([planes[1]], [FLOAT], ["F"], 0)], [0, 0]), whole[0][:-1], whole[2][:-50]]
    late = bytearray(whole[0])
    late[-(8 + 50) : -(8 + 50) + 4] = b"\1\0\0\0"  # the last chunk says that it is line 1
    df = spark.createDataFrame([(f"f{i}.exr", len(c), bytearray(c)) for i, c in enumerate([*files, late])], "path string, length long, content binary").coalesce(1)
    rows = exr._plan_rows(exr.structure(df), None)
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    each = list(exr._odd_chunks(batch, [*exr.PLANNED, *exr._CHUNK_COLUMNS], types))
    at_once = list(exr._chunker(iter([batch])))
    of = lambda batches: sorted((repr(sorted((k, v) for k, v in r.items())) for b in batches for r in b.to_pylist()))
    assert of(at_once) == of(each)
    assert len(exr._usual(batch)[0]) >= 6


def test_chunks_of_the_same_bytes_are_decoded_once():
    calls = []
    scheme = B.Scheme("TWICE", 1, lambda payload, expected, planes: calls.append(payload) or payload * 2)

    def fail(payload, expected, planes):
        raise ValueError("no")

    assert B.decoded_many(scheme, [b"a", b"b", b"a", b"cd", b"b"], 2, []) == [b"aa", b"bb", b"aa", b"cd", b"bb"]
    assert calls == [b"a", b"b"]
    assert B.decoded_many(B.Scheme("BAD", 1, fail), [b"a", b"cd", b"a"], 2, []) == [None, b"cd", None]


def test_huffman_codes_of_few_and_many_words():
    rng = np.random.default_rng(4)
    for words in (np.full(64, 7), rng.integers(0, 3, 2000), rng.integers(0, 65536, 5000), np.repeat(rng.integers(0, 65536, 9), 700)):
        words = words.astype(np.uint16)
        assert piz.unhuffed(writer._huffed(words), len(words)).tolist() == words.tolist()


def test_lines_of_a_file_are_run_length_coded_at_once(monkeypatch):
    calls = []
    one = writer._runs_rows
    monkeypatch.setattr(writer, "_runs_rows", lambda rows: calls.append(len(rows)) or one(rows))
    rng = np.random.default_rng(5)
    for step in (1, 3, 200):
        planes = [np.repeat(rng.integers(0, 99, (21, 300)), step, 1)[:, :300].astype(t) for t in ("<f2", "<f4", "<u4")]
        each = [writer.coded([p[y : y + 1] for p in planes], [HALF, FLOAT, UINT], ["A", "B", "C"], c) for c in (1, 2) for y in range(21)]
        calls.clear()
        at_once = [p for c in (1, 2) for _, p in writer._chunks(planes, [HALF, FLOAT, UINT], ["A", "B", "C"], c, 21)]
        assert at_once == each and calls == [21]
    bare = [bytes(range(200)), bytes(300) + b"ab", b"", b"aabbb", b"x" * 129, b"ab" * 127 + b"c" * 128 + b"d"]
    for raw in bare:
        assert B.run_lengths(writer._runs(raw), len(raw)) == raw
    assert writer._runs(b"aabbbc") == b"\xfeaa\x02b\xffc"


def test_chunks_of_a_batch_are_undone_at_once(monkeypatch):
    rng = np.random.default_rng(6)
    raw = [np.repeat(rng.integers(0, 256, 190), rng.integers(1, 9, 190)).astype(np.uint8)[:190].tobytes() for _ in range(100)]
    for number, code in ((1, writer._runs), (2, zlib.compress)):
        payloads = [p for r in raw for p in (code(r), code(r)[:-1], code(r + b"x"), b"", b"\x05", b"\xf0ab")]
        want = []
        for p in payloads:
            try:
                want.append(B.decoded(B.SCHEMES[number], p, 190, []))
            except B.ExrError:
                want.append(None)
        assert sum(w is not None for w in want) >= 100
        with monkeypatch.context() as m:
            m.setattr(B, "decoded", lambda *a: pytest.fail("a chunk by itself"))
            assert B.decoded_many(B.SCHEMES[number], payloads, 190, []) == want


def test_rows_of_a_task_share_files_across_batches(spark):
    values = F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda i: (i + F.col("id") % 3).cast("double"))  # 80 KB a row, 50 rows a batch
    files = writer.made(spark.range(0, 800, 1, 1), writer.image_name("id"), [values], lambda v: os.urandom(8))
    found = files.select("content", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(found) <= 3 * len({r.task for r in found})


@pytest.mark.parametrize("flat", [False, True])
def test_block_chunks_of_a_batch_are_undone_at_once(monkeypatch, flat):
    rng = np.random.default_rng(7)
    for kinds, width, rows in (([HALF], 8, 8), ([HALF, FLOAT, HALF], 7, 5)):
        planes = [B.Plane(k, n, width, tuple(range(rows)), str(n)) for n, k in enumerate(kinds)]
        expected = sum(rows * p.width * p.size for p in planes)
        payloads = []
        for n in range(60):
            own = [(1 + rng.integers(0, 1 + n % 3, (rows, width)) / 1024).astype("<f2" if k == HALF else "<f4") for k in kinds]
            code = writer._b44(own, kinds, flat)
            payloads += [code, code[:-1], code[:5], code + b"xy", b"", bytes(rng.integers(0, 256, expected + 1, np.uint8))]
        want = []
        for p in payloads:
            try:
                want.append(B.decoded(B.SCHEMES[7], p, expected, planes))
            except B.ExrError:
                want.append(None)
        assert sum(w is None for w in want) >= 60 and sum(w is not None for w in want) >= 120
        with monkeypatch.context() as m:
            m.setattr(B, "b44", lambda *a: pytest.fail("a chunk by itself"))
            assert B.b44_many(payloads, expected, planes) == want
            some = [p for p in payloads if len(p) != expected]
            assert B.decoded_many(B.SCHEMES[7], some, expected, planes) == [w for p, w in zip(payloads, want, strict=True) if len(p) != expected]


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    spark.range(0, 40000, 1, 1).withColumn("v", F.rand(1)).write.parquet(f"{tmp_path}/t")  # read in several partitions, of which one has all rows
    with_small = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "6"}
    before = {k: spark.conf.get(k, None) for k in with_small}
    for k, v in with_small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 4 and rows.select(F.spark_partition_id()).distinct().count() == 1
        counts = [r["count"] for r in writer.made(rows, writer.image_name("id"), [F.col("id")], lambda i: b"x").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(counts) >= 4 and max(counts) < 15000


def test_broken_files_of_a_batch_go_out_together(spark):
    planes = [np.arange(6 * 5).reshape(6, 5).astype("<f4")]
    good, two = encoded(planes, [FLOAT], ["Y"], 0), multipart([(planes, [FLOAT], ["H"], 3), (planes, [FLOAT], ["F"], 0)], [0, 0])
    table_at = len(good) - 6 * 36
    late, far = bytearray(good), bytearray(good)
    late[-28 - 8 : -28 - 4] = b"\1\0\0\0"  # the last chunk says that it is line 1
    far[table_at : table_at + 8] = b"\xff" * 8
    files = [good, good[:-1], bytes(late), bytes(far), two, two[:-3], good[: table_at + 5]] * 40
    df = spark.createDataFrame([(f"f{i}.exr", len(c), bytearray(c)) for i, c in enumerate(files)], "path string, length long, content binary").coalesce(1)
    batch = exr._plan_rows(exr.structure(df), None).toArrow().combine_chunks().to_batches()[0]
    out = list(exr._chunker(iter([batch])))
    assert len(out) <= 4
    want, told = [], []
    for p in batch.to_pylist():
        if p["part_code"]:
            told.append((p["path"], p["part_id"], None))
            continue
        found = S.heads(S.Memory(p["content"]), p["table_at"], p["n_chunks"], p["multi"], p["part_id"])
        spans = S.kept_spans(found, p["part_id"], p["y_min"], p["lines_per"])
        each = []
        for k in range(p["n_chunks"]):
            s, f = bool(found.safe[k]), bool(found.fits[k])
            own, y, size = (int(v[k]) if s else None for v in (found.own, found.y, found.size))
            each.append((k, own if p["multi"] else None, y, size, found.code(k)))
            kept = None if spans is None else [{"lo": lo, "hi": hi} for lo, hi in spans.get(k, [])]
            want.append((p["path"], p["part_id"], k, int(found.at[k]) if found.known[k] else None, own, y, size, bytes(p["content"][found.place(k) :][:size]) if f else None, kept, found.code(k)))
        told.append((p["path"], p["part_id"], each))
    columns = ["path", "part_id", *exr._CHUNK_COLUMNS]
    got = [tuple(r[c] for c in columns) for b in out for r in b.to_pylist() if r["chunk_index"] is not None]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[-1] for r in got}) == 3
    heads = [(r["path"], r["part_id"], None if r["k"] is None else [tuple(k.values()) for k in r["k"]]) for b in exr._header(iter([batch])) for r in b.to_pylist()]
    assert heads == told


def test_parts_and_channels_come_of_one_walk(spark, sf_dir):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES["exr_multipart_structure"](spark, sf_dir)._jdf.queryExecution(), "simple")
    assert plan.count("write(") == 1 and "Join" not in plan
