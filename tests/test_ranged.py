"""Linear scans, files read by offset, the manifest, and lines as arrays."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.functions.pixels import half_bits as column_half_bits
from scanweave.sources import blocks as B
from scanweave.sources import exr, ranged
from scanweave.sources import scan as S
from scanweave.sources.halves import half_bits
from scanweave.sources.writer import encoded, multipart


def one(spark, content, path="a.exr"):
    return exr.structure(spark.createDataFrame([(path, len(content), bytearray(content))], "path string, length long, content binary"))


def big(lines, width=4096):
    return encoded([np.tile(np.arange(lines, dtype="<f4")[:, None], (1, width))], [B.FLOAT], ["Y"], 0)


def timed(spark, n):
    s = one(spark, big(n)).cache()
    assert s.count() == 1
    began = time.time()
    assert exr.scanlines(exr.chunks(s)).filter("values[0] = y AND code IS NULL").count() == n
    s.unpersist()
    return time.time() - began


def test_scan_is_linear_in_the_file(spark):
    timed(spark, 64)  # workers start
    small, large = timed(spark, 512), timed(spark, 1024)
    assert large < 5 and large < 3 * small + 1


def test_sweep_equals_brute_force():
    rng = np.random.default_rng(2)
    for n, lines, span in ((1, 4, 10), (40, 1, 12), (60, 7, 90), (300, 16, 200)):
        ys = rng.integers(-span, span, n).tolist()
        got = S.last_writers(ys, lines)
        for y in range(-span - 1, span + lines + 1):
            owners = [i for i, lo in enumerate(ys) if lo <= y < lo + lines]
            held = [i for i, spans in enumerate(got) if any(a <= y < b for a, b in spans)]
            assert held == owners[-1:]


def test_sweep_of_many_chunks_is_quick():
    ys = np.random.default_rng(1).integers(0, 100_000, 10_000).tolist()
    began = time.time()
    got = S.last_writers(ys, 16)
    assert time.time() - began < 2 and sum(b - a for spans in got for a, b in spans) == len({y + i for y in ys for i in range(16)})


def test_off_grid_chunks_in_a_file(spark):
    """Ten thousand chunks of one line, whose lines are given in pairs: the later one's values count, and half the window is missing."""
    n = 10_000
    data = bytearray(encoded([np.arange(n, dtype="<f4")[:, None]], [B.FLOAT], ["Y"], 0))
    at = len(data) - 12 * n
    for i in range(n):
        data[at + 12 * i : at + 12 * i + 4] = (i // 2).to_bytes(4, "little")
    began = time.time()
    lines = exr.scanlines(exr.chunks(one(spark, bytes(data)))).collect()
    assert time.time() - began < 15
    assert sorted((r.y, r["values"][0]) for r in lines) == [(y, 2 * y + 1.0) for y in range(n // 2)]
    full = exr.full_lines(one(spark, bytes(data)))
    assert full.count() == n and full.filter("values[0] = 0").count() == n // 2


def pixel(planes, names, w, samplings, x, y, name):
    i = names.index(name)
    s = samplings[i]
    near = lambda at, n: min(max(int(np.floor(at / s + 0.5)), 0), n - 1)
    p = planes[i]
    return float(p[near(y, p.shape[0]), near(x, p.shape[1])])


@pytest.mark.parametrize("size", [(4, 4), (7, 5), (17, 9), (33, 6)])
@pytest.mark.parametrize("scheme", [0, 3])
def test_full_lines_of_subsampled_channels(spark, size, scheme):
    h, w = size
    s = 3
    planes = [np.random.default_rng(h).random((-(-h // s), -(-w // s))).astype("<f4")]
    full = exr.full_lines(one(spark, encoded(planes, [B.FLOAT], ["S"], scheme, sampling=s, size=size)))
    got = {(r.y, r.x): r.value for r in exr.expanded_pixels(full).collect()}
    assert got == {(y, x): pixel(planes, ["S"], None, [s], x, y, "S") for y in range(h) for x in range(w)}
    plan = full._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_missing_and_broken_chunks_give_zeros(spark):
    p = np.arange(1, 41, dtype="<f4").reshape(40, 1)
    data = bytearray(encoded([p], [B.FLOAT], ["Y"], 0))
    at = len(data) - 12 * 40
    data[at + 12 * 3 + 4 : at + 12 * 3 + 8] = (99_999).to_bytes(4, "little")  # chunk 3 runs past the end
    table = at - 8 * 40
    data[table + 8 * 5 : table + 8 * 5 + 8] = (1 << 54).to_bytes(8, "little")  # chunk 5 has an offset beyond 2**53 - 1
    s = one(spark, bytes(data))
    got = {r.y: r["values"][0] for r in exr.full_lines(s).collect()}
    assert got == {y: 0.0 if y in (3, 5) else y + 1.0 for y in range(40)}
    assert {(r.chunk_index, r.code) for r in exr.chunks(s).filter("code IS NOT NULL").collect()} == {(3, "MALFORMED_CHUNK"), (5, "MALFORMED_OFFSET_TABLE")}


def test_colour_lines(spark):
    y, x = np.mgrid[:18, :5]
    planes = [(x + 10 * y + k).astype("<f4") for k in range(3)]
    s = one(spark, encoded(planes, [B.FLOAT] * 3, ["B", "G", "R"], 3))
    rows = exr.colour_lines(s).collect()
    assert len(rows) == 18 and all(r.a is None for r in rows)
    assert {r.y: (r.r, r.g, r.b) for r in rows} == {i: tuple(planes[k][i].tolist() for k in (2, 1, 0)) for i in range(18)}
    sub = one(spark, encoded([p[::2, ::2] for p in planes], [B.FLOAT] * 3, ["B", "G", "R"], 3, sampling=2, size=(18, 5)))
    with pytest.raises(Exception, match="skips lines"):
        exr.colour_lines(sub).collect()
    got = {r.y: r.g for r in exr.colour_lines(sub, merged=True).collect()}
    assert got == {i: [pixel([planes[1][::2, ::2]], ["G"], None, [2], j, i, "G") for j in range(5)] for i in range(18)}


def test_half_rounding_of_arrays_and_columns(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([[0.0, 1.99999, 3.9999, 0.49999, 65504.0, 65520.0, 65536.0, 1e9, 2.0**-14, 2.0**-15, 2.0**-24, 2.0**-25, 2.0**-26, 6.1e-5, float("inf")], rng.normal(size=500), rng.normal(size=300) * 1e-6, rng.normal(size=300) * 3e4]).astype(np.float32)
    v = np.concatenate([v, -v])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for compat in (False, True):
        want = [r[0] for r in df.select(column_half_bits(F.col("v"), compat)).collect()]
        assert half_bits(v, compat).tolist() == want
    assert half_bits(np.array([1.99999]), True)[0] == 0x3C00 and half_bits(np.array([1.99999]))[0] == 0x4000
    assert half_bits(np.array([np.nan]), True)[0] == 0x7E00


def test_compat_rounding_through_scanlines(spark):
    """A flat plane of the transform scheme whose value rounds up to a power of two: with the option the carry is lost."""
    plane = np.full((8, 8), 1.99999, "<f4")
    s = one(spark, encoded([plane], [B.FLOAT], ["Y"], 8))
    at = lambda **o: {r["values"][0] for r in exr.scanlines(exr.chunks(s), **o).collect()}
    from scanweave.sources import dwa

    assert {v.view("<u2") for v in dwa.laid_out(np.full((1, 8, 8), 1 + np.log(1.99999) / np.log(dwa.BASE)), 8, 8, True).ravel()} == {0x3C00}
    assert {v.view("<u2") for v in dwa.laid_out(np.full((1, 8, 8), 1 + np.log(1.99999) / np.log(dwa.BASE)), 8, 8).ravel()} == {0x4000}
    plain, compat = at(), at(compat=True)
    assert len(plain) == len(compat) == 1 and abs(plain.pop() - 2) < 0.004


def test_a_rule_with_a_fourth_index_keeps_the_triple():
    from scanweave.sources import dwa

    rules = [("R", dwa.LOSSY, 0, 1, False), ("G", dwa.LOSSY, 1, 1, False), ("B", dwa.LOSSY, 2, 1, False), ("Z", dwa.LOSSY, 3, 1, False)]
    _, triple = dwa.matched(["B", "G", "R", "Z"], [1] * 4, rules)
    assert {0, 1, 2} <= set(triple)


def test_linear_channels_and_floats_in_blocks(spark):
    """A channel marked as linear goes through the log table, a FLOAT beside it stands raw."""
    h, f = np.full((4, 4), 1.0, "<f2"), np.arange(16, dtype="<f4").reshape(4, 4)
    data = bytearray(encoded([f, h], [B.FLOAT, B.HALF], ["F", "H"], 6))
    at = data.index(b"H\0\x01\0\0\0") + 6
    data[at] = 1
    lines = {(r.channel, r.y): list(r["values"]) for r in exr.scanlines(exr.chunks(one(spark, bytes(data)))).collect()}
    assert lines["H", 0] == [0.0] * 4 and [lines["F", y] for y in range(4)] == f.tolist()  # 8 * ln(1)


def test_registered_scheme(spark):
    before = dict(B.SCHEMES)
    try:
        B.register(77, "TURNED", 1, lambda payload, expected, planes: payload[:0:-1])
        data = bytearray(encoded([np.array([[1, 2]], "<f4")], [B.FLOAT], ["Y"], 0))
        at = data.index(b"compression\0compression\0") + 28
        data[at] = 77
        raw = bytes(data[-8:])[::-1]
        data = data[:-12] + (9).to_bytes(4, "little") + b"x" + raw
        assert [list(r["values"]) for r in exr.scanlines(exr.chunks(one(spark, bytes(data)))).collect()] == [[1, 2]]
    finally:
        B.SCHEMES.clear()
        B.SCHEMES.update(before)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of several schemes, of two parts, broken ones, and others."""
    at = tmp_path_factory.mktemp("images")
    y, x = np.mgrid[:70, :40]
    for scheme in (0, 1, 2, 3, 4, 5):
        (at / f"s{scheme}.exr").write_bytes(encoded([(x // 3 + y).astype("<f4"), (x + y).astype("<f2")], [B.FLOAT, B.HALF], ["A", "Y"], scheme))
    (at / "deep").mkdir()
    (at / "deep" / "two.EXR").write_bytes(multipart([([(x + y).astype("<f2")], [B.HALF], ["H"], 3), ([(x * y).astype("<f4")], [B.FLOAT], ["F"], 1)]))
    (at / "short.exr").write_bytes((at / "s0.exr").read_bytes()[:-200])
    (at / "other.exr").write_bytes(b"not an image at all")
    (at / "tiny.exr").write_bytes(b"v/1")
    (at / "notes.txt").write_text("x")
    return at


def in_memory(spark, folder):
    s = exr.structure(exr.read(spark, str(folder)))
    whole = s.filter("s.error IS NOT NULL").select("path", F.lit(None).cast("int").alias("part_id"), F.lit(None).cast("string").alias("channel"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("sampled_row"), F.lit(None).cast("array<float>").alias("values"), F.lit(None).cast("int").alias("chunk_index"), "s.error.code")
    return exr.scanlines(exr.chunks(s)).unionByName(whole)


def sorted_rows(r):
    return sorted(r, key=repr)


@pytest.mark.parametrize("size", ["1000", str(1 << 30)])
def test_data_source_equals_whole_contents(spark, folder, size):
    ranged.register(spark)
    own = spark.read.format("exr_lines").option("partitionBytes", size).load(str(folder))
    assert sorted_rows(safe(own)) == sorted_rows(safe(in_memory(spark, folder)))


def safe(lines):
    return [(r.path.rpartition("/")[2], r.part_id, r.channel, r.y, r.sampled_row, tuple(r["values"] or ()), r.chunk_index, r.code) for r in lines.collect()]


def test_filters_reach_the_data_source(spark, folder):
    ranged.register(spark)
    whole = safe(in_memory(spark, folder))
    own = spark.read.format("exr_lines").load(str(folder)).filter("part_id = 0 AND channel IN ('A', 'H') AND y >= 20 AND y < 24")
    plan = spark._jvm.PythonSQLUtils.explainString(own._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(y,20)" in plan, plan[-1500:]
    assert sorted_rows(safe(own)) == sorted_rows([r for r in whole if r[1] == 0 and r[2] in ("A", "H") and r[3] is not None and 20 <= r[3] < 24])
    reader = ranged.LinesReader({"path": str(folder / "s0.exr")})
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThanOrEqual

    left = list(reader.pushFilters([EqualTo(("part_id",), 0), GreaterThan(("y",), 9), LessThanOrEqual(("y",), 12), IsNotNull(("y",))]))
    assert left == [IsNotNull(("y",))] and (reader.wanted.low, reader.wanted.high) == (10, 12)


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file whose last chunks lie beyond 2 GB: they are read by offset."""
    p = np.arange(64, dtype="<f4").reshape(8, 8)
    data = encoded([p], [B.FLOAT], ["Y"], 0)
    at = len(data) - 8 * 40
    far = 3 << 30
    table = np.frombuffer(data[at - 64 : at], "<u8").copy()
    table[4:] += far
    path = tmp_path / "huge.exr"
    with open(path, "wb") as f:
        f.write(data[: at - 64] + table.tobytes() + data[at : at + 160])
        f.seek(at + 160 + far)
        f.write(data[at + 160 :])
    ranged.register(spark)
    got = spark.read.format("exr_lines").option("partitionBytes", str(1 << 30)).load(str(path)).collect()
    assert sorted((r.y, *r["values"]) for r in got) == [(y, *p[y].tolist()) for y in range(8)]
    m = ranged.manifest(ranged.listed(spark, str(path)))
    assert sorted((r.y, *r["values"]) for r in ranged.lines_between(m, 3, 5).collect()) == [(y, *p[y].tolist()) for y in (3, 4, 5)]


def test_manifest_equals_the_scan_and_skips(spark, folder, tmp_path):
    m = ranged.refreshed(spark, str(folder), str(tmp_path / "m")).cache()
    assert sorted_rows(safe(exr.scanlines(ranged.fetched(m.filter("code IS NULL OR part_id IS NOT NULL"))))) == sorted_rows([r for r in safe(in_memory(spark, folder)) if r[1] is not None])
    assert {r.code for r in m.filter("part_id IS NULL").collect()} == {"BUFFER_TOO_SMALL", "INVALID_MAGIC"}
    near = ranged.meeting(m, 33, 42).cache()
    read = ranged.fetched(near, gap=0).agg(F.sum("read_bytes"), F.sum(F.length("payload"))).first()
    assert read[0] == read[1] == near.agg(F.sum("data_size")).first()[0] < m.agg(F.sum("data_size")).first()[0] / 2
    got = safe(ranged.lines_between(m, 33, 42))
    whole = [r for r in safe(in_memory(spark, folder)) if r[3] is not None and 33 <= r[3] <= 42]
    assert sorted_rows(got) == sorted_rows(whole)


def test_manifest_is_kept_up(spark, tmp_path):
    images, at = tmp_path / "i", str(tmp_path / "m")
    images.mkdir()
    make = lambda v, h=2: encoded([np.full((h, 2), v, "<f4")], [B.FLOAT], ["Y"], 0)
    for n in range(3):
        (images / f"{n}.exr").write_bytes(make(n))
    first = ranged.refreshed(spark, str(images), at)
    assert first.count() == 6
    (images / "0.exr").unlink()
    (images / "1.exr").write_bytes(make(7, 5))
    (images / "3.exr").write_bytes(make(3))
    second = ranged.refreshed(spark, str(images), at)
    names = {(r.path.rpartition("/")[2], r.chunk_index) for r in second.collect()}
    assert names == {("1.exr", i) for i in range(5)} | {(f"{n}.exr", i) for n in (2, 3) for i in range(2)}
    assert first.count() == 6  # the version before is still there
    (tmp_path / "m" / "v2").mkdir()  # one that was not finished
    assert ranged.refreshed(spark, str(images), at).count() == 9


def test_empty_folder(spark, tmp_path):
    ranged.register(spark)
    assert spark.read.format("exr_lines").load(str(tmp_path)).count() == 0
