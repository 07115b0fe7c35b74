"""Lines as arrays, the table function, frames decoded in a stream, and natural order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.operators import catalog as K
from scanweave.operators import imaging as I
from scanweave.operators import lines as L
from scanweave.sources import exr, sqltable
from scanweave.sources.writer import encoded, multipart
from scanweave.streaming import frames


@pytest.fixture(scope="module")
def files(spark):
    rng = np.random.default_rng(4)
    out = []
    for i in range(5):
        names = ["A", "B", "G", "R"] if i % 2 else ["B", "G", "R"]
        planes = [rng.normal(0.5, 0.6, (19, 7)).astype("<f4") for _ in names]
        planes[0][0, :3] = np.nan, np.inf, -np.inf
        content = encoded(planes, [2] * len(names), names, (0, 3)[i % 2])
        out.append((f"{i}.exr", len(content), bytearray(content)))
    out.append(("bad.exr", 3, bytearray(b"abc")))
    return spark.createDataFrame(out, "path string, length long, content binary").repartition(3)


@pytest.fixture(scope="module")
def pixels(files):
    px = exr.expanded_pixels(exr.full_lines(exr.structure(files)))
    return px.groupBy("path", "part_id", "x", "y").pivot("channel", ["R", "G", "B", "A"]).agg(F.first("value")).select("path", "part_id", "x", "y", *(F.col(c).alias(c.lower()) for c in "RGBA"))


@pytest.mark.parametrize(("mode", "exposure", "gamma"), [("linear", 0.0, 2.2), ("display", 1.0, 2.2), ("display", 0.0, 0.0)])
def test_histogram_of_lines_equals_that_of_pixels(files, pixels, mode, exposure, gamma):
    lines = exr.colour_lines(exr.structure(files))
    got = {(r.path, r.bin): r.n for r in L.histogram(lines, mode, exposure, gamma, 16).collect()}
    assert len(got) == 5 * 16
    want = {(r.path, r.bin): r.n for r in I.rendered_histogram(pixels, mode, exposure, gamma, "path", bins=16).collect() if r.bin >= 0}
    assert {k: n for k, n in got.items() if n} == want
    with pytest.raises(ValueError, match="mode"):
        L.histogram(lines, "log")


@pytest.mark.parametrize(("exposure", "gamma"), [(0.0, 1.0), (1.5, 2.2)])
def test_tone_map_of_lines_equals_that_of_pixels(files, pixels, exposure, gamma):
    got = {}
    for r in L.tone_mapped(exr.colour_lines(exr.structure(files)), exposure, gamma).collect():
        for x in range(7):
            got[r.path, r.y, x] = tuple(r.rgba[4 * x : 4 * x + 4])
    px = I.tone_mapped(pixels, *(F.col(c) for c in "rgba"), exposure, gamma, "path", "y", "x")
    assert got == {(r.path, r.y, r.x): (r.r, r.g, r.b, r.a) for r in px.collect()}


def test_table_function(spark, files):
    sqltable.register(spark)
    sql = "SELECT f.path, l.* FROM {files} AS f, LATERAL exr_lines(f.content, 0, 'R,A') AS l"
    got = {(r.path, r.channel, r.y): tuple(r["values"]) if r["values"] else r.code for r in spark.sql(sql, files=files).collect()}
    want = {(r.path, r.channel, r.y): tuple(r["values"]) for r in exr.scanlines(exr.chunks(exr.structure(files)), ["R", "A"]).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in (want | {("bad.exr", None, None): "BUFFER_TOO_SMALL"}).items()}
    two = multipart([([np.ones((2, 3), "<f4")], [2], ["F"], 3), ([np.zeros((2, 3), "<f4")], [2], ["G"], 1)])
    df = spark.createDataFrame([(bytearray(two),)], "content binary")
    rows = lambda args: sorted((r.part_id, r.channel, r.y, r.code) for r in spark.sql(f"SELECT l.* FROM {{df}}, LATERAL exr_lines({args}) AS l", df=df).collect())
    assert rows("content") == [(0, "F", 0, None), (0, "F", 1, None), (1, "G", 0, None), (1, "G", 1, None)]
    assert rows("content, part => 1") == [(1, "G", 0, None), (1, "G", 1, None)]
    assert rows("content, channels => 'F'") == [(0, "F", 0, None), (0, "F", 1, None)]
    assert rows("content, 9") == [(9, None, None, "PART_NOT_FOUND")]
    assert rows("CAST(NULL AS BINARY)") == [(None, None, None, "BUFFER_TOO_SMALL")]
    with pytest.raises(Exception, match="content must be of type binary"):
        spark.sql("SELECT * FROM exr_lines('text')").collect()


def test_table_over_a_folder_in_sql(spark, tmp_path):
    sqltable.register(spark)
    (tmp_path / "a.exr").write_bytes(encoded([np.arange(6, dtype="<f4").reshape(3, 2)], [2], ["Y"], 3))
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW shots USING exr_lines OPTIONS (path '{tmp_path}')")
    assert [(r.y, list(r["values"])) for r in spark.sql("SELECT y, values FROM shots WHERE channel = 'Y' AND y > 0 ORDER BY y").collect()] == [(1, [2, 3]), (2, [4, 5])]


def test_frames_decoded_in_a_stream_once(spark, tmp_path):
    """A stream that fails after it has written a batch, and is started again, has each frame once; broken frames don't stop it."""
    folder, at, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    put = lambda i: (folder / f"shot.{i:04d}.exr").write_bytes(encoded([np.full((2, 2), i, "<f4")], [2], ["R"], 3))
    for i in range(4):
        put(i)
    (folder / "broken.exr").write_bytes(b"v/1")
    whole = encoded([np.ones((2, 2), "<f4")], [2], ["R"], 0)
    (folder / "short.exr").write_bytes(whole[:-1])
    calls = []

    def killed(number):
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost here")

    start = lambda after: frames.decoded(spark, str(folder), at, state, at_once=2, after=after).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="is lost here"):
        start(killed).awaitTermination(120)
    put(7)
    start(None).awaitTermination(120)
    got = sorted((r.path.rpartition("/")[2], r.y, r["values"][0]) for r in frames.decoded_lines(spark, at).collect())
    assert got == sorted([(f"shot.{i:04d}.exr", y, i) for i in (0, 1, 2, 3, 7) for y in range(2)] + [("short.exr", 0, 1)])
    assert {(r.path.rpartition("/")[2], r.code) for r in frames.decoded_lines(spark, at, failed=True).collect()} == {("broken.exr", "BUFFER_TOO_SMALL"), ("short.exr", "MALFORMED_CHUNK")}


def test_natural_order_with_accents_and_numbers(spark):
    names = ["zebra", "Éclair10", "eclair9", "ECLAIR 1", "éclair2", "Ångström", "angstrom1", "b", "ñ", "n2", "N10"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = [r.path for r in df.orderBy(K.natural_key(F.col("path")), "path").collect()]
    assert got == ["Ångström", "angstrom1", "b", "ECLAIR 1", "éclair2", "eclair9", "Éclair10", "ñ", "n2", "N10", "zebra"]


def test_extension_paths_and_lists(spark, tmp_path):
    one = encoded([np.ones((1, 1), "<f4")], [2], ["R"], 0)
    for folder, name in (("a", "x.exr"), ("b", "y.EXR"), ("b", "z.exr.txt"), ("c", "w.exr")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(one)
    got = exr.read(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).select("path", "length").collect()
    assert sorted((r.path.rpartition("/")[2], r.length) for r in got) == [("x.exr", len(one)), ("y.EXR", len(one))]
    df = spark.createDataFrame([("shots\\a\\x.0001.exr",), ("shots/a/x.0002.exr",)], "path string")
    assert {(r.name, r.sequence_path, r.frame_number) for r in K.described(df).collect()} == {("x.0001.exr", "shots/a/x.", 1), ("x.0002.exr", "shots/a/x.", 2)}
