"""Image files: containers, schemes, errors, through real files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanweave.sources import blocks as B
from scanweave.sources import exr, writer
from scanweave.sources import header as H
from scanweave.sources.writer import encoded

UINT_ONE = np.uint32(0xFFFFFFFF)


def decode(spark, content, **options):
    files = spark.createDataFrame([("a.exr", len(content), bytearray(content))], "path string, length long, content binary")
    s = exr.structure(files)
    return s, exr.scanlines(exr.chunks(s), **options)


def values(lines):
    return {(r.channel, r.sampled_row): list(r["values"]) for r in lines.collect() if r.code is None}


def codes(spark, content):
    s, lines = decode(spark, content)
    return {r.code for r in exr.errors(s, lines).collect()}


@pytest.mark.parametrize("scheme", [0, 1, 2, 3])
def test_kinds_of_samples(spark, scheme):
    h = np.array([[0, 1], [1, 0]], "<f2")
    f = np.array([[0.25, 1.25], [10.25, 11.25]], "<f4")
    u = np.array([[UINT_ONE, 0], [0, UINT_ONE]], "<u4")
    got = values(decode(spark, encoded([f, h, u], [2, 1, 0], ["F", "H", "U"], scheme))[1])
    assert got == {("F", 0): [0.25, 1.25], ("F", 1): [10.25, 11.25], ("H", 0): [0, 1], ("H", 1): [1, 0], ("U", 0): [1, 0], ("U", 1): [0, 1]}


def test_pxr24_keeps_24_bits_of_floats(spark):
    f = np.linspace(-3, 700, 64).astype("<f4").reshape(2, 32)
    got = values(decode(spark, encoded([f], [2], ["F"], 5))[1])
    want = (f.view("<u4") & 0xFFFFFF00).view("<f4")
    assert [got["F", y] for y in range(2)] == want.tolist()


@pytest.mark.parametrize("distinct", [1, 40, 30_000])
@pytest.mark.parametrize("shape", [(1, 300), (7, 5), (32, 33), (150, 131)])
def test_piz_gives_back_all_words(shape, distinct):
    rng = np.random.default_rng(distinct)
    h = rng.integers(0, distinct, shape).astype("<u2").view("<f2")
    f = (rng.integers(0, distinct, shape).astype("<u4") * 65_537).view("<f4")
    planes = [B.Plane(B.HALF, 0, shape[1], tuple(range(shape[0]))), B.Plane(B.FLOAT, 0, shape[1], tuple(range(shape[0])))]
    raw = b"".join(h[y].tobytes() + f[y].tobytes() for y in range(shape[0]))
    coded = writer._piz([[h[y], f[y]] for y in range(shape[0])], [B.HALF, B.FLOAT])
    assert B.piz(coded, len(raw), planes) == raw
    with pytest.raises(H.ExrError, match="DECOMPRESSION_FAILED|PIZ"):
        B.decoded(B.SCHEMES[4], coded[: len(coded) // 2], len(raw), planes)


def plane_of(kind, name, rows, width):
    return B.Plane(kind, 0, width, tuple(range(rows)), name)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("mode", [0, 1])
@pytest.mark.parametrize("shape", [(8, 8), (7, 5), (32, 19), (20, 33)])
def test_transform_scheme(shape, version, mode):
    """Colour triple, a channel by itself, and alpha as runs; lossy channels come back within their halves' rounding."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    planes = [(x // 3 % 2).astype("<f4"), (0.1 + 0 * x).astype("<f2"), (1.5 + 0.05 * y).astype("<f4"), (0.3 + 0.02 * x + 0.01 * y).astype("<f2"), (2 + np.sin(x / 5)).astype("<f2")]
    kinds, names = [2, 1, 2, 1, 1], ["A", "B", "G", "R", "depth.Y"]
    lines = [[p[i] for p in planes] for i in range(shape[0])]
    raw = b"".join(v.tobytes() for line in lines for v in line)
    coded = writer._dwa(lines, kinds, names, version, mode)
    own = [plane_of(k, n, *shape) for k, n in zip(kinds, names, strict=True)]
    got, at = B.dwa(coded, len(raw), own), 0
    assert len(got) == len(raw)
    for i in range(shape[0]):
        for p in planes:
            v = np.frombuffer(got, p.dtype, shape[1], at)
            at += v.nbytes
            assert np.abs(v.astype(float) - p[i]).max() <= (0 if p is planes[0] else 0.004)
    for bad in (coded[:50], coded[:-5], b"\3" + coded[1:]):
        with pytest.raises(H.ExrError, match="DECOMPRESSION_FAILED"):
            B.decoded(B.SCHEMES[8], bad, len(raw), own)
    with pytest.raises(H.ExrError, match="scheme for channel"):
        B.decoded(B.SCHEMES[8], writer._dwa([[p[3]] for p in lines], [1], ["R"], version, mode), 10**6, [plane_of(1, "Z", *shape)])
    with pytest.raises(H.ExrError, match="subsampled"):
        B.decoded(B.SCHEMES[8], coded, len(raw), [B.Plane(1, 0, 4, (0,), "R", False)])


def test_steps_of_coefficients():
    """A mark ends a block, a skip leaves zeros, and 63 coefficients end a block without a mark."""
    from scanweave.sources import dwa

    ac = np.array([5, 0xFF03, 6, 0xFF00, *range(1, 64), 0xFF3E, 9, 0xFF00], np.uint16)
    got, at = dwa.coefficients(ac, 0, np.array([1, 2, 3, 4], np.uint16))
    want = np.zeros((4, 64), int)
    want[:, 0] = 1, 2, 3, 4
    want[0, [1, 5]] = 5, 6
    want[1, 1:] = range(1, 64)
    want[2, 63] = 9
    assert got.tolist() == want.tolist() and at == len(ac)
    with pytest.raises(ValueError, match="cut short"):
        dwa.coefficients(ac[:-1], 67, np.array([1, 2], np.uint16))


def test_codes_longer_than_the_table():
    """Lengths that grow by one: codes of more than 16 bits are searched for by length."""
    from scanweave.sources import piz

    n = 25
    words = np.repeat(np.arange(n), [2**min(i, 14) for i in range(n)]).astype(np.uint16)
    np.random.default_rng(1).shuffle(words)
    assert piz.unhuffed(writer._huffed(words), len(words)).tolist() == words.tolist()
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    lengths = writer._code_lengths(dict(enumerate(fib)))
    assert max(lengths.values()) > piz.LOOK
    words = np.concatenate([np.repeat(np.arange(24), [min(f, 300) for f in fib])[::-1], [0, 1, 2]]).astype(np.uint16)
    one = writer._code_lengths
    try:
        writer._code_lengths = lambda counts: one({s: fib[s] if s < 24 else 1 for s in counts})
        assert piz.unhuffed(writer._huffed(words), len(words)).tolist() == words.tolist()
    finally:
        writer._code_lengths = one


def test_lines_given_twice(spark):
    """The later of two chunks of one line counts, also off the usual grid."""
    good = bytearray(encoded([np.array([[1, 1], [2, 2], [3, 3]], "<f4")], [2], ["R"], 0))
    at = len(good) - 3 * 16
    good[at + 16 : at + 20] = (0).to_bytes(4, "little")  # the second chunk says that it is line 0
    assert values(decode(spark, bytes(good))[1]) == {("R", 0): [2, 2], ("R", 2): [3, 3]}
    s, lines = decode(spark, bytes(good))
    assert {(r.x, r.y): r.value for r in exr.expanded_pixels(exr.full_lines(s)).collect()}[0, 1] == 0


def test_long_headers_are_walked_whole(spark, monkeypatch):
    monkeypatch.setattr(exr, "HEADER_BYTES", 40)
    assert values(decode(spark, encoded([np.ones((1, 2), "<f4")], [2], ["R"], 3))[1]) == {("R", 0): [1, 1]}
    assert codes(spark, b"abc") == {"BUFFER_TOO_SMALL"}


@pytest.mark.parametrize(("scheme", "value"), [(6, 1.0), (7, 0.5)])
def test_b44_flat_blocks(spark, scheme, value):
    h, f = np.full((6, 5), value, "<f2"), np.arange(30, dtype="<f4").reshape(6, 5)
    got = values(decode(spark, encoded([f, h], [2, 1], ["F", "H"], scheme))[1])
    assert [got["H", y] for y in range(6)] == h.tolist()
    assert [got["F", y] for y in range(6)] == f.tolist()


def test_b44_block_of_14_bytes():
    block = np.frombuffer(bytes.fromhex("BC000208208208208208208208 20".replace(" ", "")), np.uint8)[None]
    assert B._b44_blocks(block).tolist() == [[0x3C00] * 16]


def test_run_lengths():
    assert B.run_lengths(bytes([2, 97, 254, 98, 99]), 5) == b"aaabc"
    assert B._unpredicted(np.array([10, 130, 120, 128], np.uint8)) == bytes([10, 4, 12, 4])


def test_subsampled_channel(spark):
    s = np.array([[0, 2], [20, 22]], "<f4")
    files, lines = decode(spark, encoded([s], [2], ["S"], 0, sampling=2, size=(4, 4)))
    assert values(lines) == {("S", 0): [0, 2], ("S", 1): [20, 22]}
    full = {(r.x, r.y): r.value for r in exr.expanded_pixels(exr.full_lines(files)).collect()}
    assert len(full) == 16
    assert (full[0, 0], full[1, 0], full[3, 3], full[2, 1]) == (0, 2, 22, 22)


def test_chunks_of_17_lines(spark):
    f = np.arange(17, dtype="<f4")[:, None]
    s, lines = decode(spark, encoded([f], [2], ["R"], 3))
    assert exr.chunks(s).count() == 2
    assert sorted(values(lines).values()) == f.tolist()


def test_channels_to_keep(spark):
    p = np.ones((2, 2), "<f4")
    assert {c for c, _ in values(decode(spark, encoded([p, p], [2, 2], ["A", "B"], 3), names=["B"])[1])} == {"B"}


def test_errors(spark):
    good = encoded([np.array([[0.5, 1]], "<f4")], [2], ["R"], 0)
    assert codes(spark, good) == set()
    assert codes(spark, good[:5]) == {"BUFFER_TOO_SMALL"}
    assert codes(spark, b"x" + good[1:]) == {"INVALID_MAGIC"}
    assert codes(spark, good[:40]) == {"TRUNCATED_FILE"}
    assert codes(spark, good[:-1]) == {"MALFORMED_CHUNK"}
    assert codes(spark, encoded([np.ones((1, 1), "<f4")], [2], ["R"], 10)) == {"UNSUPPORTED_COMPRESSION"}


def test_broken_payload(spark):
    data = bytearray(encoded([np.zeros((2, 64), "<f4")], [2], ["R"], 2))
    at = data.index(b"\x78", data.index(b"lineOrder"))
    data[at : at + 2] = b"\0\0"
    assert codes(spark, bytes(data)) == {"DECOMPRESSION_FAILED"}


@pytest.mark.parametrize(("kind", "size"), [("compression", 2), ("box2i", 15), ("int", 3), ("float", 3)])
def test_sizes_of_attributes(kind, size):
    extra = b"x\0" + kind.encode() + b"\0" + size.to_bytes(4, "little") + bytes(size)
    with pytest.raises(H.ExrError) as e:
        H.parse(encoded([np.ones((1, 1), "<f4")], [2], ["R"], 0, extra=extra))
    assert e.value.code == "MALFORMED_HEADER"


def test_unknown_attribute():
    extra = b"mystery\0opaqueType\0" + (4).to_bytes(4, "little") + b"abcd"
    part = H.parse(encoded([np.ones((1, 1), "<f4")], [2], ["R"], 0, extra=extra))["parts"][0]
    assert part["attributes"]["mystery"]["s"] == "<opaqueType data>"


def test_failfast(spark):
    files = spark.createDataFrame([("a.exr", 3, bytearray(b"abc"))], "path string, length long, content binary")
    with pytest.raises(Exception, match="BUFFER_TOO_SMALL"):
        exr.structure(files, "FAILFAST").select("path").collect()


def test_files_on_disk_and_stream(spark, tmp_path):
    from scanweave.operators import catalog as K
    from scanweave.streaming.frames import arriving, live_sources

    for i in (1, 2, 10):
        (tmp_path / f"shot.{i:04d}.exr").write_bytes(encoded([np.full((2, 2), i, "<f4")], [2], ["R"], 3))
    (tmp_path / "notes.txt").write_text("x")
    files = exr.read(spark, str(tmp_path))
    assert files.count() == 3
    px = exr.sampled_pixels(exr.scanlines(exr.chunks(exr.structure(files))))
    assert {r.value for r in px.collect()} == {1, 2, 10}
    source = K.sources(K.described(files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path")))).collect()
    assert [(r.frames, r.label) for r in source] == [(3, "shot..[0001-0010].exr")]
    q = live_sources(arriving(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.frames, r.last_frame) for r in spark.table("live").collect()] == [(3, 10)]
