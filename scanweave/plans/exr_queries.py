"""Queries over image files: embeddings and integers are encoded, scanned and decoded; the source table says what must come out."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions.pixels import half_value
from scanweave.operators import lines as L
from scanweave.plans.pixel_queries import PX
from scanweave.plans.registry import QUERIES, SQL, query, scratch, table
from scanweave.sources import exr, ranged, sqltable
from scanweave.sources.blocks import FLOAT, HALF, UINT
from scanweave.sources.writer import _attribute, encoded, image_files, image_name, made, multipart_files, saved, single_channel_files


def embedding_files(spark: SparkSession, sf_dir: str, compression: int) -> DataFrame:
    return single_channel_files(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, FLOAT, compression)


def _decoded(files: DataFrame) -> DataFrame:
    px = exr.sampled_pixels(exr.scanlines(exr.chunks(exr.structure(files))))
    return px.select("path", F.col("sx").alias("x"), F.col("sampled_row").alias("y"), F.col("value").cast("double").alias("v"))


_SAME = f"WITH {PX} SELECT 'image/' || vec_id || '.exr' AS path, x::INT AS x, y::INT AS y, v FROM px"

for _name, _number in (("none", 0), ("rle", 1), ("zips", 2), ("zip", 3)):
    query(_SAME, f"exr_roundtrip_{_name}")(lambda spark, sf_dir, n=_number: _decoded(embedding_files(spark, sf_dir, n)))

# 8 x 8 integers of each part: halves hold whole numbers up to 2048, unsigned samples are shares of 2**32 - 1
_INTS = "list_transform(range(64), lambda i: (p_partkey * 31 + i * {m}) % {k})"


def _part_files(spark: SparkSession, sf_dir: str, step: int, modulus: int, kind: int, compression: int) -> DataFrame:
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.col("p_partkey") * 31 + i * step, F.lit(modulus)))
    return single_channel_files(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", values, 8, kind, compression)


def _part_sql(value: str, step: int, modulus: int) -> str:
    return f"SELECT 'image/' || p_partkey || '.exr' AS path, (i % 8)::INT AS x, (i // 8)::INT AS y, {value.format(v=f'((p_partkey * 31 + i * {step}) % {modulus})')} AS v FROM part, range(64) AS r(i)"


@query(_part_sql("{v}::DOUBLE", 7, 2048))
def exr_roundtrip_pxr24_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(_part_files(spark, sf_dir, 7, 2048, HALF, 5))


@query(_part_sql("({v} * (1 / 4294967295::DOUBLE))::FLOAT::DOUBLE", 65537, 2**31))
def exr_roundtrip_pxr24_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(_part_files(spark, sf_dir, 65537, 2**31, UINT, 5))


@query(_part_sql("({v} + 0.0)::DOUBLE", 0, 1024))
def exr_roundtrip_piz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(_part_files(spark, sf_dir, 0, 1024, HALF, 4))


@query(_part_sql("({v} + 0.0)::DOUBLE", 0, 1024))
def exr_roundtrip_b44(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(_part_files(spark, sf_dir, 0, 1024, HALF, 6))


@query(_part_sql("({v} + 0.0)::DOUBLE", 0, 1024))
def exr_roundtrip_b44a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(_part_files(spark, sf_dir, 0, 1024, HALF, 7))


@query("SELECT 'image/' || vec_id || '.exr' AS path, 0 AS part_id, 'ZIP' AS compression, 8 AS width, 8 AS height, 1 AS channels, 'Y' AS first_channel, FALSE AS multipart FROM embeddings")
def exr_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(embedding_files(spark, sf_dir, 3)).select("path", F.col("s.is_multipart").alias("multipart"), F.explode("s.parts").alias("p"))
    w = F.col("p.data_window")
    return s.select(
        "path", "p.part_id", exr.compression_name(F.col("p.compression")).alias("compression"), (w["x_max"] - w["x_min"] + 1).alias("width"), (w["y_max"] - w["y_min"] + 1).alias("height"),
        F.size("p.channels").alias("channels"), F.get("p.channels", F.lit(0))["name"].alias("first_channel"), "multipart",
    )


@query("SELECT 'image/' || vec_id || '.exr' AS path, 0 AS part_id, y::INT AS chunk_index, y::INT AS chunk_y, 32 AS data_size, 1 AS lines, 32::BIGINT AS expected_size, TRUE AS is_raw FROM embeddings, range(8) AS r(y)")
def exr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exr.chunks(exr.structure(embedding_files(spark, sf_dir, 0))).select("path", "part_id", "chunk_index", "chunk_y", "data_size", "lines", "expected_size", "is_raw")


# Images of 19 x 33 pixels for each supplier, made to be compressed: ramps, runs and steps in three types.
WIDTH, HEIGHT = 19, 33
_K = "s_suppkey"
_H = "(x + 3 * y + {k}) // 5 % 2048"
_F = "(x // 4) * 0.25 + y + {k} % 100"
_U = "(x // 8 + y + {k}) % 4000 * 65537"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_K)


def _coded_planes() -> dict[str, Column]:
    i = F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))
    x, y, k = lambda i: F.pmod(i, F.lit(WIDTH)), lambda i: F.floor(i / WIDTH), F.col(_K)
    plane = lambda f: F.transform(i, lambda p: f(x(p), y(p)).cast("double"))
    h = plane(lambda x, y: F.pmod(F.floor((x + 3 * y + k) / 5), F.lit(2048)))
    f = plane(lambda x, y: F.floor(x / 4) * 0.25 + y + F.pmod(k, F.lit(100)))
    u = plane(lambda x, y: F.pmod(F.floor(x / 8) + y + k, F.lit(4000)) * 65537)
    return {"F": f, "H": h, "U": u}


def _coded_files(spark: SparkSession, sf_dir: str, compression: int) -> DataFrame:
    own = _coded_planes()
    return image_files(_suppliers(spark, sf_dir), _K, [("F", FLOAT, own["F"]), ("H", HALF, own["H"]), ("U", UINT, own["U"])], WIDTH, compression)


_GRID = f"px AS (SELECT s_suppkey, (i % {WIDTH})::INT AS x, (i // {WIDTH})::INT AS y FROM supplier, range({WIDTH * HEIGHT}) AS r(i))"
_CODED = f"""WITH {_GRID} SELECT 'image/' || s_suppkey || '.exr' AS path, c.channel, x, y, (CASE c.channel WHEN 'F' THEN ({_F.format(k=_K)})::DOUBLE WHEN 'H' THEN ({_H.format(k=_K)})::DOUBLE
    ELSE (({_U.format(k=_K)}) * (1 / 4294967295::DOUBLE))::FLOAT::DOUBLE END) AS v FROM px, (VALUES ('F'), ('H'), ('U')) AS c(channel)"""


def _all_channels(files: DataFrame) -> DataFrame:
    px = exr.sampled_pixels(exr.scanlines(exr.chunks(exr.structure(files))))
    return px.select("path", "channel", F.col("sx").alias("x"), F.col("sampled_row").alias("y"), F.col("value").cast("double").alias("v"))


#: Schemes that lose nothing of these values (PXR24 keeps their upper 24 bits, which is all of them).
_WHOLE = (("rle", 1), ("zips", 2), ("zip", 3), ("pxr24", 5))
for _name, _number in _WHOLE:
    query(_CODED, f"exr_coded_{_name}")(lambda spark, sf_dir, n=_number: _all_channels(_coded_files(spark, sf_dir, n)))


def _lossy_files(spark: SparkSession, sf_dir: str, compression: int) -> DataFrame:
    """For the schemes of 4 x 4 blocks and of wavelets: halves whose neighbours are less than 32 steps apart, and flat ones."""
    i = F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))
    x, y, k = lambda i: F.pmod(i, F.lit(WIDTH)), lambda i: F.floor(i / WIDTH), F.col(_K)
    step = F.transform(i, lambda p: (1 + (F.pmod(x(p), F.lit(4)) * 2 + F.pmod(y(p), F.lit(4)) * 5 + F.pmod(k, F.lit(7))) / 1024).cast("double"))
    flat = F.transform(i, lambda p: F.pmod(k, F.lit(50)).cast("double"))
    return image_files(_suppliers(spark, sf_dir), _K, [("G", HALF, flat), ("H", HALF, step)], WIDTH, compression)


_BLOCKS = f"WITH {_GRID} SELECT 'image/' || s_suppkey || '.exr' AS path, c.channel, x, y, (CASE c.channel WHEN 'G' THEN s_suppkey % 50 ELSE 1 + (x % 4 * 2 + y % 4 * 5 + s_suppkey % 7) / 1024.0 END)::DOUBLE AS v FROM px, (VALUES ('G'), ('H')) AS c(channel)"
for _name, _number in (("piz", 4), ("b44", 6), ("b44a", 7)):
    query(_BLOCKS, f"exr_coded_{_name}")(lambda spark, sf_dir, n=_number: _all_channels(_lossy_files(spark, sf_dir, n)))


# the 16-bit wavelet: 20480 values in one chunk, as half bits 0, 1, 2 ... from left to right and down
_RAMP = "CASE WHEN i < 1024 THEN i * pow(2.0, -24) ELSE (1 + i % 1024 / 1024.0) * pow(2.0, i // 1024 - 15) END"


def _wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp = F.transform(F.sequence(F.lit(0), F.lit(20479)), lambda i: half_value(i))
    return image_files(table(spark, sf_dir, "region").select("r_regionkey"), "r_regionkey", [("H", HALF, ramp)], 640, 4)


@query(f"SELECT 'image/' || r_regionkey || '.exr' AS path, 'H' AS channel, (i % 640)::INT AS x, (i // 640)::INT AS y, ({_RAMP})::DOUBLE AS v FROM region, range(20480) AS r(i)")
def exr_coded_piz_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_channels(_wide_files(spark, sf_dir))


# the transform scheme loses up to a thousandth of these values; alpha loses nothing
def _colour_files(spark: SparkSession, sf_dir: str, compression: int, version: int, mode: int) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))
    x, y, k = lambda i: F.pmod(i, F.lit(WIDTH)), lambda i: F.floor(i / WIDTH), F.pmod(F.col(_K), F.lit(20)) / 20
    plane = lambda f: F.transform(i, lambda p: f(x(p), y(p)).cast("double"))
    own = {"r": plane(lambda x, y: k + 0.25 + x / 64), "g": plane(lambda x, y: k + 0.5 + y / 64), "b": plane(lambda x, y: k + 0.125 + (x + y) / 128), "a": plane(lambda x, y: F.pmod(F.floor(x / 4) + y, F.lit(2))), "y": plane(lambda x, y: k + 1 + x / 32)}
    return image_files(_suppliers(spark, sf_dir), _K, [("A", FLOAT, own["a"]), ("B", HALF, own["b"]), ("G", FLOAT, own["g"]), ("R", HALF, own["r"]), ("depth.Y", HALF, own["y"])], WIDTH, compression, version=version, mode=mode)


_TRUE = "CASE c.channel WHEN 'R' THEN k + 0.25 + x / 64.0 WHEN 'G' THEN k + 0.5 + y / 64.0 WHEN 'B' THEN k + 0.125 + (x + y) / 128.0 WHEN 'A' THEN (x // 4 + y) % 2 ELSE k + 1 + x / 32.0 END"
_COLOURS = f"WITH {_GRID} SELECT 'image/' || s_suppkey || '.exr' AS path, c.channel, x, y, TRUE AS close, CASE c.channel WHEN 'A' THEN ((x // 4 + y) % 2)::DOUBLE END AS alpha FROM px, (VALUES ('A'), ('B'), ('G'), ('R'), ('depth.Y')) AS c(channel)"


def _close(px: DataFrame) -> DataFrame:
    x, y, k = F.col("x"), F.col("y"), F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("int"), F.lit(20)) / 20
    true = F.when(F.col("channel") == "R", k + 0.25 + x / 64).when(F.col("channel") == "G", k + 0.5 + y / 64).when(F.col("channel") == "B", k + 0.125 + (x + y) / 128).when(F.col("channel") == "A", F.pmod(F.floor(x / 4) + y, F.lit(2))).otherwise(k + 1 + x / 32)
    return px.select("path", "channel", "x", "y", (F.abs(F.col("v") - true) < 0.004).alias("close"), F.when(F.col("channel") == "A", F.col("v")).alias("alpha"))


#: Scheme, version of its rules, and mode of its AC stream (0: Huffman, 1: deflate).
_TRANSFORMS = {"dwaa": (8, 2, 1), "dwab": (9, 2, 1), "dwaa_huffman": (8, 1, 0), "dwab_huffman": (9, 1, 0)}
for _name, _how in _TRANSFORMS.items():
    query(_COLOURS, f"exr_coded_{_name}")(lambda spark, sf_dir, how=_how: _close(_all_channels(_colour_files(spark, sf_dir, *how))))


@query(
    f"SELECT scheme, (SELECT count(*) FROM supplier) * n AS chunks, 0::BIGINT AS raw FROM (VALUES ('RLE', {HEIGHT}), ('ZIPS', {HEIGHT}), ('ZIP', 2), ('PIZ', 1), ('PXR24', 2), ('B44', 1), ('B44A', 1), ('DWAA', 1), ('DWAB', 1)) AS s(scheme, n) UNION ALL SELECT 'PIZ wide', 5, 0"
)
def exr_coded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of these files, and how many of them are stored raw: none, but for the last chunk of one line that schemes of more lines leave over, which is left out."""
    sets = {n.upper(): _coded_files(spark, sf_dir, c) for n, c in _WHOLE} | {n: _lossy_files(spark, sf_dir, c) for n, c in (("PIZ", 4), ("B44", 6), ("B44A", 7))} | {n: _colour_files(spark, sf_dir, c, 2, 1) for n, c in (("DWAA", 8), ("DWAB", 9))}
    sets["PIZ wide"] = _wide_files(spark, sf_dir)
    whole = (F.col("lines") > 1) | (exr.lines_per_chunk(F.col("compression")) == 1)
    each = [exr.chunks(exr.structure(f)).filter(whole).groupBy(F.lit(n).alias("scheme")).agg(F.count("*").alias("chunks"), F.count_if(~F.coalesce(~F.col("is_raw") & F.col("code").isNull(), F.lit(False))).alias("raw")) for n, f in sets.items()]
    return reduce(DataFrame.unionByName, each)


@query(f"WITH {_GRID} SELECT 'image/' || s_suppkey || '.exr' AS path, 'RLE' AS scheme, y AS chunk_index FROM px WHERE x = 0")
def exr_compressed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = exr.compressed(exr.chunks(exr.structure(_coded_files(spark, sf_dir, 1))))
    return c.select("path", exr.compression_name(F.col("compression")).alias("scheme"), "chunk_index")


@query(f"SELECT 'image/' || s_suppkey || '.exr' AS path, 0 AS part_id, {WIDTH * HEIGHT * 10}::BIGINT AS raw_bytes, {(WIDTH * 10) * HEIGHT}::BIGINT AS read_bytes, {3 * WIDTH * HEIGHT * 4}::BIGINT AS decoded_bytes FROM supplier")
def exr_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each part: expected and read of its chunks, and of its decoded planes."""
    s = exr.structure(_coded_files(spark, sf_dir, 0))
    read = exr.chunks(s).groupBy("path", "part_id").agg(F.sum("expected_size").alias("raw_bytes"), F.sum("data_size").alias("read_bytes"))
    return read.join(exr.decoded_bytes(s), ["path", "part_id"])


# Files of two parts with schemes of their own
def _two_parts(spark: SparkSession, sf_dir: str, numbers: list[int] | None = None) -> DataFrame:
    own = _coded_planes()
    return multipart_files(_suppliers(spark, sf_dir), _K, [("H", HALF, own["H"], 3), ("F", FLOAT, own["F"], 1)], WIDTH, numbers)


@query(_CODED.replace("c.channel, x", "CASE c.channel WHEN 'H' THEN 0 ELSE 1 END AS part_id, c.channel, x").replace(", ('U')) AS c", ") AS c"))
def exr_multipart(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = exr.sampled_pixels(exr.scanlines(exr.chunks(exr.structure(_two_parts(spark, sf_dir)))))
    return px.select("path", "part_id", "channel", F.col("sx").alias("x"), F.col("sampled_row").alias("y"), F.col("value").cast("double").alias("v"))


@query(f"SELECT 'image/' || s_suppkey || '.exr' AS path, p AS part_id, p AS ordinal_part, ['H', 'F'][p + 1] AS channel, ['ZIP', 'RLE'][p + 1] AS scheme, 'part' || p AS name, {WIDTH} AS width, {HEIGHT} AS height FROM supplier, (VALUES (0), (1)) AS t(p)")
def exr_multipart_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(_two_parts(spark, sf_dir))
    p = s.select("path", F.explode("s.parts").alias("p")).select("path", "p", F.explode("p.channels").alias("c"))
    w = F.col("p.data_window")
    return p.select(
        "path", "p.part_id", F.col("p.part_id").alias("ordinal_part"), F.col("c.name").alias("channel"), exr.compression_name(F.col("p.compression")).alias("scheme"), F.element_at("p.attributes", F.lit("name"))["s"].alias("name"),
        (w["x_max"] - w["x_min"] + 1).alias("width"), (w["y_max"] - w["y_min"] + 1).alias("height"),
    )


@query(
    f"""WITH e AS (SELECT s_suppkey, seq, CASE seq WHEN 0 THEN 'decode.setup' WHEN 1 THEN 'decode.offsets.read' WHEN {HEIGHT + 2} THEN 'decode.complete' ELSE 'decode.chunk.part_mismatch' END AS code FROM supplier, range({HEIGHT + 3}) AS r(seq))
    SELECT 'image/' || s_suppkey || '.exr' AS path, 1 AS part_id, seq::INT AS seq, 'decode' AS phase, CASE WHEN code LIKE '%mismatch' THEN 'warn' ELSE 'info' END AS level, code, CASE WHEN code LIKE '%mismatch' THEN seq - 2 END::INT AS chunk_index,
    (CASE WHEN code LIKE '%mismatch' THEN 0 WHEN code LIKE '%complete' THEN 0 ELSE {HEIGHT} END)::BIGINT AS n FROM e"""
)
def exr_foreign_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second part's chunks say that they are the first one's."""
    return exr.decode_events(exr.structure(_two_parts(spark, sf_dir, [0, 0])), part_id=1)


_BROKEN = """CASE vec_id % 5 WHEN 0 THEN 'BUFFER_TOO_SMALL' WHEN 1 THEN 'INVALID_MAGIC' WHEN 2 THEN 'TRUNCATED_FILE' WHEN 3 THEN 'MALFORMED_CHUNK' END"""


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files cut short or altered in four ways, and whole ones."""
    c, kind = F.col("content"), F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.lit(5))
    cut = lambda n: F.substring(c, F.lit(1), n)
    bad = F.when(kind == 0, cut(F.lit(5))).when(kind == 1, F.concat(F.lit(b"\0"), F.substring(c, F.lit(2), F.length(c)))).when(kind == 2, cut(F.lit(60))).when(kind == 3, cut(F.length(c) - 1)).otherwise(c)
    return embedding_files(spark, sf_dir, 0).withColumn("content", bad)


@query(f"SELECT 'image/' || vec_id || '.exr' AS path, {_BROKEN} AS code FROM embeddings WHERE vec_id % 5 < 4")
def exr_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(broken_files(spark, sf_dir))
    return exr.errors(s, exr.scanlines(exr.chunks(s)))


@query(
    """SELECT 'image/' || vec_id || '.exr' AS path, seq::INT AS seq, 'parse' AS phase, 'info' AS level, (['parse.magic.ok', 'parse.version.ok', 'parse.part.ok', 'parse.complete'])[seq + 1] AS code FROM embeddings, range(4) AS r(seq) WHERE vec_id % 5 >= 3
    UNION ALL SELECT 'image/' || vec_id || '.exr', 0, 'parse', 'error', CASE WHEN vec_id % 5 = 1 THEN 'parse.magic.invalid' ELSE 'parse.error' END FROM embeddings WHERE vec_id % 5 < 3"""
)
def exr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exr.events(exr.structure(broken_files(spark, sf_dir)))


@query(f"WITH {PX} SELECT 'image/' || vec_id || '.exr' AS path, 'Y' AS channel, x::INT AS x, y::INT AS y, v FROM px")
def exr_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = exr.expanded_pixels(exr.full_lines(exr.structure(embedding_files(spark, sf_dir, 3))))
    return px.select("path", "channel", "x", "y", F.col("value").cast("double").alias("v"))


# One file of each failure, in the order in which they are looked for, and a whole one of which another part is asked for
_CODES = ("BUFFER_TOO_SMALL", "INVALID_MAGIC", "TRUNCATED_FILE", "MALFORMED_HEADER", "PART_NOT_FOUND", "UNSUPPORTED_PART_TYPE", "UNSUPPORTED_COMPRESSION", "MISSING_DATA_WINDOW", "MALFORMED_OFFSET_TABLE", "MALFORMED_CHUNK", "DECOMPRESSION_FAILED")


def _by_id(spark: SparkSession, sf_dir: str, name: str, key: str, make: Callable[[int], bytes]) -> DataFrame:
    return made(table(spark, sf_dir, name).select(key), image_name(key), [F.col(key)], make)


@lru_cache(128)
def _failing(kind: int, value: float) -> bytes:
    plane = [np.full((4, 32), value, "<f4")]
    make = lambda compression=0, extra=b"": encoded(plane, [FLOAT], ["Y"], compression, extra=extra)
    good = make()
    at = good.index(b"lineOrder\0lineOrder\0") + 26  # the end of the header
    if kind == 3:
        return make(extra=_attribute("x", "int", b"abc"))
    if kind == 5:
        return make(extra=_attribute("type", "string", b"tiledimage"))
    if kind == 6:
        return make(10)
    if kind == 7:
        return good.replace(b"dataWindow\0", b"dataWindov\0")
    if kind == 10:
        zips = make(2)
        head = struct.unpack_from("<Q", zips, at)[0] + 8
        return zips[:head] + b"\0\0" + zips[head + 2 :]
    return {0: good[:5], 1: b"\0" + good[1:], 2: good[:60], 8: good[: at + 4], 9: good[:-1]}.get(kind, good)


def failing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_id(spark, sf_dir, "embeddings", "vec_id", lambda i: _failing(i % 11, i % 7))


@query(f"SELECT 'image/' || vec_id || '.exr' AS path, ({list(_CODES)})[(vec_id % 11 + 1)::INT] AS code FROM embeddings")
def exr_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(failing_files(spark, sf_dir))
    kind = F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.lit(11))
    return exr.errors(s, exr.scanlines(exr.chunks(s, F.when(kind == 4, 7).otherwise(0))))


def trailing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files, files whose first chunk has 3 bytes more, and files that end too early."""

    def make(i: int) -> bytes:
        good = encoded([np.full((2, 4), i, "<f4")], [FLOAT], ["Y"], 0)
        first = len(good) - 48
        more = good[: first - 16] + struct.pack("<2Q", first, first + 27) + good[first : first + 4] + struct.pack("<i", 19) + good[first + 8 : first + 24] + b"abc" + good[first + 24 :]
        return (good, more, good[:-1])[int(i) % 3]

    return _by_id(spark, sf_dir, "embeddings", "vec_id", make)


@query(
    """WITH k AS (SELECT vec_id, vec_id % 3 AS kind FROM embeddings), e AS (SELECT vec_id, kind, 0 AS seq, 'decode.setup' AS code, NULL AS chunk_index, 2 AS n FROM k UNION ALL SELECT vec_id, kind, 1, 'decode.offsets.read', NULL, 2 FROM k
    UNION ALL SELECT vec_id, kind, 2, 'decode.chunk.trailing_bytes', 0, 3 FROM k WHERE kind = 1 UNION ALL SELECT vec_id, kind, 2 + kind, 'decode.complete', NULL, 32 + 3 * kind FROM k WHERE kind < 2)
    SELECT 'image/' || vec_id || '.exr' AS path, 0 AS part_id, seq::INT AS seq, 'decode' AS phase, CASE WHEN code LIKE '%trailing%' THEN 'warn' ELSE 'info' END AS level, code, chunk_index::INT AS chunk_index, n::BIGINT AS n FROM e"""
)
def exr_events_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(trailing_files(spark, sf_dir))
    return exr.decode_events(s, exr.scanlines(exr.chunks(s)))


@query("WITH q AS (" + SQL["exr_events_decode"] + ") SELECT path, seq, 'decode.' || code AS step, CASE level WHEN 'warn' THEN 'warn' ELSE 'ok' END AS status, code AS description FROM q")
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(trailing_files(spark, sf_dir))
    return exr.log_entries(exr.decode_events(s, exr.scanlines(exr.chunks(s)))).select("path", "seq", "step", "status", "description")


# Files on disk, read by offset
def _on_disk(spark: SparkSession, files: DataFrame, name: str) -> str:
    folder = scratch(spark, name)
    saved(files, folder).write.format("noop").mode("overwrite").save()
    return folder


_LOW, _HIGH = 10, 21
_NAME = r"(image/[^/]*)$"


@query(_CODED.replace("(VALUES ('F'), ('H'), ('U')) AS c(channel)", f"(VALUES ('F'), ('H')) AS c(channel) WHERE y BETWEEN {_LOW} AND {_HIGH}"))
def exr_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source with its filters: some channels and lines of files on disk."""
    ranged.register(spark)
    lines = spark.read.format("exr_lines").load(_on_disk(spark, _coded_files(spark, sf_dir, 3), "zip"))
    px = exr.sampled_pixels(lines.filter(F.col("channel").isin("F", "H") & F.col("y").between(_LOW, _HIGH)))
    return px.select(F.regexp_extract("path", _NAME, 1).alias("path"), "channel", F.col("sx").alias("x"), F.col("sampled_row").alias("y"), F.col("value").cast("double").alias("v"))


@query(f"SELECT 'image/' || s_suppkey || '.exr' AS path, {_HIGH - _LOW + 1}::BIGINT AS chunks, {(_HIGH - _LOW + 1) * WIDTH * 10}::BIGINT AS read_bytes, {HEIGHT}::BIGINT AS all_chunks FROM supplier")
def exr_manifest_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a manifest of files on disk, what is read of each for a range of lines."""
    rows = ranged.refreshed(spark, _on_disk(spark, _coded_files(spark, sf_dir, 0), "raw"), scratch(spark, "manifest"))
    read = ranged.fetched(ranged.meeting(rows, _LOW, _HIGH), gap=0).groupBy("path").agg(F.count("*").alias("chunks"), F.sum("read_bytes").alias("read_bytes"))
    both = read.join(rows.groupBy("path").agg(F.count("*").alias("all_chunks")), "path")
    return both.withColumn("path", F.regexp_extract("path", _NAME, 1))


@query(_CODED.replace("(VALUES ('F'), ('H'), ('U')) AS c(channel)", f"(VALUES ('F'), ('H'), ('U')) AS c(channel) WHERE y BETWEEN {_LOW} AND {_HIGH}"))
def exr_manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranged.refreshed(spark, _on_disk(spark, _coded_files(spark, sf_dir, 2), "zips"), scratch(spark, "manifest"))
    px = exr.sampled_pixels(ranged.lines_between(rows, _LOW, _HIGH))
    return px.select(F.regexp_extract("path", _NAME, 1).alias("path"), "channel", F.col("sx").alias("x"), F.col("sampled_row").alias("y"), F.col("value").cast("double").alias("v"))


@query(f"WITH {_GRID} SELECT 'image/' || s_suppkey || '.exr' AS path, 'H' AS channel, y, sum({_H.format(k=_K)})::DOUBLE AS total, max({_H.format(k=_K)})::DOUBLE AS most FROM px GROUP BY s_suppkey, y")
def exr_sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of lines, in SQL alone."""
    sqltable.register(spark)
    return spark.sql(
        """SELECT f.path, l.channel, l.y, aggregate(l.values, 0D, (a, v) -> a + v) AS total, CAST(array_max(l.values) AS DOUBLE) AS most
        FROM {files} AS f, LATERAL exr_lines(f.content, 0, 'H') AS l""",
        files=_coded_files(spark, sf_dir, 5),
    )


# Lines as arrays: no row a pixel between the files and the result
def _rgb_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))
    x, y, k = lambda i: F.pmod(i, F.lit(WIDTH)), lambda i: F.floor(i / WIDTH), F.pmod(F.col(_K), F.lit(16))
    plane = lambda f: F.transform(i, lambda p: f(x(p), y(p)).cast("double"))
    r, g, b = plane(lambda x, y: x / 16 - k / 32), plane(lambda x, y: y / 32), plane(lambda x, y: (x + y) / 64)
    return image_files(_suppliers(spark, sf_dir), _K, [("B", FLOAT, b), ("G", HALF, g), ("R", FLOAT, r)], WIDTH, 3)


_RGB = f"{_GRID}, rgb AS (SELECT s_suppkey, x, y, x / 16.0::DOUBLE - s_suppkey % 16 / 32.0::DOUBLE AS r, y / 32.0::DOUBLE AS g, (x + y) / 64.0::DOUBLE AS b FROM px)"
_SHOWN = "greatest({c} * 2.0::DOUBLE, 0.0)"


@query(
    f"""WITH {_RGB}, l AS (SELECT s_suppkey, {" + ".join(f"{_SHOWN.format(c=c)} * {w}::DOUBLE" for c, w in zip("rgb", (0.2126, 0.7152, 0.0722), strict=True))} AS lum FROM rgb),
    n AS (SELECT s_suppkey, CASE WHEN lum >= 1 THEN 31 ELSE trunc(lum * 32)::INT END AS bin, count(*) AS n FROM l GROUP BY ALL)
    SELECT 'image/' || s.s_suppkey || '.exr' AS path, b::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT s_suppkey, b FROM supplier, range(32) AS r(b)) AS s LEFT JOIN n ON n.s_suppkey = s.s_suppkey AND n.bin = s.b"""
)
def exr_histogram_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = exr.colour_lines(exr.structure(_rgb_files(spark, sf_dir)))
    return L.histogram(lines, "display", 1.0, 1.0, 32).select("path", "bin", "n")


@query(f"WITH {_RGB} SELECT 'image/' || s_suppkey || '.exr' AS path, y, string_agg({" || ".join(f"printf('%02X', CASE WHEN {_SHOWN.format(c=c)} >= 1 THEN 255 ELSE trunc({_SHOWN.format(c=c)} * 255)::INT END)" for c in "rgb")} || 'FF', '' ORDER BY x) AS rgba FROM rgb GROUP BY s_suppkey, y")
def exr_tone_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = exr.colour_lines(exr.structure(_rgb_files(spark, sf_dir)))
    return L.tone_mapped(lines, 1.0, 1.0).select("path", "y", F.hex("rgba").alias("rgba"))


# Offsets that are too large to count, and chunks whose lines are given twice
def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four lines of three pixels: whole; with an offset beyond 2**53 - 1; with its third chunk over its second one."""

    def make(i: int) -> bytes:
        data = bytearray(encoded([np.arange(12, dtype="<f4").reshape(4, 3) + i % 100], [FLOAT], ["Y"], 0))
        table_at = len(data) - 4 * (8 + 12 + 8)
        if i % 3 == 1:
            data[table_at + 8 : table_at + 16] = struct.pack("<Q", 1 << 53)
        if i % 3 == 2:
            data[table_at + 32 + 40 : table_at + 32 + 44] = struct.pack("<i", 1)
        return bytes(data)

    return _by_id(spark, sf_dir, "embeddings", "vec_id", make)


@query(
    """SELECT 'image/' || vec_id || '.exr' AS path, x::INT AS x, y::INT AS y, (CASE WHEN vec_id % 3 = 1 AND y = 1 THEN 0 WHEN vec_id % 3 = 2 AND y = 2 THEN 0 WHEN vec_id % 3 = 2 AND y = 1 THEN 6 + x + vec_id % 100 ELSE 3 * y + x + vec_id % 100 END)::DOUBLE AS v,
    CASE WHEN vec_id % 3 = 1 THEN 'MALFORMED_OFFSET_TABLE' END AS code FROM embeddings, range(4) AS r(y), range(3) AS q(x)"""
)
def exr_odd_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exr.structure(odd_files(spark, sf_dir))
    px = exr.expanded_pixels(exr.full_lines(s)).select("path", "x", "y", F.col("value").cast("double").alias("v"))
    return px.join(exr.chunks(s).filter("code IS NOT NULL").select("path", "code"), "path", "left")


# Values whose logarithms round up to a power of two: x, its 8 * ln(x) as a half, and the same with the compat rounding, which loses the carry
_CARRIES = ((0.77880859375, -2.0, -1.0), (0.367919921875, -8.0, -4.0), (54.59375, 32.0, 16.0), (1.0, 0.0, 0.0))


def linear_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat images of blocks, whose channel is marked as linear."""

    def make(i: int) -> bytes:
        data = bytearray(encoded([np.full((4, 4), _CARRIES[i % 4][0], "<f2")], [HALF], ["Y"], 6))
        data[data.index(b"Y\0\x01\0\0\0") + 6] = 1
        return bytes(data)

    return _by_id(spark, sf_dir, "supplier", "s_suppkey", make)


@query(f"SELECT 'image/' || s_suppkey || '.exr' AS path, y::INT AS y, ({[c[1] for c in _CARRIES]})[(s_suppkey % 4 + 1)::INT]::DOUBLE AS ieee, ({[c[2] for c in _CARRIES]})[(s_suppkey % 4 + 1)::INT]::DOUBLE AS compat FROM supplier, range(4) AS r(y)")
def exr_compat_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of linear channels with either rounding of halves."""
    c = exr.chunks(exr.structure(linear_files(spark, sf_dir)))
    one = lambda name, **o: exr.scanlines(c, **o).select("path", "y", F.array_max("values").cast("double").alias(name))
    return one("ieee").join(one("compat", compat=True), ["path", "y"])


__all__ = ["QUERIES"]
