"""Queries over codec steps, with integers of lineitem, part and events as their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import pixels as P
from scanweave.operators import codecs as C
from scanweave.plans.registry import query, table

# rows of lineitem in a full order, so that equal rows alone may change places
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_COLS = _ORDER.split(", ")


def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_COLS, F.pmod("l_partkey", F.lit(256)).cast("int").alias("d"), F.expr("l_orderkey div 64").alias("chunk"))


@query(f"SELECT chunk, d, ((sum(d) OVER w - 128 * (row_number() OVER w - 1)) % 256 + 256)::INT % 256 AS v FROM (SELECT *, (l_partkey % 256)::INT AS d, l_orderkey // 64 AS chunk FROM lineitem) WINDOW w AS (PARTITION BY chunk ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)")
def predictor_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.predicted(_bytes(spark, sf_dir), "d", _COLS, ["chunk"], "v").select("chunk", "d", "v")


@query(f"SELECT chunk, d, (sum(d) OVER (PARTITION BY chunk ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) % 4294967296)::BIGINT AS v FROM (SELECT *, (l_partkey * 2654435) % 16777216 * 256 AS d, l_orderkey // 64 AS chunk FROM lineitem)")
def delta_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bytes(spark, sf_dir).withColumn("d", F.pmod(F.col("l_partkey") * 2654435, F.lit(16777216)) * 256)
    return C.running_sum(df, "d", _COLS, ["chunk"], 2**32, "v").select("chunk", "d", "v")


@query("SELECT vec_id, (CASE WHEN i < 32 THEN 2 * i ELSE 2 * (i - 32) + 1 END)::INT AS place, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) AS r(i)")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", C.deinterleaved(F.col("i"), F.lit(64)).alias("place"), F.col("v").cast("double").alias("v"))


_RUNS = """WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) != event_type THEN 1 ELSE 0 END AS new FROM events),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e)"""


@query(f"{_RUNS} SELECT user_id, run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY ALL")
def run_length_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.runs(table(spark, sf_dir, "events"), "event_type", ["event_id"], ["user_id"])


@query("SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events")
def run_length_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = C.runs(table(spark, sf_dir, "events"), "event_type", ["event_id"], ["user_id"])
    return C.expanded(runs, "event_type", ["user_id"])


@query("SELECT row_number() OVER (ORDER BY v) - 1 AS index, v FROM (SELECT DISTINCT p_size AS v FROM part UNION SELECT 0)")
def bitmap_lut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.lookup(table(spark, sf_dir, "part").withColumnRenamed("p_size", "v"), "v")


@query("WITH lut AS (SELECT row_number() OVER (ORDER BY v) - 1 AS index, v FROM (SELECT DISTINCT p_size AS v FROM part UNION SELECT 0)) SELECT v, count(*) AS n FROM lineitem JOIN lut ON index = l_partkey % 60 GROUP BY v")
def lut_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    lut = F.broadcast(C.lookup(table(spark, sf_dir, "part").withColumnRenamed("p_size", "v"), "v"))  # 65536 rows at most
    return table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(60)).alias("index")).join(lut, "index").groupBy("v").agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE l AS (SELECT p_partkey AS symbol, (8 + p_size % 12)::INT AS len FROM part), n AS (SELECT len, count(*) AS n FROM l GROUP BY 1),
    c(len, c) AS (SELECT 58, 0::BIGINT UNION ALL SELECT c.len - 1, (c.c + coalesce((SELECT n FROM n WHERE n.len = c.len), 0)) >> 1 FROM c WHERE c.len > 1)
    SELECT symbol, l.len, c + row_number() OVER (PARTITION BY l.len ORDER BY symbol) - 1 AS code FROM l JOIN c ON c.len = l.len"""
)
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (8 + F.pmod("p_size", F.lit(12))).cast("int").alias("len"))
    return C.canonical_codes(lengths, "symbol", "len")


_PAIRS = "(SELECT DISTINCT ((l_partkey * 7919) % {m})::INT AS lo, ((l_suppkey * 104729 + l_linenumber) % {m})::INT AS hi FROM lineitem)"


def _pairs(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    lo, hi = F.pmod(F.col("l_partkey") * 7919, F.lit(modulus)), F.pmod(F.col("l_suppkey") * 104729 + F.col("l_linenumber"), F.lit(modulus))
    return table(spark, sf_dir, "lineitem").select(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")).distinct()


@query(f"SELECT lo, hi, (lo + (hi & 1) + (hi >> 1)) & 65535 AS a, (lo + (hi & 1) + (hi >> 1) - hi) & 65535 AS b FROM {_PAIRS.format(m=16384)}")
def haar_pairs_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = P.haar14(F.col("lo"), F.col("hi"))
    return _pairs(spark, sf_dir, 16384).select("lo", "hi", a.alias("a"), b.alias("b"))


@query(f"SELECT lo, hi, (hi + ((lo - (hi >> 1)) & 65535) - 32768) & 65535 AS a, (lo - (hi >> 1)) & 65535 AS b FROM {_PAIRS.format(m=65536)}")
def haar_pairs_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = P.haar16(F.col("lo"), F.col("hi"))
    return _pairs(spark, sf_dir, 65536).select("lo", "hi", a.alias("a"), b.alias("b"))


@query(f"SELECT DISTINCT hi AS v, CASE WHEN hi & 32768 != 0 THEN hi & 32767 ELSE (~hi) & 65535 END AS bits FROM {_PAIRS.format(m=65536)}")
def b44_sign_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, 65536).select(F.col("hi").alias("v"), P.sign_mapped(F.col("hi")).alias("bits")).distinct()


@query(
    f"""SELECT DISTINCT hi AS bits, CASE WHEN (hi >> 10) & 31 = 31 AND hi & 1023 != 0 THEN NULL ELSE (CASE WHEN hi >= 32768 THEN -1.0 ELSE 1.0 END) * CASE WHEN (hi >> 10) & 31 = 0 THEN (hi & 1023) * pow(2.0, -24)
    WHEN (hi >> 10) & 31 = 31 THEN 'inf'::DOUBLE ELSE (1 + (hi & 1023) / 1024.0) * pow(2.0, ((hi >> 10) & 31) - 15) END END AS v, (hi >> 10) & 31 = 31 AND hi & 1023 != 0 AS not_a_number FROM {_PAIRS.format(m=65536)}"""
)
def half_bits_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = _pairs(spark, sf_dir, 65536).select(F.col("hi").alias("bits")).distinct().withColumn("v", P.half_value(F.col("bits")))
    return some.select("bits", F.when(~F.isnan("v"), F.col("v")).alias("v"), F.isnan("v").alias("not_a_number"))


_FLOATS = f"(SELECT DISTINCT (lo - 32768) * pow(2.0, -(hi % 40)) AS v FROM {_PAIRS.format(m=65536)})"
_BITS = "CASE WHEN a >= 65536 THEN 31744 WHEN a < pow(2.0, -14) THEN {sub} ELSE {norm} END + CASE WHEN v < 0 THEN 32768 ELSE 0 END"


@query(
    f"""WITH f AS (SELECT v, abs(v) AS a FROM {_FLOATS}), e AS (SELECT *, greatest(floor(log2(greatest(a, pow(2.0, -30)))), -14)::INT AS e FROM f), q AS (SELECT *, a * pow(2.0, 10 - e) AS q FROM e)
    SELECT v, ({_BITS.format(sub="round_even(q, 0)::INT", norm="least((e + 14) * 1024 + round_even(q, 0)::INT, 31744)")})::INT AS ieee, ({_BITS.format(sub="floor(q + 0.5)::INT", norm="least(((e + 15) << 10) | (floor(q + 0.5)::INT - 1024), 31744)")})::INT AS compat FROM q"""
)
def half_bits_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _pairs(spark, sf_dir, 65536).select(((F.col("lo") - 32768) * F.pow(F.lit(2.0), -F.pmod("hi", F.lit(40)))).alias("v")).distinct()
    return v.select("v", P.half_bits(F.col("v")).alias("ieee"), P.half_bits(F.col("v"), compat=True).alias("compat"))


@query("SELECT s_suppkey // 4 AS file, s_suppkey AS part, chunks, (sum(chunks) OVER (PARTITION BY s_suppkey // 4 ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) - chunks)::BIGINT * 8 + 400 AS table_at FROM (SELECT s_suppkey, CAST(ceil((1 + s_nationkey * 7) / 16.0) AS INT) AS chunks FROM supplier)")
def offset_table_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scanweave.functions.geometry import chunk_count
    from scanweave.sources.exr import table_at

    chunks = chunk_count(1 + F.col("s_nationkey") * 7, F.lit(16)).cast("long")
    files = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 4").alias("file")).agg(F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("part"), chunks.alias("chunks")))).alias("parts"))
    each = files.select("file", "parts", F.posexplode("parts").alias("place", "p"))
    before = F.transform(F.slice("parts", F.lit(1), F.col("place")), lambda q: q["chunks"])
    return each.select("file", "p.part", F.col("p.chunks").cast("int").alias("chunks"), table_at(F.lit(400), before).alias("table_at"))


@query(
    """WITH rules(rule, suffix, scheme, csc) AS (VALUES (0, 'r', 'lossy', 0), (1, 'red', 'lossy', 0), (2, 'g', 'lossy', 1), (3, 'grn', 'lossy', 1), (4, 'green', 'lossy', 1),
      (5, 'b', 'lossy', 2), (6, 'blu', 'lossy', 2), (7, 'blue', 'lossy', 2), (8, 'y', 'lossy', -1), (9, 'by', 'lossy', -1), (10, 'ry', 'lossy', -1), (11, 'a', 'rle', -1)),
    ch AS (SELECT DISTINCT p_brand AS brand, p_brand || '.' || (['R', 'GRN', 'blue', 'A', 'Z', 'By', 'depth'])[(p_size % 7 + 1)::INT] AS name FROM part)
    SELECT brand, name, coalesce(scheme, 'unknown') AS scheme, coalesce(csc, -1) AS csc FROM ch LEFT JOIN rules ON lower(split_part(name, '.', 2)) = suffix"""
)
def dwa_rule_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("R", "GRN", "blue", "A", "Z", "By", "depth")))
    ch = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.concat("p_brand", F.lit("."), F.element_at(names, F.pmod("p_size", F.lit(7)) + 1)).alias("name")).distinct()
    return C.rule_matched(ch, "name", "brand")
