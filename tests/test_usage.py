"""Texts of a cache's size against DuckDB's printf, at all sizes and at ties."""

import duckdb
from pyspark.sql import functions as F

from scanweave.functions.pixels import usage_text
from scanweave.plans import SQL


def test_usage_text_equals_printf(spark):
    kb, mb = 1 << 10, 1 << 20
    sizes = [0, 1, 1023, kb, 10 * kb - 1, 10 * kb, 10 * kb + 256, 10 * kb + 768, 100 * kb - 1, 100 * kb, 100 * kb + 512, 101 * kb + 512, mb - 1, mb, mb + mb // 8, mb + 3 * mb // 8, 10 * mb, 99 * mb + 12345, 100 * mb, 123 * mb + 54321, 5000 * mb + 7]
    sizes += [mb * k + mb * j // 8 for k in (1, 12, 150) for j in range(8)]
    text = SQL["cache_usage"].split("AS over, ")[1].removesuffix(" AS text FROM s")
    want = duckdb.connect().execute(f"SELECT {text} FROM (SELECT unnest(?::BIGINT[]) AS used)", [sizes]).fetchall()
    got = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, used long").orderBy("i").select(usage_text(F.col("used")).alias("t")).collect()
    assert [r.t for r in got] == [r[0] for r in want]
