"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: The same as a character class for Java's and RE2's regular expressions.
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.  Where it is unset, one is made if all run on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='scanweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows and bytes of the batches that whole texts go to Python in, at most; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of texts at once, in this session (Spark's own bound is 10,000 rows)."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def trim() -> None:
    """Give memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that leaves its worker small: workers live on between tasks, several in an executor."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return tidied


#: Folders that this process has written.
_written: list[str] = []


def mark() -> int:
    """How many folders operators of this session have written so far."""
    return len(_written)


def release(spark: SparkSession, first: int = 0, keep: int = 0) -> int:
    """Remove the folders that operators of this session have written, once what reads them is read or written; how many there were.

    first: a mark() before which folders stay; keep: how many of the last ones
    stay, too.
    """
    gone = _written[first : len(_written) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written[first : first + len(gone)]
    return len(gone)


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors.  release() removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Least number of parts that the rows of each key are dealt into where one key may hold a large share of all rows.
SALTS = 16


def salts(spark: SparkSession) -> int:
    """Parts for the rows of each key: as many as a shuffle has partitions, so that one key can fill them all."""
    return max(SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, facts: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined to facts on key, where one key may hold many rows: these are dealt into parts (see salts) by their column `by`.

    Facts are brought to the parts that rows have, so a key that has few rows costs few copies.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit("salt")), F.lit(salts(rows.sparkSession))).cast("int"))
    seats = dealt.select(key, "_salt").distinct().join(facts, key)
    return dealt.join(seats, [key, "_salt"], how).drop("_salt")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8; bytes.split() cuts at exactly BLANKS."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and xor-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
