"""A growing folder of frames as a stream: new files join their sequences as they come.

Playback looks at what is there; here the same
catalogue is kept up by Structured Streaming, whose state is one row a sequence,
and frames are decoded as they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from scanweave.operators.catalog import described, is_image_path
from scanweave.sources import exr

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, at_once: int = 1000) -> DataFrame:
    """New image files below a folder: path, modificationTime, length.  Their content is not read."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", True).load(folder)
    return files.filter(is_image_path(F.col("path"))).select("path", "modificationTime", "length")


def decoded(spark: SparkSession, folder: str, at: str, checkpoint: str, names: list[str] | None = None, at_once: int = 100, after: Callable[[int], None] | None = None) -> DataStreamWriter:
    """Decode the first part of every frame that arrives in a folder, into a table at `at`; start() runs it.

    Each batch is one Parquet folder named by its number, written over whole:
    a batch that is repeated after a failure adds nothing twice.  Frames that
    can't be read don't stop the stream: they are rows with a code, in a
    partition of their own.  after is called with the number of each batch that
    is written.
    """

    def commit(batch: DataFrame, number: int) -> None:
        s = exr.structure(batch.select("path", "length", "content"))
        lines = exr.scanlines(exr.chunks(s, 0), names)
        whole = s.filter("s.error IS NOT NULL").select("path", *(F.lit(None).cast(t).alias(c) for c, t in lines.dtypes[1:-1]), "s.error.code")
        rows = lines.unionByName(whole).withColumn("failed", F.col("code").isNotNull())
        rows.write.mode("overwrite").partitionBy("failed").parquet(f"{at}/batch={number}")
        if after:
            after(number)

    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", at_once).option("recursiveFileLookup", True).load(folder)
    return files.filter(is_image_path(F.col("path"))).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def decoded_lines(spark: SparkSession, at: str, failed: bool = False) -> DataFrame:
    """The lines of the table so far, with the batch they came in; failed: the frames and chunks that could not be read instead."""
    rows = spark.read.schema(f"{exr.SCANLINES}, batch long, failed boolean").option("basePath", at).parquet(at)
    return rows.filter(F.col("failed") == failed).drop("failed")


def live_sources(files: DataFrame) -> DataFrame:
    """Sequences so far, updated with every batch: key, frames, first and last frame number, bytes."""
    g = described(files).groupBy("sequence_key")
    return g.agg(F.count("*").alias("frames"), F.min("frame_number").alias("first_frame"), F.max("frame_number").alias("last_frame"), F.sum("length").alias("bytes"))


def arrivals_by_minute(files: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Files and bytes of each sequence by minute; minutes older than the watermark are final."""
    timed = described(files).withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", "1 minute"), "sequence_key").agg(F.count("*").alias("frames"), F.sum("length").alias("bytes"))
