"""Image files in SQL: a table function over contents, and the data source of lines by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from scanweave.sources import blocks as B
from scanweave.sources import header as H
from scanweave.sources import ranged
from scanweave.sources import scan as S

ROW = StructType().add("part_id", IntegerType()).add("channel", StringType()).add("y", IntegerType()).add("sampled_row", IntegerType()).add("values", ArrayType(FloatType())).add("code", StringType())


class Lines:
    """exr_lines(content [, part [, channels]]): the decoded lines of a file's content.

    part: number of the part (null: all).  channels: names to keep, by commas
    (null: all).  What can't be read is a row with a code.  For each file of a
    table: ``FROM files AS f, LATERAL exr_lines(f.content, 0, 'R,G,B') AS l``.
    """

    @staticmethod
    def analyze(content: AnalyzeArgument, part: AnalyzeArgument | None = None, channels: AnalyzeArgument | None = None) -> AnalyzeResult:
        for argument, kinds, name in ((content, (BinaryType,), "content"), (part, (IntegerType,), "part"), (channels, (StringType,), "channels")):
            if argument is not None and not (isinstance(argument.dataType, kinds) or argument.dataType.typeName() == "void"):
                raise ValueError(f"exr_lines: {name} must be of type {kinds[0].typeName()}, not {argument.dataType.simpleString()}")
        return AnalyzeResult(ROW)

    def eval(self, content: bytes | None, part: int | None = None, channels: str | None = None) -> Iterator[tuple]:
        source = S.Memory(bytes(content or b""))
        wanted = ranged.Wanted(None if part is None else {part}, None if channels is None else {c.strip() for c in channels.split(",")})
        try:
            known = ranged.plans(ranged.header_of(source), source.length)
            if part is not None and part not in {p["part_id"] for p in known}:
                raise H.ExrError("PART_NOT_FOUND", f"there is no part {part}")
        except H.ExrError as e:
            yield part, None, None, None, None, e.code
            return
        for plan in known:
            if wanted.parts is not None and plan["part_id"] not in wanted.parts:
                continue
            for row in ranged.chunk_rows(source, plan):
                payload = None if row["offset"] is None else source.read(row["offset"], row["data_size"])
                for _, number, channel, y, sampled, v, _, code in ranged.lines_of("", row, payload, wanted, B.SCHEMES, "PERMISSIVE", tell=True):
                    yield number, channel, y, sampled, None if v is None else v.tolist(), code


def register(spark: SparkSession) -> None:
    """Make exr_lines known to a session, as a table function and as a data source (CREATE TABLE ... USING exr_lines)."""
    ranged.register(spark)
    spark.udtf.register("exr_lines", udtf(Lines, useArrow=True))
