"""Files that are read by offset: a data source of lines, and a manifest of chunks that says which bytes a query needs.

Headers, offset tables and chunk heads are small; payloads are read only for the
chunks that a query asks for.  So files may have any size, and no row holds a
whole one.  Files are opened in the tasks, by local path or by a URI that Arrow's file
systems know.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from scanweave.operators.catalog import is_image_path
from scanweave.sources import blocks as B
from scanweave.sources import exr
from scanweave.sources import header as H
from scanweave.sources import scan as S

#: Bytes of a partition of the data source.
PARTITION = 128 << 20


def header_of(source: S.Memory | S.Ranges) -> dict:
    """The header, from as many bytes as it needs."""
    n = exr.HEADER_BYTES
    while True:
        try:
            return H.parse(bytes(source.read(0, min(n, source.length))))
        except H.ExrError:
            if n >= source.length:
                raise
            n *= 8


def plans(header: dict, length: int) -> list[dict]:
    """What the scan of each part needs, as exr's plan has it for whole contents."""
    out, before = [], 0
    for p in header["parts"]:
        w, scheme = p["data_window"], B.SCHEMES.get(p["compression"])
        lines = scheme.lines if scheme else 1
        n = max(0, -(-(w["y_max"] - w["y_min"] + 1) // lines)) if w else 0
        at = header["header_end"] + 8 * before
        if p["type"] in ("tiledimage", "deepscanline", "deeptile") or header["flags"] & (H.TILED | H.DEEP):
            code = "UNSUPPORTED_PART_TYPE"
        elif scheme is None:
            code = "UNSUPPORTED_COMPRESSION"
        elif w is None:
            code = "MISSING_DATA_WINDOW"
        elif w["x_max"] < w["x_min"] - 1 or w["y_max"] < w["y_min"] - 1:
            code = "MALFORMED_HEADER"
        else:
            code = "MALFORMED_OFFSET_TABLE" if at + 8 * n > length else None
        out.append({"part_id": p["part_id"], "compression": p["compression"], "w": w, "channels": p["channels"], "lines_per": lines, "n_chunks": n, "table_at": at, "multi": header["is_multipart"], "code": code})
        before += n
    return out


def chunk_rows(source: S.Memory | S.Ranges, plan: dict) -> Iterator[dict]:
    """The chunks of a part, without payloads: what decoding needs, and offset, the place of the payload (null: not within the file)."""
    if plan["code"]:
        yield plan | dict.fromkeys(("chunk_index", "chunk_y", "data_size", "offset", "kept", "lines", "expected_size"))
        return
    if not plan["n_chunks"]:
        return
    found = S.heads(source, plan["table_at"], plan["n_chunks"], plan["multi"], plan["part_id"])
    kept = S.kept_spans(found, plan["part_id"], plan["w"]["y_min"], plan["lines_per"])
    for i in range(plan["n_chunks"]):
        if found.safe[i] and found.own[i] != plan["part_id"]:
            continue
        row = plan | {"chunk_index": i, "chunk_y": None, "data_size": None, "offset": None, "kept": None, "lines": None, "expected_size": None, "code": found.code(i)}
        if found.safe[i]:
            y = int(found.y[i])
            lines = max(0, min(plan["lines_per"], plan["w"]["y_max"] - y + 1))
            size = sum(p.width * p.size * len(p.ys) for p in exr._planes(plan["channels"], plan["w"], y, lines))
            spans = None if kept is None else [{"lo": lo, "hi": hi} for lo, hi in kept.get(i, [])]
            row |= {"chunk_y": y, "data_size": int(found.size[i]), "offset": found.place(i) if found.fits[i] else None, "kept": spans, "lines": lines, "expected_size": size}
        yield row


@dataclasses.dataclass
class Wanted:
    """Parts, channels and lines that filters ask for (None: all)."""

    parts: set[int] | None = None
    channels: set[str] | None = None
    low: int | None = None
    high: int | None = None

    def take(self, f: Filter) -> bool:
        """Is the filter one of ours?  Then it is kept here."""
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if isinstance(f, EqualTo | In) and column in ("part_id", "channel"):
            values = set(f.value) if isinstance(f, In) else {f.value}
            name = {"part_id": "parts", "channel": "channels"}[column]
            known = getattr(self, name)
            setattr(self, name, values if known is None else known & values)
            return True
        if column != "y" or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            low = f.value + isinstance(f, GreaterThan)
            self.low = low if self.low is None else max(self.low, low)
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            high = f.value - isinstance(f, LessThan)
            self.high = high if self.high is None else min(self.high, high)
        return True

    def lines(self, lo: int, n: int) -> bool:
        """May lines lo .. lo + n - 1 be asked for?"""
        return (self.high is None or lo <= self.high) and (self.low is None or lo + n > self.low)

    def errors(self) -> bool:
        """Rows of errors have no channel and no line, so a filter on these leaves them out."""
        return self.channels is None and self.low is None and self.high is None


def lines_of(path: str, row: dict, payload: pa.Buffer | memoryview | None, wanted: Wanted, schemes: dict, mode: str, tell: bool = False) -> Iterator[tuple]:
    """SCANLINES of one chunk; tell: errors are told whatever is wanted."""
    try:
        if row["code"]:
            raise H.ExrError(row["code"], "found by the scan")
        out = []
        for i, y, v in exr._decoded_lines(row, schemes, pa.py_buffer(payload), wanted.channels, False):
            c, lo = row["channels"][i], row["w"]["y_min"]
            s = max(1, c["y_sampling"])
            if wanted.lines(y, 1):
                out.append((path, row["part_id"], c["name"], y, (y - (lo + -lo % s)) // s, v, row["chunk_index"], None))
        yield from out
    except H.ExrError as e:
        if mode == "FAILFAST":
            raise
        if tell or wanted.errors():
            yield path, row["part_id"], None, None, None, None, row["chunk_index"], e.code


@dataclasses.dataclass
class Files(InputPartition):
    """(path, length, first byte, end) of files or runs of their bytes."""

    ranges: list[tuple[str, int, int, int]]


class LinesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.size, self.mode = int(options.get("partitionbytes", PARTITION)), options.get("mode", "PERMISSIVE").upper()
        self.wanted, self.schemes = Wanted(), dict(B.SCHEMES)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def _listed(self) -> Iterator[tuple[str, int]]:
        for path in self.paths:
            prefix = path[: path.index("://") + 3] if "://" in path else ""
            system, name = fs.FileSystem.from_uri(path) if prefix else (fs.LocalFileSystem(), path.removeprefix("file:"))
            info = system.get_file_info(name)
            found = system.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
            for f in found:
                if f.type == fs.FileType.File and f.path.lower().endswith(".exr"):
                    yield prefix + f.path, f.size

    def partitions(self) -> list[Files]:
        """Only names and sizes are looked up here.  Large files are cut into runs of bytes, small ones share a partition."""
        out, held, size = [], [], 0
        for path, length in sorted(self._listed()):
            for lo in range(0, max(1, length), self.size):
                hi = min(lo + self.size, length)
                if held and size + hi - lo > self.size:
                    out.append(Files(held))
                    held, size = [], 0
                held.append((path, length, lo, hi))
                size += hi - lo
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A run of bytes gives the chunks that begin in it; a file's first run also gives what has no place."""
        out = exr._Out(exr.SCANLINES, exr._KINDS)
        for path, length, lo, hi in partition.ranges:
            with S.Ranges(path, length) as source:
                try:
                    known = plans(header_of(source), length)
                except H.ExrError as e:
                    if self.mode == "FAILFAST":
                        raise
                    if lo == 0 and self.wanted.errors() and self.wanted.parts is None:
                        out.add(path, None, None, None, None, None, None, e.code)
                    continue
                for plan in known:
                    if self.wanted.parts is not None and plan["part_id"] not in self.wanted.parts:
                        continue
                    rows = []
                    for row in chunk_rows(source, plan):
                        here = lo == 0 if row["offset"] is None else lo <= row["offset"] < hi
                        if here and (row["chunk_y"] is None or row["code"] or self.wanted.lines(row["chunk_y"], row["lines"])):
                            rows.append(row)
                    for run in S.runs_of([r["data_size"] or 0 for r in rows]):
                        some = rows[run.start : run.stop]
                        there = [r for r in some if r["offset"] is not None]
                        payloads = iter(source.many(np.array([r["offset"] for r in there], np.int64), np.array([r["data_size"] for r in there], np.int64)))
                        for row in some:
                            for line in lines_of(path, row, next(payloads) if row["offset"] is not None else None, self.wanted, self.schemes, self.mode):
                                if out.add(*line):
                                    yield out.batch()
        yield out.batch()


class ImageLines(DataSource):
    """spark.read.format("exr_lines").load(folder): SCANLINES of all image files below a folder, read by offset.

    Filters on part_id, channel and y are pushed down: a line's chunk is read
    only if it may hold lines that are asked for.  Options: partitionBytes,
    mode.  path may be several, by commas.
    """

    @classmethod
    def name(cls) -> str:
        return "exr_lines"

    def schema(self) -> str:
        return exr.SCANLINES

    def reader(self, schema: object) -> LinesReader:
        return LinesReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the data source known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageLines)


MANIFEST = f"path string, length long, modified timestamp, part_id int, chunk_index int, chunk_y int, lines int, lines_per int, data_size int, offset long, expected_size long, compression int, w {exr.BOX}, channels array<{exr.CHANNEL}>, kept {exr.KEPT}, code string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the image files below a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).filter(is_image_path(F.col("path")))


def manifest(files: DataFrame) -> DataFrame:
    """MANIFEST of files (path, length, modified): a row a chunk, from headers, tables and heads alone; a file or part that can't be read is a row with a code, one without chunks has a row without any."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in range(batch.num_rows):
                path, length = batch.column("path")[f].as_py(), batch.column("length")[f].as_py()
                with S.Ranges(path, length) as source:
                    try:
                        rows = [r for plan in plans(header_of(source), length) for r in chunk_rows(source, plan)] or [{}]
                    except H.ExrError as e:
                        rows = [{"code": e.code}]
                own = batch.slice(f, 1).select(["path", "length", "modified"]).take(pa.array(np.zeros(len(rows), np.int64)))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r.get(n) for r in rows], k) for n, k in kinds.items())], names=names)

    kinds = _kinds()
    return files.select("path", "length", "modified").mapInArrow(run, MANIFEST)


def _kinds() -> dict[str, pa.DataType]:
    """Arrow types of MANIFEST's columns from part_id on."""
    box = pa.struct([(n, pa.int32()) for n in ("x_min", "y_min", "x_max", "y_max")])
    channel = pa.struct([("name", pa.string())] + [(n, pa.int32()) for n in ("pixel_type", "p_linear", "x_sampling", "y_sampling")])
    whole = dict.fromkeys(("part_id", "chunk_index", "chunk_y", "lines", "lines_per", "data_size"), pa.int32())
    return whole | {"offset": pa.int64(), "expected_size": pa.int64(), "compression": pa.int32(), "w": box, "channels": pa.list_(channel), "kept": exr._SPANS, "code": pa.string()}


def _versions(spark: SparkSession, at: str) -> list[int]:
    """Versions of a manifest that were written whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{n}/_SUCCESS")))


def refreshed(spark: SparkSession, folder: str, at: str) -> DataFrame:
    """The manifest of a folder, kept as Parquet at `at`: files that are new or whose size or time changed are scanned, those that are gone leave it.

    Each call writes a version of its own and leaves the one before, which
    others may read; a version that was not finished is not seen.  Rows lie by
    path and line, so Parquet's statistics leave out what a range of lines
    doesn't need.
    """
    files, done = listed(spark, folder), _versions(spark, at)
    keys = ["path", "length", "modified"]
    if done:
        old = spark.read.parquet(f"{at}/v{done[-1]}")
        same = old.join(files, keys, "left_semi")
        rows = same.unionByName(manifest(files.join(old.select(*keys).distinct(), keys, "left_anti")))
    else:
        rows = manifest(files)
    number = done[-1] + 1 if done else 0
    rows.repartitionByRange("path", "chunk_y").sortWithinPartitions("path", "part_id", "chunk_y").write.mode("overwrite").parquet(f"{at}/v{number}")
    return spark.read.parquet(f"{at}/v{number}")


def meeting(chunks: DataFrame, low: int, high: int) -> DataFrame:
    """The chunks of a manifest that may hold lines low .. high."""
    return chunks.filter((F.col("chunk_y") <= high) & (F.col("chunk_y") >= low - F.col("lines_per") + 1) & F.col("code").isNull())


def fetched(chunks: DataFrame, gap: int = S.GAP) -> DataFrame:
    """Chunks of a manifest with their payloads, as exr.scanlines takes them, and read_bytes, what was read of files for them (of chunks read together, with the first).

    gap: bytes between two ranges that are rather read than left out.
    """
    kept = [c for c in exr._NEEDED if c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            edges = np.flatnonzero(np.concatenate([[True], paths[1:] != paths[:-1]])).tolist() if len(paths) else []
            for lo, hi in zip(edges, [*edges[1:], len(paths)], strict=True):
                rows = batch.slice(lo, hi - lo)
                at, size = (rows.column(c).to_pylist() for c in ("offset", "data_size"))
                with S.Ranges(paths[lo], rows.column("length")[0].as_py()) as source:
                    for r in S.runs_of([n or 0 for n in size]):
                        before, there = source.read_bytes, [i for i in r if at[i] is not None]
                        got = dict(zip(there, source.many(np.array([at[i] for i in there], np.int64), np.array([size[i] for i in there], np.int64), gap), strict=True))
                        some = rows.slice(r.start, len(r)).select(kept)
                        read = [source.read_bytes - before, *[0] * (len(r) - 1)]
                        yield pa.RecordBatch.from_arrays([*some.columns, S.binaries([got.get(i) for i in r]), pa.array(read, pa.int64())], names=[*kept, "payload", "read_bytes"])

    schema = ", ".join(f"{n} {t}" for n, t in chunks.select(*kept).dtypes)
    return chunks.select(*kept, "length", "offset", "data_size").mapInArrow(run, f"{schema}, payload binary, read_bytes long")


def lines_between(chunks: DataFrame, low: int, high: int, names: list[str] | None = None, **options) -> DataFrame:
    """SCANLINES low .. high from a manifest: only the chunks that meet them are read."""
    return exr.scanlines(fetched(meeting(chunks, low, high)), names, **options).filter(F.col("y").between(low, high) | F.col("code").isNotNull())
