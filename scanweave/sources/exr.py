"""OpenEXR files as tables: files, parts, channels, chunks, scanlines, pixels.

A file is a row of Spark's ``binaryFile`` source, or any row (path, content).
Headers are walked once; offset tables and chunk heads are read in one Arrow
pass over the content, without copies; chunks are the unit of parallelism of
decoding.  The schema is long (a row a channel and line), as
channels differ from file to file.

mode PERMISSIVE gives broken files and chunks as rows with an error;
FAILFAST raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave.functions import geometry as G
from scanweave.functions.pixels import status_of
from scanweave.operators.catalog import is_image_path
from scanweave.sources import blocks as B
from scanweave.sources import header as H
from scanweave.sources import scan as S
from scanweave.sources.writer import BATCH_BYTES, small_batches

KEPT = "array<struct<lo:int,hi:int>>"
BOX = "struct<x_min:int,y_min:int,x_max:int,y_max:int>"
ERROR = "struct<code:string,message:string,details:map<string,string>>"
CHANNEL = "struct<name:string,pixel_type:int,p_linear:int,x_sampling:int,y_sampling:int>"
PART = f"struct<part_id:int,type:string,compression:int,data_window:{BOX},display_window:{BOX},attributes:map<string,struct<type:string,i:int,f:float,s:string,box:{BOX}>>,channels:array<{CHANNEL}>>"
STRUCTURE = f"struct<magic:long,version:int,flags:int,is_multipart:boolean,header_end:long,parts:array<{PART}>,error:{ERROR}>"


def read(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """Files with an image's extension under path: path, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.filter(is_image_path(F.col("path"))).select("path", "length", "content")


_BOX = pa.struct([(n, pa.int32()) for n in ("x_min", "y_min", "x_max", "y_max")])
_ATTRIBUTE = pa.struct([("type", pa.string()), ("i", pa.int32()), ("f", pa.float32()), ("s", pa.string()), ("box", _BOX)])
_CHANNEL = pa.struct([("name", pa.string()), *((n, pa.int32()) for n in ("pixel_type", "p_linear", "x_sampling", "y_sampling"))])
_PART = pa.struct([("part_id", pa.int32()), ("type", pa.string()), ("compression", pa.int32()), ("data_window", _BOX), ("display_window", _BOX), ("attributes", pa.map_(pa.string(), _ATTRIBUTE)), ("channels", pa.list_(_CHANNEL))])
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string()), ("details", pa.map_(pa.string(), pa.string()))])
_STRUCTURE = pa.struct([("magic", pa.int64()), ("version", pa.int32()), ("flags", pa.int32()), ("is_multipart", pa.bool_()), ("header_end", pa.int64()), ("parts", pa.list_(_PART)), ("error", _ERROR)])


def _structure(content: bytes) -> dict:
    try:
        found = H.parse(content)
    except H.ExrError as e:
        return {"error": {"code": e.code, "message": e.message, "details": list(e.details.items())}}
    return found | {"parts": [p | {"attributes": list(p["attributes"].items())} for p in found["parts"]]}


#: How many of the last headers a batch of files is held against before a header is walked.
RECENT = 8


def _structures(contents: pa.Array) -> pa.Array:
    """The parsed header of each file; files that begin with the same header share one walk and one value."""
    known: list[tuple[bytes, int]] = []
    found: list[dict | None] = []
    which: list[int] = []
    for i in range(len(contents)):
        buffer = contents[i].as_buffer()
        content = b"" if buffer is None else buffer.to_pybytes()
        hit = next((n for h, n in known if content.startswith(h)), None)
        if hit is None:
            hit = len(found)
            found.append(_structure(content))
            end = found[hit].get("header_end")
            if end is not None and end < len(content):  # the header has an end of its own, so what follows can't change it
                known = [(content[:end], hit), *known[: RECENT - 1]]
        which.append(hit)
    return pa.array(found, _STRUCTURE).take(pa.array(which, pa.int64()))


#: Bytes of a file that go to the header walk at first; a header that is longer is walked again with the whole file.
HEADER_BYTES = 1 << 16


def structure(files: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """files with the parsed header as column s.

    Only the first HEADER_BYTES of each file go to Python; whole files follow
    only where the walk ran past that slice.
    """
    # not deterministic to the planner: a filter on the result must not be pushed below, where all that comes before would run twice
    walk = F.arrow_udf(_structures, STRUCTURE).asNondeterministic()
    small_batches(files)
    out = files.withColumn("s", walk(F.substring("content", F.lit(1), F.lit(HEADER_BYTES))))
    more = (F.length("content") > HEADER_BYTES) & F.col("s.error").isNotNull()
    out = out.withColumn("s", F.when(more, walk(F.when(more, F.col("content")))).otherwise(F.col("s")))
    if mode == "FAILFAST":
        fail = F.raise_error(F.concat_ws(": ", "path", "s.error.code", "s.error.message")).cast("string")
        out = out.withColumn("path", F.when(F.col("s.error").isNotNull(), fail).otherwise(F.col("path")))
    return out


def parts(structured: DataFrame) -> DataFrame:
    return structured.select("path", F.explode("s.parts").alias("p")).select("path", "p.part_id", "p.type", "p.compression", "p.data_window", "p.display_window", "p.attributes")


def channels(structured: DataFrame) -> DataFrame:
    """One row a channel with its place in the list, its layer, and the samples it has in the data window."""
    each = structured.select("path", F.explode("s.parts").alias("p")).select("path", "p.part_id", "p.data_window", F.posexplode("p.channels").alias("ordinal", "c"))
    w, x, y = F.col("data_window"), F.col("c.x_sampling"), F.col("c.y_sampling")
    return each.select(
        "path", "part_id", "ordinal", "c.name", F.when(F.instr("c.name", ".") > 0, F.regexp_extract("c.name", r"^(.*)\.", 1)).otherwise("(root)").alias("layer"), "c.pixel_type", "c.p_linear", "c.x_sampling", "c.y_sampling",
        G.first_sample(w["x_min"], x).alias("sample_origin_x"), G.first_sample(w["y_min"], y).alias("sample_origin_y"),
        G.sample_count(w["x_min"], w["x_max"], x).alias("sampled_width"), G.sample_count(w["y_min"], w["y_max"], y).alias("sampled_height"),
    )


def lines_per_chunk(compression: Column) -> Column:
    """1 for unknown schemes."""
    known = F.create_map(*(F.lit(x) for k, s in B.SCHEMES.items() for x in (k, s.lines)))
    return F.coalesce(F.element_at(known, compression), F.lit(1))


def compression_name(compression: Column) -> Column:
    known = F.create_map(*(F.lit(x) for k, s in B.SCHEMES.items() for x in (k, s.name)))
    return F.coalesce(F.element_at(known, compression), F.lit("UNKNOWN"))


def table_at(header_end: Column, chunks_before: Column) -> Column:
    """Where a part's offset table starts: 8 bytes for every chunk of the parts before (an array of their numbers of chunks), after the header."""
    return (header_end + 8 * F.aggregate(chunks_before, F.lit(0).cast("long"), lambda a, n: a + n)).cast("long")


_PLAN_ERRORS = (
    ("UNSUPPORTED_PART_TYPE", "p.type IN ('tiledimage', 'deepscanline', 'deeptile') OR (s.flags & 10) != 0"),
    ("UNSUPPORTED_COMPRESSION", "p.compression IS NULL OR NOT known"),
    ("MISSING_DATA_WINDOW", "p.data_window IS NULL"),
    ("MALFORMED_HEADER", "p.data_window.x_max < p.data_window.x_min - 1 OR p.data_window.y_max < p.data_window.y_min - 1"),
)


def _planned(structured: DataFrame, part_id: int | Column | None = None) -> DataFrame:
    """A row a part with what its chunks need: lines a chunk, number of chunks, place of the offset table, error.  A part that is asked for and isn't there is a row with PART_NOT_FOUND."""
    whole = structured.filter("s.error IS NULL")
    if part_id is None:
        each = whole.select("path", "content", "s", F.explode("s.parts").alias("p")).withColumn("asked", F.col("p.part_id"))
    else:
        asked = part_id if isinstance(part_id, Column) else F.lit(part_id)
        each = whole.withColumn("asked", asked.cast("int")).withColumn("p", F.get(F.filter("s.parts", lambda q: q["part_id"] == F.col("asked")), F.lit(0))).select("path", "content", "s", "p", "asked")
    known = F.array(*(F.lit(k) for k in B.SCHEMES))
    lines = lines_per_chunk(F.col("p.compression"))
    height = G.extent(F.col("p.data_window.y_min"), F.col("p.data_window.y_max"))
    n = F.when(F.col("p.data_window").isNotNull() & (height > 0), G.chunk_count(height, lines)).otherwise(0)
    each = each.withColumn("known", F.array_contains(known, F.col("p.compression"))).withColumn("lines_per", lines).withColumn("n_chunks", n)
    code = F.lit(None).cast("string")
    for name, test in reversed(_PLAN_ERRORS):
        code = F.when(F.coalesce(F.expr(test), F.lit(False)), name).otherwise(code)
    code = F.when(F.col("p").isNull(), "PART_NOT_FOUND").otherwise(code)
    # a file's parts are in one row, so the sum over those before needs no shuffle
    before = F.transform(F.filter("s.parts", lambda q: q["part_id"] < F.col("asked")), lambda q: F.when(q["data_window"].isNotNull(), F.greatest(F.lit(0), G.chunk_count(G.extent(q["data_window"]["y_min"], q["data_window"]["y_max"]), lines_per_chunk(q["compression"])))).otherwise(0).cast("long"))
    each = each.withColumn("table_at", table_at(F.col("s.header_end"), before)).withColumn("code", code)
    short = F.col("table_at") + F.col("n_chunks") * 8 > F.length("content")
    return each.withColumn("code", F.coalesce("code", F.when(short, "MALFORMED_OFFSET_TABLE")))


def expected_size(channels_: Column, window: Column, y: Column, lines: Column) -> Column:
    """Bytes of a chunk's samples: for each channel its width times the sampled lines of the chunk."""
    first = F.greatest(y, window["y_min"])
    one = lambda c: (G.sample_count(window["x_min"], window["x_max"], c["x_sampling"]) * G.sample_count(first, y + lines - 1, c["y_sampling"]) * G.bytes_per_sample(c["pixel_type"])).cast("long")
    return F.aggregate(channels_, F.lit(0).cast("long"), lambda a, c: a + one(c))


PLANNED = ("path", "part_id", "compression", "w", "channels", "lines_per", "n_chunks", "part_code")
_HEADS = "array<struct<chunk_index:int,own:int,chunk_y:int,data_size:int,code:string>>"


def _plan_rows(structured: DataFrame, part_id: int | Column | None) -> DataFrame:
    """A row a part: PLANNED, and what the scan of its chunks needs."""
    plan = _planned(structured, part_id)
    return plan.select(
        "path", F.col("asked").alias("part_id"), "p.compression", F.col("p.data_window").alias("w"), F.col("p.channels").alias("channels"), "lines_per", "n_chunks", F.col("code").alias("part_code"),
        F.col("s.is_multipart").alias("multi"), "table_at", F.col("p.data_window.y_min").alias("y_min"), F.col("p.data_window.y_max").alias("y_max"), "content",
    )


def _some(values: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=None if there is None else ~there)


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _spans(lists: list[list[tuple[int, int]] | None]) -> pa.Array:
    return pa.array([None if x is None else [{"lo": lo, "hi": hi} for lo, hi in x] for x in lists], _SPANS)


_CHUNK_COLUMNS = ("chunk_index", "chunk_offset", "own", "chunk_y", "data_size", "payload", "kept", "code")


def _heads_of(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """(plans, parts of the chunks, their heads as arrays), read for a whole batch at once; what a head holds counts where it is safe, i.e. within the file, and a payload where it fits."""
    plan = {n: batch.column(n).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for n in ("part_id", "lines_per", "n_chunks", "multi", "table_at", "y_min")}
    content = batch.column("content")
    ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
    bytes_ = np.frombuffer(content.buffers()[2] or b"", np.uint8)
    start, length = ends[:-1], np.diff(ends)
    plan["fine"] = batch.column("part_code").is_null().to_numpy(zero_copy_only=False) & (plan["n_chunks"] > 0) & (plan["table_at"] + 8 * plan["n_chunks"] <= length)
    n = plan["n_chunks"] * plan["fine"]
    index, of = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), np.repeat(np.arange(len(n)), n)
    words = lambda at, form: bytes_[at[:, None] + np.arange(np.dtype(form).itemsize)].view(form)[:, 0].astype(np.int64 if form == "<i4" else np.uint64)
    offset = words(start[of] + plan["table_at"][of] + 8 * index, "<u8")
    several = plan["multi"][of] > 0
    head = np.where(several, 12, 8)
    known = offset <= S.MOST
    at = np.where(known, offset, 0).astype(np.int64)
    safe = known & (at + head <= length[of])
    place = start[of] + at + head
    own, y, size = np.where(several, 0, plan["part_id"][of]), np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    y[safe], size[safe] = words(place[safe] - 8, "<i4"), words(place[safe] - 4, "<i4")
    own[safe & several] = words(place[safe & several] - 12, "<i4")
    fits = safe & (size >= 0) & (at + head + size <= length[of])
    return plan, of, {"index": index, "at": at, "known": known, "safe": safe, "own": own, "y": y, "size": size, "fits": fits, "place": place}


def _codes(heads: dict[str, np.ndarray]) -> pa.Array:
    """What is wrong with each chunk's head."""
    return pa.array(np.where(heads["known"], np.where(heads["fits"], None, "MALFORMED_CHUNK"), "MALFORMED_OFFSET_TABLE").tolist(), pa.string())


def _usual(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(parts, numbers of their chunks, their heads as arrays), of the parts whose chunks all lie within the file and stand one after the other on the grid, found for a whole batch at once."""
    plan, of, heads = _heads_of(batch)
    good = heads["fits"] & (heads["own"] == plan["part_id"][of]) & (heads["y"] == plan["y_min"][of] + heads["index"] * plan["lines_per"][of])
    bad = np.zeros(len(batch), bool)
    bad[of[~good]] = True
    stay = ~bad[of]
    return np.flatnonzero(plan["fine"] & ~bad), of[stay], {k: v[stay] for k, v in heads.items()}


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLANNED and the columns of one chunk a row; for each part a row without a chunk, whose spans are the lines that no chunk gives, or the part's error."""
    names = [*PLANNED, *_CHUNK_COLUMNS]
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        planned = batch.select(list(PLANNED))
        usual, of, heads = _usual(batch)
        data = memoryview(batch.column("content").buffers()[2] or b"")
        for run in S.runs_of(heads["size"].tolist()):
            h = {k: v[run.start : run.stop] for k, v in heads.items()}
            n = len(run)
            payload = S.binaries([data[a : a + k] for a, k in zip(h["place"].tolist(), h["size"].tolist(), strict=True)])
            cols = [_some(h["index"]), pa.array(h["at"]), _some(h["own"]), _some(h["y"]), _some(h["size"]), payload, pa.nulls(n, _SPANS), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*planned.take(pa.array(of[run.start : run.stop])).columns, *cols], names=names)
        if len(usual):
            none = [*(pa.nulls(len(usual), t) for t in types), _spans([[]] * len(usual)), pa.nulls(len(usual), pa.string())]
            yield pa.RecordBatch.from_arrays([*planned.take(pa.array(usual)).columns, *none], names=names)
        others = np.ones(len(batch), bool)
        others[usual] = False
        if others.any():
            yield from _odd_chunks(batch.take(pa.array(np.flatnonzero(others))), names, types)


def _odd_chunks(batch: pa.RecordBatch, names: list[str], types: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    """The same for parts that are broken, or whose chunks stand in other places: their spans are found part by part, their rows go out together."""
    planned = batch.select(list(PLANNED))
    _, of, heads = _heads_of(batch)
    bounds = np.searchsorted(of, np.arange(len(batch) + 1)).tolist()
    kept: list[list[tuple[int, int]] | None] = []
    left = []
    for p, lo, hi in zip(batch.select(["part_id", "lines_per", "part_code", "multi", "y_min", "y_max"]).to_pylist(), bounds, bounds[1:], strict=False):
        found = S.Heads(*(heads[k][lo:hi] for k in ("at", "known", "safe", "own", "y", "size", "fits")), 12 if p["multi"] else 8) if hi > lo else None
        spans = S.kept_spans(found, p["part_id"], p["y_min"], p["lines_per"]) if found else None
        kept += [None if spans is None else spans.get(k, []) for k in range(hi - lo)]
        left.append([] if p["part_code"] else S.gaps(found, p["part_id"], p["y_min"], p["y_max"], p["lines_per"]))
    data = memoryview(batch.column("content").buffers()[2] or b"")
    for run in S.runs_of(np.where(heads["fits"], heads["size"], 0).tolist()):
        h = {k: v[run.start : run.stop] for k, v in heads.items()}
        payload = S.binaries([data[a : a + k] if f else None for a, k, f in zip(h["place"].tolist(), h["size"].tolist(), h["fits"].tolist(), strict=True)])
        cols = [_some(h["index"]), pa.array(h["at"], mask=~h["known"]), _some(h["own"], h["safe"]), _some(h["y"], h["safe"]), _some(h["size"], h["safe"]), payload, _spans(kept[run.start : run.stop]), _codes(h)]
        yield pa.RecordBatch.from_arrays([*planned.take(pa.array(of[run.start : run.stop])).columns, *cols], names=names)
    none = [*(pa.nulls(len(batch), t) for t in types), _spans(left), pa.nulls(len(batch), pa.string())]
    yield pa.RecordBatch.from_arrays([*planned.columns, *none], names=names)


def _header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLANNED and k, the heads of all chunks of a part; no payload is read."""
    for batch in batches:
        plan, of, h = _heads_of(batch)
        named = h["safe"] & (plan["multi"][of] > 0)
        each = pa.StructArray.from_arrays([_some(h["index"]), _some(h["own"], named), _some(h["y"], h["safe"]), _some(h["size"], h["safe"]), _codes(h)], ["chunk_index", "own", "chunk_y", "data_size", "code"])
        ends = pa.array(np.searchsorted(of, np.arange(len(batch) + 1)).astype(np.int32), mask=np.append(~plan["fine"], False))
        yield pa.RecordBatch.from_arrays([*batch.select(list(PLANNED)).columns, pa.ListArray.from_arrays(ends, each)], names=[*PLANNED, "k"])


def _planned_schema(rows: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in PLANNED)


def _chunk_rows(structured: DataFrame, part_id: int | Column | None) -> DataFrame:
    rows = _plan_rows(structured, part_id)
    return rows.mapInArrow(_chunker, _planned_schema(rows) + f", chunk_index int, chunk_offset long, own int, chunk_y int, data_size int, payload binary, kept {KEPT}, code string")


def _of_chunk(rows: DataFrame) -> DataFrame:
    """Chunk rows with their lines, their expected size, and one code."""
    rows = rows.withColumn("lines", G.lines_in_chunk(F.col("chunk_y"), F.col("w.y_max"), F.col("lines_per")))
    rows = rows.withColumn("expected_size", expected_size(F.col("channels"), F.col("w"), F.col("chunk_y"), F.col("lines")))
    return rows.select("path", "part_id", "chunk_index", "chunk_offset", "chunk_y", "data_size", "lines", "expected_size", (F.col("data_size") == F.col("expected_size")).alias("is_raw"), "compression", "w", "channels", "lines_per", "payload", "kept", F.coalesce("part_code", "code").alias("code"))


def chunks(structured: DataFrame, part_id: int | Column | None = None) -> DataFrame:
    """A row a chunk: path, part_id, chunk_index, chunk_y, data_size, lines, expected_size, is_raw, payload, and what decoding needs; broken parts and chunks have an error code.

    kept has the spans of lines that a chunk gives where chunks give lines twice
    (null: all).  Chunks that name another part are left out (decode_events
    tells of them).
    """
    rows = _chunk_rows(structured, part_id).filter("chunk_index IS NOT NULL OR part_code IS NOT NULL")
    return _of_chunk(rows.filter("own IS NULL OR own = part_id"))


def compressed(chunks_: DataFrame) -> DataFrame:
    """The chunks that a scheme has to decode."""
    return chunks_.filter("code IS NULL AND NOT is_raw")


SCANLINES = "path string, part_id int, channel string, y int, sampled_row int, values array<float>, chunk_index int, code string"
_KINDS = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.int32(), pa.string())


def _planes(channels_: list[dict], w: dict, y: int, lines: int, compat: bool = False) -> list[B.Plane]:
    out = []
    for c in channels_:
        xs, ys = max(1, c["x_sampling"]), max(1, c["y_sampling"])
        first = lambda lo, s: lo + -lo % s
        width = max(0, (w["x_max"] - first(w["x_min"], xs)) // xs + 1)
        top = max(y, w["y_min"])
        out.append(B.Plane(c["pixel_type"], c["p_linear"], width, tuple(range(first(top, ys), y + lines, ys)) if width else (), c["name"], xs == ys == 1, compat))
    return out


def _decoded_lines(row: dict, schemes: dict, payload: pa.Buffer, wanted: set[str] | None, compat: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(channel's number, y, values) of the lines of one chunk."""
    planes = _planes(row["channels"], row["w"], row["chunk_y"], row["lines"], compat)
    data = memoryview(B.decoded(schemes.get(row["compression"]), payload.to_pybytes(), row["expected_size"], planes))
    spans = row["kept"]
    last = {c["name"]: i for i, c in enumerate(row["channels"])}  # of channels of one name the last counts
    at = 0
    for y, i in sorted((y, i) for i, p in enumerate(planes) for y in p.ys):
        p, c = planes[i], row["channels"][i]
        n = p.width * p.size
        raw, at = data[at : at + n], at + n
        if len(raw) < n:
            raise H.ExrError("MALFORMED_CHUNK", "a line runs past the chunk")
        if wanted is not None and c["name"] not in wanted or last[c["name"]] != i or spans is not None and not any(s["lo"] <= y < s["hi"] for s in spans):
            continue
        if p.kind == B.HALF:
            v = np.frombuffer(raw, "<f2").astype(np.float32)
        elif p.kind == B.FLOAT:
            v = np.frombuffer(raw, "<f4")
        else:
            v = (np.frombuffer(raw, "<u4") * (1 / 4294967295)).astype(np.float32)
        yield i, y, v


class _Out:
    """Rows that end with an array of floats, gathered into batches of a bounded size."""

    def __init__(self, schema: str, kinds: tuple[pa.DataType, ...], most: int = 1 << 18):
        self.names, self.kinds, self.most = [f.split()[0] for f in schema.split(", ")], kinds, most
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row: object) -> bool:
        """Is it time to hand out a batch?"""
        self.rows.append(row)
        self.size += sum(len(v) for v in row if isinstance(v, np.ndarray)) + 8
        return self.size >= self.most

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [()] * len(self.kinds)
        out = [floats(c) if t == FLOATS else pa.array(c, t) for c, t in zip(cols, self.kinds, strict=True)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(out, names=self.names)


FLOATS = pa.list_(pa.float32())


def floats(arrays: tuple[np.ndarray | None, ...]) -> pa.Array:
    """A column of arrays of floats, or nulls."""
    sizes = [0 if a is None else len(a) for a in arrays]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(a is None for a in arrays), False]))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.float32), *(a for a in arrays if a is not None)]), pa.float32()))


_NEEDED = ("path", "part_id", "chunk_index", "chunk_y", "lines", "expected_size", "compression", "w", "channels", "code", "kept", "lines_per", "payload")


def _alike(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """(one row's needs, numbers of the rows that have the same): rows whose chunks have the same scheme, channels and lines, all of which they keep."""
    w, lists = batch.column("w"), batch.column("channels")
    numbers = [batch.column(n).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("compression", "chunk_y", "lines", "expected_size")]
    numbers += [w.field(k).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
    at = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    each = lists.values
    of = [each.field(k) for k in range(5)]
    of = [of[0].dictionary_encode().indices, *of[1:]]
    for k in range(int(size.max(initial=0))):
        there = size > k
        for values in of:
            own = np.full(len(size), -1, np.int64)
            own[there] = values.fill_null(-1).to_numpy(zero_copy_only=False)[at[:-1][there] + k]
            numbers.append(own)
    key, group = np.unique(np.stack([size, *numbers], 1), axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(group.ravel(), minlength=len(key)))[:-1]):
        if len(rows):
            yield batch.select(["compression", "w", "channels", "chunk_y", "lines", "expected_size"]).slice(int(rows[0]), 1).to_pylist()[0], rows


def _lines_of(row: dict, planes: list[B.Plane], wanted: set[str] | None) -> Iterator[tuple[int, int, int]]:
    """(channel's number, y, place in the chunk's bytes) of the lines that are asked for; of channels of one name the last counts."""
    last = {c["name"]: i for i, c in enumerate(row["channels"])}
    at = 0
    for y, i in sorted((y, i) for i, p in enumerate(planes) for y in p.ys):
        name = row["channels"][i]["name"]
        if last[name] == i and (wanted is None or name in wanted):
            yield i, y, at
        at += planes[i].width * planes[i].size


def _floats_of(raw: np.ndarray, kind: int) -> np.ndarray:
    """Samples of bytes, as floats."""
    raw = np.ascontiguousarray(raw)
    if kind == B.HALF:
        return raw.view("<f2").astype(np.float32)
    return raw.view("<f4") if kind == B.FLOAT else (raw.view("<u4") * (1 / 4294967295)).astype(np.float32)


def _line_batch(row: dict, planes: list[B.Plane], wanted: set[str] | None, own: pa.RecordBatch, data: np.ndarray) -> pa.RecordBatch | None:
    """The lines of chunks that are alike, given their decoded bytes, a row a chunk."""
    n, lo = len(own), row["w"]["y_min"]
    lines = list(_lines_of(row, planes, wanted))
    if not lines:
        return None
    values = [_floats_of(data[:, at : at + planes[i].width * planes[i].size], planes[i].kind).ravel() for i, _, at in lines]
    ends = np.concatenate([[0], np.cumsum(np.repeat([planes[i].width for i, _, _ in lines], n))]).astype(np.int32)
    names = pa.DictionaryArray.from_arrays(pa.array(np.repeat([i for i, _, _ in lines], n).astype(np.int32)), pa.array([c["name"] for c in row["channels"]], pa.string())).cast(pa.string())
    steps = [max(1, row["channels"][i]["y_sampling"]) for i, _, _ in lines]
    again = pa.array(np.tile(np.arange(n), len(lines)))
    cols = [
        own.column("path").take(again), own.column("part_id").take(again), names, _some(np.repeat([y for _, y, _ in lines], n)), _some(np.repeat([(y - (lo + -lo % s)) // s for (_, y, _), s in zip(lines, steps, strict=True)], n)),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), pa.float32())), own.column("chunk_index").take(again), pa.nulls(n * len(lines), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in SCANLINES.split(", ")])


def scanlines(chunks_: DataFrame, names: list[str] | None = None, mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    """Decoded lines: path, part_id, channel, y, sampled_row, values; what can't be decoded is a row with a code.

    names: the channels to keep.  compat: schemes that make halves round as
    functions.pixels.half_bits(compat=True) does.
    """
    wanted, schemes = set(names) if names else None, dict(B.SCHEMES)

    def alone(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Chunk by chunk: chunks that the scan found broken, that keep some lines only, or whose bytes are not as many as expected."""
        out = _Out(SCANLINES, _KINDS)
        for k, row in enumerate(batch.select(list(_NEEDED[:-1])).to_pylist()):
            try:
                if row["code"]:
                    raise H.ExrError(row["code"], "found by the scan")
                rows = []
                for i, y, v in _decoded_lines(row, schemes, batch.column("payload")[k].as_buffer(), wanted, compat):
                    c, lo = row["channels"][i], row["w"]["y_min"]
                    s = max(1, c["y_sampling"])
                    rows.append((row["path"], row["part_id"], c["name"], y, (y - (lo + -lo % s)) // s, v, row["chunk_index"], None))
            except H.ExrError as e:
                if mode == "FAILFAST":
                    raise
                rows = [(row["path"], row["part_id"], None, None, None, None, row["chunk_index"], e.code)]
            full = False
            for r in rows:
                full |= out.add(*r)
            if full:
                yield out.batch()
        yield out.batch()

    def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        payloads, left = batch.column("payload"), []
        for row, rows in _alike(batch):
            planes = _planes(row["channels"], row["w"], row["chunk_y"], row["lines"], compat)
            for run in S.runs_of([max(1, row["expected_size"])] * len(rows), BATCH_BYTES):
                some = rows[run.start : run.stop]
                data = B.decoded_many(schemes.get(row["compression"]), [payloads[int(k)].as_buffer().to_pybytes() for k in some], row["expected_size"], planes)
                good = np.array([d is not None and len(d) == row["expected_size"] for d in data], bool)
                left += some[~good].tolist()  # decoded again by itself, which tells what is wrong
                if good.any():
                    whole = np.frombuffer(b"".join(d for d, g in zip(data, good, strict=True) if g), np.uint8).reshape(int(good.sum()), -1)
                    made = _line_batch(row, planes, wanted, batch.take(pa.array(some[good])), whole)
                    if made is not None:
                        yield made
        if left:
            yield from alone(batch.take(pa.array(left)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pc.and_(pc.and_(batch.column("code").is_null(), batch.column("kept").is_null()), pc.greater(pc.fill_null(batch.column("expected_size"), 0), 0))
            yield from together(batch.filter(plain))
            yield from alone(batch.filter(pc.invert(plain)))

    small_batches(chunks_)
    return chunks_.select(*_NEEDED).mapInArrow(run, SCANLINES)


def sampled_pixels(lines: DataFrame) -> DataFrame:
    """A row a sample: path, part_id, channel, sx, sampled_row, value.  Lines given twice are settled by the scan, so nothing is shuffled."""
    return lines.filter("code IS NULL").select("path", "part_id", "channel", F.posexplode("values").alias("sx", "value"), "sampled_row")


FULL_LINES = "path string, part_id int, channel string, y int, x_min int, values array<float>"


def _full(row: dict, i: int, decoded: dict[int, np.ndarray], spans: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """(y, values) of channel i at full size: the lines whose nearest sampled line lies in spans; 0 where that was not decoded."""
    w, c = row["w"], row["channels"][i]
    xs, ys = max(1, c["x_sampling"]), max(1, c["y_sampling"])
    x0, y0 = w["x_min"] + -w["x_min"] % xs, w["y_min"] + -w["y_min"] % ys
    width, n_x, n_y = w["x_max"] - w["x_min"] + 1, max(0, (w["x_max"] - x0) // xs + 1), max(0, (w["y_max"] - y0) // ys + 1)
    blank = np.zeros(max(0, width), np.float32)
    near = np.clip(np.floor((np.arange(w["x_min"], w["x_max"] + 1) - x0) / xs + 0.5).astype(np.int64), 0, max(0, n_x - 1)) if xs > 1 else None
    for lo, hi in spans:
        for y in range(max(y0, lo + -lo % ys), min(hi, w["y_max"] + 1), ys):
            r = (y - y0) // ys
            v = decoded.get(y)
            v = blank if v is None or not len(v) else v if near is None else v[near]
            first = w["y_min"] if r == 0 else y0 + r * ys - ys // 2
            for at in range(first, w["y_max"] + 1 if r == n_y - 1 else y0 + (r + 1) * ys - ys // 2):
                yield at, v


def _full_chunk(row: dict, schemes: dict, payload: pa.Buffer | None, wanted: set[str] | None, compat: bool, mode: str) -> dict[int, list[tuple[int, np.ndarray]]]:
    """The lines at full size that a chunk row gives, by channel; a row without a chunk gives the lines that no chunk does, and channels without samples."""
    last = {c["name"]: i for i, c in enumerate(row["channels"])}
    own = [i for n, i in last.items() if wanted is None or n in wanted]
    w = row["w"]
    spans = [(s["lo"], s["hi"]) for s in row["kept"]] if row["kept"] is not None else [(row["chunk_y"], row["chunk_y"] + row["lines_per"])]
    decoded: dict[int, dict[int, np.ndarray]] = {i: {} for i in own}
    if row["chunk_index"] is not None:
        try:
            if row["code"]:
                raise H.ExrError(row["code"], "found by the scan")
            for i, y, v in _decoded_lines(row, schemes, payload, wanted, compat):
                decoded[i][y] = v
        except H.ExrError:
            if mode == "FAILFAST":
                raise
            decoded = {i: {} for i in own}
    out = {i: list(_full(row, i, decoded[i], spans)) for i in own}
    if row["chunk_index"] is None:
        for i in own:
            ys = max(1, row["channels"][i]["y_sampling"])
            if w["y_min"] + -w["y_min"] % ys > w["y_max"]:  # no line of it is sampled
                out[i] = [(y, np.zeros(w["x_max"] - w["x_min"] + 1, np.float32)) for y in range(w["y_min"], w["y_max"] + 1)]
    return out


def _full_rows(structured: DataFrame, part_id: int | Column | None) -> DataFrame:
    """Chunk rows of parts that can be decoded, with the rows for lines that no chunk gives.  A chunk whose head can't be read gives no lines, so these are in such a row."""
    rows = _chunk_rows(structured, part_id).filter("part_code IS NULL AND (own IS NULL OR own = part_id) AND (chunk_index IS NULL OR chunk_y IS NOT NULL)")
    return _of_chunk(rows).select(*_NEEDED)


def full_lines(structured: DataFrame, names: list[str] | None = None, part_id: int | Column | None = None, mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    """Every channel at full size: path, part_id, channel, y, x_min, values; each pixel has the nearest sample, and 0 where a line is missing.

    Lines are made where their chunk is decoded, so nothing is shuffled; parts
    that can't be decoded at all have no lines.
    """
    wanted, schemes = set(names) if names else None, dict(B.SCHEMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(FULL_LINES, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), FLOATS))
        for batch in batches:
            for k, row in enumerate(batch.select(list(_NEEDED[:-1])).to_pylist()):
                for i, lines in _full_chunk(row, schemes, batch.column("payload")[k].as_buffer(), wanted, compat, mode).items():
                    for y, v in lines:
                        if out.add(row["path"], row["part_id"], row["channels"][i]["name"], y, row["w"]["x_min"], v):
                            yield out.batch()
        yield out.batch()

    return _full_rows(structured, part_id).mapInArrow(run, FULL_LINES)


COLOUR_LINES = "path string, part_id int, y int, r array<float>, g array<float>, b array<float>, a array<float>"


def colour_lines(structured: DataFrame, names: tuple[str | None, ...] = ("R", "G", "B", "A"), part_id: int | Column | None = None, merged: bool = False, mode: str = "PERMISSIVE", compat: bool = False) -> DataFrame:
    """A row a line: path, part_id, y, and arrays r, g, b, a of the channels of these names (null: not there).

    A chunk holds all channels of its lines, so nothing is shuffled.  Channels
    that skip lines have lines of their own in other chunks: merged puts these
    together, with a shuffle of lines; without it such a part raises.
    """
    schemes = dict(B.SCHEMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(COLOUR_LINES, (pa.string(), pa.int32(), pa.int32(), FLOATS, FLOATS, FLOATS, FLOATS))
        for batch in batches:
            for k, row in enumerate(batch.select(list(_NEEDED[:-1])).to_pylist()):
                if not merged and any(c["name"] in names and c["y_sampling"] > 1 for c in row["channels"]):
                    raise ValueError(f"{row['path']}: a channel skips lines; use merged=True")
                got = _full_chunk(row, schemes, batch.column("payload")[k].as_buffer(), {n for n in names if n}, compat, mode)
                by = {row["channels"][i]["name"]: dict(lines) for i, lines in got.items()}
                for y in sorted({y for lines in by.values() for y in lines}):
                    if out.add(row["path"], row["part_id"], y, *(by.get(n, {}).get(y) for n in names)):
                        yield out.batch()
        yield out.batch()

    lines = _full_rows(structured, part_id).mapInArrow(run, COLOUR_LINES)
    if merged:
        lines = lines.groupBy("path", "part_id", "y").agg(*(F.first(c, ignorenulls=True).alias(c) for c in "rgba"))
    return lines


def expanded_pixels(full: DataFrame) -> DataFrame:
    """full_lines as a row a pixel: path, part_id, channel, x, y, value."""
    each = full.select("path", "part_id", "channel", "x_min", "y", F.posexplode("values").alias("i", "value"))
    return each.select("path", "part_id", "channel", (F.col("x_min") + F.col("i")).alias("x"), "y", "value")


def errors(structured: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, code) of every failure of files, parts and chunks."""
    whole = structured.filter("s.error IS NOT NULL").select("path", "s.error.code")
    return whole.unionByName(lines.filter("code IS NOT NULL").select("path", "code")).distinct()


def events(structured: DataFrame) -> DataFrame:
    """What a scan tells, a row an event: path, seq, phase, level, code."""
    step = lambda code, level="info": F.struct(F.lit("parse").alias("phase"), F.lit(level).alias("level"), F.lit(code).alias("code"))
    bad = F.col("s.error").isNotNull()
    failed = F.when(F.col("s.error.code") == "INVALID_MAGIC", F.array(step("parse.magic.invalid", "error"))).otherwise(F.array(step("parse.error", "error")))
    each_part = F.transform("s.parts", lambda p: step("parse.part.ok"))
    fine = F.concat(F.array(step("parse.magic.ok"), step("parse.version.ok")), each_part, F.array(step("parse.complete")))
    return structured.select("path", F.posexplode(F.when(bad, failed).otherwise(fine)).alias("seq", "e")).select("path", "seq", "e.phase", "e.level", "e.code")


def decode_events(structured: DataFrame, lines: DataFrame | None = None, part_id: int | Column | None = None) -> DataFrame:
    """What decoding tells, a row an event: path, part_id, seq, phase, level, code, chunk_index, n.

    n is the number of chunks (setup, offsets read), the part that a foreign
    chunk names, the bytes after a chunk's last line, or the bytes read
    (complete).  A part that can't be decoded has no complete event: header and
    chunk heads tell that here, and the codes of lines where these are given.
    """
    kind = "struct<level:string,code:string,chunk_index:int,n:bigint>"
    event = lambda level, code, chunk, n: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), chunk.cast("int").alias("chunk_index"), n.cast("long").alias("n"))
    none = F.lit(None)
    rows = _plan_rows(structured, part_id)
    rows = rows.mapInArrow(_header, f"{_planned_schema(rows)}, k {_HEADS}")
    size = lambda k: expected_size(F.col("channels"), F.col("w"), k["chunk_y"], G.lines_in_chunk(k["chunk_y"], F.col("w.y_max"), F.col("lines_per")))
    foreign = lambda k: F.coalesce(k["own"] != F.col("part_id"), F.lit(False))
    heads = F.transform("k", lambda k: F.struct(k["chunk_index"].alias("chunk_index"), k["own"].alias("own"), foreign(k).alias("foreign"), k["code"].alias("code"), k["data_size"].alias("data_size"), F.when(k["code"].isNull() & ~foreign(k) & (F.col("compression") == 0), k["data_size"] - size(k)).alias("trailing")))
    rows = rows.select("path", "part_id", "n_chunks", "part_code", heads.alias("k"))
    bad = F.exists("k", lambda k: ~k["foreign"] & k["code"].isNotNull())
    if lines is not None:
        failed = lines.filter("code IS NOT NULL").groupBy(F.col("path").alias("_path"), F.col("part_id").alias("_part")).agg(F.count("*").alias("failures"))
        rows = rows.join(failed, (F.col("path") == F.col("_path")) & (F.col("part_id") == F.col("_part")), "left")
        bad = bad | F.col("failures").isNotNull()
    setup = F.when(F.col("part_code").isNull() | (F.col("part_code") == "MALFORMED_OFFSET_TABLE"), F.array(event("info", "decode.setup", none, F.col("n_chunks"))))
    offsets = F.when(F.col("part_code").isNull(), F.array(event("info", "decode.offsets.read", none, F.col("n_chunks"))))
    told = F.transform("k", lambda k: F.when(k["foreign"], event("warn", "decode.chunk.part_mismatch", k["chunk_index"], k["own"])).when(k["trailing"] > 0, event("warn", "decode.chunk.trailing_bytes", k["chunk_index"], k["trailing"])))
    read = F.aggregate("k", F.lit(0).cast("long"), lambda a, k: a + F.when(k["foreign"], 0).otherwise(F.coalesce(k["data_size"], F.lit(0))))
    complete = F.when(F.col("part_code").isNull() & ~F.coalesce(bad, F.lit(False)), F.array(event("info", "decode.complete", none, read)))
    empty = F.array().cast(f"array<{kind}>")
    all_ = F.concat(*(F.coalesce(e.cast(f"array<{kind}>"), empty) for e in (setup, offsets, F.filter(told, lambda e: e.isNotNull()), complete)))
    return rows.select("path", "part_id", F.posexplode(all_).alias("seq", "e")).select("path", "part_id", "seq", F.lit("decode").alias("phase"), "e.level", "e.code", "e.chunk_index", "e.n")


def log_entries(told: DataFrame) -> DataFrame:
    """Events as entries of a log, with step, status and description beside their own columns."""
    return told.withColumn("step", F.concat_ws(".", "phase", "code")).withColumn("status", status_of(F.col("level"))).withColumn("description", F.col("code"))


def decoded_bytes(structured: DataFrame) -> DataFrame:
    """(path, part_id, decoded_bytes): what the float32 planes of each part's channels take; of channels of one name the last counts."""
    c = channels(structured).groupBy("path", "part_id", "name").agg(F.max_by(F.struct("sampled_width", "sampled_height"), "ordinal").alias("c"))
    return c.groupBy("path", "part_id").agg(F.sum(F.lit(4).cast("long") * F.col("c.sampled_width") * F.col("c.sampled_height")).alias("decoded_bytes"))
