"""A sink: rows of scanlines to image files, as content of one row a file.

Lines are encoded by all schemes of the format.  A chunk that does not get
smaller is stored raw.  B44 blocks keep the finest step that 6 bits of
difference allow; the transform scheme keeps all coefficients as halves.
"""

from __future__ import annotations

import heapq
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.sources import dwa
from scanweave.sources.blocks import FLOAT, HALF, SCHEMES
from scanweave.sources.header import MAGIC, MULTIPART
from scanweave.sources.piz import canonical
from scanweave.sources.scan import runs_of


def _attribute(name: str, kind: str, raw: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(raw)) + raw


def header(width: int, height: int, compression: int, channels: list[tuple[str, int, int, int]], extra: bytes = b"") -> bytes:
    """channels: name, pixel type and samplings."""
    return _header(width, height, compression, tuple(channels), extra)


@lru_cache(64)
def _header(width: int, height: int, compression: int, channels: tuple[tuple[str, int, int, int], ...], extra: bytes) -> bytes:
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    listed = b"".join(n.encode() + b"\0" + struct.pack("<iB3xii", kind, 0, xs, ys) for n, kind, xs, ys in channels) + b"\0"
    return _attribute("channels", "chlist", listed) + _attribute("compression", "compression", bytes([compression])) + _attribute("dataWindow", "box2i", box) + _attribute("displayWindow", "box2i", box) + _attribute("lineOrder", "lineOrder", b"\0") + extra + b"\0"


def _predicted(raw: bytes) -> bytes:
    return _predicted_rows(np.frombuffer(raw, np.uint8)[None]).tobytes()


def _predicted_rows(rows: np.ndarray) -> np.ndarray:
    """The predictor on each row of bytes."""
    flat = np.concatenate([rows[:, 0::2], rows[:, 1::2]], 1)
    out = flat.copy()
    out[:, 1:] -= flat[:, :-1]  # modulo 256
    out[:, 1:] += 128
    return out


def _runs(raw: bytes) -> bytes:
    return _runs_rows(np.frombuffer(raw, np.uint8)[None])[0]


def _runs_rows(rows: np.ndarray) -> list[bytes]:
    """Of each row of bytes: three or more equal bytes are a run, up to 128 at a time; what stands between runs is literal, up to 127 at a time."""
    n, width = rows.shape
    if not rows.size:
        return [b""] * n
    b = np.ascontiguousarray(rows).ravel()
    change = np.ones(len(b), bool)
    change[1:] = b[1:] != b[:-1]
    change[::width] = True
    at = np.flatnonzero(change)
    run = np.diff(at, append=len(b)) >= 3
    begins = run | (at % width == 0)  # shorter ones that follow each other are one stretch
    begins[1:] |= run[:-1]
    start, run = at[begins], run[begins]
    size = np.diff(start, append=len(b))
    most = np.where(run, 128, 127)
    k, of = _pieces(-(-size // most))
    start, run, size = start[of] + k * most[of], run[of], np.minimum(size[of] - k * most[of], most[of])
    taken = np.where(run, 2, size + 1)
    ends = np.cumsum(taken)
    to = ends - taken
    out = np.empty(int(ends[-1]), np.uint8)
    out[to] = np.where(run, size - 1, 256 - size)
    k, of = _pieces(np.where(run, 1, size))
    out[to[of] + 1 + k] = b[start[of] + k]
    last = np.searchsorted(start, np.arange(1, n + 1) * width) - 1  # each row's last piece
    whole, bounds = out.tobytes(), [0, *ends[last].tolist()]
    return [whole[lo:hi] for lo, hi in zip(bounds, bounds[1:], strict=False)]


def _raw(planes: list[np.ndarray]) -> bytes:
    """For each line, the samples of all channels."""
    rows = [np.ascontiguousarray(p).view(np.uint8) for p in planes]
    return (np.concatenate(rows, 1) if len(rows) > 1 else rows[0]).tobytes() if rows else b""


def _pxr24(planes: list[np.ndarray], kinds: list[int]) -> bytes:
    out = []
    for v, kind in zip(planes, kinds, strict=True):
        u = np.ascontiguousarray(v).view("<u2" if kind == HALF else "<u4")
        u = u >> 8 if kind == FLOAT else u
        d = u.copy()
        d[:, 1:] -= u[:, :-1]  # modulo 2**16 or 2**32, of which the lowest bytes count
        w = {HALF: 2, FLOAT: 3}.get(kind, 4)
        each = d.astype(u.dtype.newbyteorder(">")).view(np.uint8).reshape(*d.shape, -1)[:, :, -w:]
        out.append(each.transpose(0, 2, 1).reshape(len(d), -1))
    return zlib.compress(np.concatenate(out, 1).tobytes())


def _b44(planes: list[np.ndarray], kinds: list[int], flat: bool) -> bytes:
    """4 x 4 blocks of halves; flat: blocks of one value take 3 bytes."""
    out = []
    for plane, kind in zip(planes, kinds, strict=True):
        if kind != HALF:
            out.append(plane.tobytes())
            continue
        bits = np.ascontiguousarray(plane).view("<u2").astype(np.int64)
        codes = np.where(bits & 0x8000, ~bits & 0xFFFF, bits | 0x8000)
        codes = np.pad(codes, ((0, -codes.shape[0] % 4), (0, -codes.shape[1] % 4)), mode="edge")
        blocks = codes.reshape(codes.shape[0] // 4, 4, -1, 4).transpose(0, 2, 1, 3).reshape(-1, 16)
        whole = _b44_blocks(blocks)
        short = (blocks == blocks[:, :1]).all(1) if flat else np.zeros(len(blocks), bool)
        if (whole[~short, 2] >> 2 > 12).any():
            raise ValueError("a block's values lie too far apart")
        whole[short, 2] = 13 << 2
        out.append(whole[np.arange(14) < np.where(short, 3, 14)[:, None]].tobytes())
    return b"".join(out)


#: Which values of a block each difference is taken of, in the order in which they are stored.
_OF, _FROM = np.array([(4, 0), (8, 4), (12, 8)] + [(x + y, x + y - 1) for x in (1, 2, 3) for y in (0, 4, 8, 12)]).T


def _b44_blocks(blocks: np.ndarray) -> np.ndarray:
    """14 bytes of each block, with the least shift that lets all its differences fit into 6 bits (13 if none does)."""
    first = blocks[:, :1]
    shift, deltas, left = np.full(len(blocks), 13), np.zeros((len(blocks), 15), np.int64), np.arange(len(blocks))
    for n in range(13):
        t, f = blocks[left], first[left]
        q = np.clip(np.rint((t - f) / (1 << n)), -(f >> n), 0xFFFF - f >> n).astype(np.int64)
        d = q[:, _OF] - q[:, _FROM] + 32
        fits = ((d >= 0) & (d < 64)).all(1)
        shift[left[fits]], deltas[left[fits]] = n, d[fits]
        left = left[~fits]
        if not len(left):
            break
    bits = np.concatenate([shift[:, None], deltas], 1)
    bits = (bits[:, :, None] >> np.arange(5, -1, -1) & 1).astype(np.uint8).reshape(len(blocks), 96)
    return np.concatenate([blocks[:, :1] >> 8, blocks[:, :1] & 255, np.packbits(bits, axis=1)], 1).astype(np.uint8)


def _nonlinear(v: np.ndarray) -> np.ndarray:
    a = np.abs(v)
    return np.copysign(np.where(a <= 1, a ** (1 / 2.2), 1 + np.log(np.maximum(a, 1)) / np.log(dwa.BASE)), v)


def _blocks_of(plane: np.ndarray) -> np.ndarray:
    """8 x 8 blocks of a plane, its edges repeated."""
    p = np.pad(plane, ((0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def _ac(blocks: np.ndarray) -> np.ndarray:
    """The coefficients of blocks but for their first ones, as a stream: those that are not 0, with a skip before one that follows zeros, and a mark where a block ends in zeros."""
    block, place = np.nonzero(blocks[:, 1:])
    place += 1
    before = np.empty_like(place)  # the place after the coefficient before, or the first one
    before[1:] = place[:-1] + 1
    first = np.flatnonzero(np.diff(block, prepend=-1))
    before[first] = 1
    last = np.zeros(len(blocks), np.int64)
    np.maximum.at(last, block, place)
    # three words at most of each coefficient's turn: the skip and the coefficient; of each block's: its mark
    order = np.concatenate([block * 256 + 2 * place, block * 256 + 2 * place + 1, np.flatnonzero(last < 63) * 256 + 255])
    values = np.concatenate([0xFF00 | place - before, blocks[block, place], np.full(int((last < 63).sum()), dwa.END_OF_BLOCK)])
    there = np.concatenate([place > before, np.ones(len(values) - len(place), bool)])
    return values[there][np.argsort(order[there], kind="stable")]


def _stacked(lines: list[list[np.ndarray]], kinds: list[int]) -> list[np.ndarray]:
    return [np.stack([line[c] for line in lines]) for c in range(len(kinds))]


def _dwa(lines: list[list[np.ndarray]], kinds: list[int], names: list[str], version: int = 2, mode: int = dwa.DEFLATE) -> bytes:
    return _transformed(_stacked(lines, kinds), kinds, names, version, mode)


def _transformed(planes: list[np.ndarray], kinds: list[int], names: list[str], version: int = 2, mode: int = dwa.DEFLATE) -> bytes:
    """A chunk of the transform scheme, with the rules of version 1 by name."""
    rules = dwa.rules_of_version_1()
    schemes, triple = dwa.matched(names, kinds, rules)
    groups = [[triple[i] for i in range(3)]] if set(triple) == {0, 1, 2} else []
    groups += [[i] for i, s in enumerate(schemes) if s == dwa.LOSSY and not (groups and i in groups[0])]
    ac, dc = [], []
    for group in groups:
        values = [_nonlinear(planes[i].astype(float)) for i in group]
        if len(values) == 3:  # luma and two chroma values from red, green and blue
            back = np.linalg.inv(np.array([[1, 0, 1.5747], [1, -0.1873, -0.4682], [1, 1.8556, 0]]))
            values = list(np.einsum("ij,jyx->iyx", back, np.stack(values)))
        coded = np.stack([dwa.BASIS @ _blocks_of(v) @ dwa.BASIS.T for v in values], 1)
        words = coded.reshape(-1, len(group), 64)[:, :, dwa.ZIGZAG].astype("<f2").view("<u2")
        words = np.where(words >> 8 == 0xFF, 0, words)
        dc.append(words[:, :, 0].T.ravel())
        ac.append(_ac(words.reshape(-1, 64)))
    words = np.concatenate(ac).astype("<u2") if ac else np.zeros(0, "<u2")
    coded_ac = (_huffed(words) if mode == dwa.HUFFMAN else zlib.compress(words.tobytes())) if len(words) else b""
    firsts = np.concatenate(dc).astype("<u2") if dc else np.zeros(0, "<u2")
    coded_dc = zlib.compress(_predicted(firsts.tobytes())) if len(firsts) else b""
    raw = b"".join(np.ascontiguousarray(planes[i]).view(np.uint8).reshape(planes[i].size, -1).T.tobytes() for i, s in enumerate(schemes) if s == dwa.RUNS)
    runs = _runs(raw)
    coded_runs = zlib.compress(runs) if raw else b""
    table = b"".join(n.encode() + bytes([0, int(fold) | s << 2 | csc + 1 << 4, kind]) for n, s, csc, kind, fold in rules)
    head = struct.pack("<11q", version, 0, 0, len(coded_ac), len(coded_dc), len(coded_runs), len(runs) if raw else 0, len(raw), len(words), len(firsts), mode)
    return head + (struct.pack("<H", len(table) + 2) + table if version == 2 else b"") + coded_ac + coded_dc + coded_runs


def _waved(plane: np.ndarray, narrow: bool) -> np.ndarray:
    """The wavelet of a plane of words, from the finest step up."""

    def pair(a, b):
        if narrow:
            a, b = (((x + 0x8000) & 0xFFFF) - 0x8000 for x in (a, b))
            return (a + b) >> 1 & 0xFFFF, (a - b) & 0xFFFF
        a = (a + 0x8000) & 0xFFFF
        mean, d = (a + b) >> 1, a - b
        return np.where(d < 0, mean + 0x8000, mean) & 0xFFFF, d & 0xFFFF

    (down, across), step = plane.shape, 1
    while 2 * step <= min(down, across):
        n_y, n_x = down // (2 * step), across // (2 * step)
        y, x = slice(0, n_y * 2 * step, 2 * step), slice(0, n_x * 2 * step, 2 * step)
        y1, x1 = slice(step, n_y * 2 * step, 2 * step), slice(step, n_x * 2 * step, 2 * step)
        top, top_right = pair(plane[y, x], plane[y, x1])
        low, low_right = pair(plane[y1, x], plane[y1, x1])
        plane[y, x], plane[y1, x] = pair(top, low)
        plane[y, x1], plane[y1, x1] = pair(top_right, low_right)
        if across & step:
            last = n_x * 2 * step
            plane[y, last], plane[y1, last] = pair(plane[y, last], plane[y1, last])
        if down & step:
            last = n_y * 2 * step
            plane[last, x], plane[last, x1] = pair(plane[last, x], plane[last, x1])
        step *= 2
    return plane


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman's code lengths: the two rarest groups are joined, again and again; a symbol's length is its depth in the tree."""
    symbols = list(counts)
    heap = [(n, s, i) for i, (s, n) in enumerate(counts.items())]
    heapq.heapify(heap)
    if len(heap) == 1:
        return dict.fromkeys(counts, 1)
    above: list[int] = [0] * (2 * len(symbols) - 1)
    for joined in range(len(symbols), 2 * len(symbols) - 1):
        (n, _, a), (m, tie, b) = heapq.heappop(heap), heapq.heappop(heap)
        above[a] = above[b] = joined
        heapq.heappush(heap, (n + m, tie, joined))
    depth = [0] * len(above)
    for i in range(len(above) - 2, -1, -1):
        depth[i] = depth[above[i]] + 1
    return {s: depth[i] for i, s in enumerate(symbols)}


def _bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers one after the other, of so many bits each (63 at most), the highest first."""
    below = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(int(sizes.sum()))
    return np.packbits((np.repeat(values, sizes) >> below & 1).astype(np.uint8)).tobytes()


def _pieces(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of these counts, the numbers 0, 1, 2 ... below it; and whose they are."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - (np.cumsum(counts) - counts)[of], of


def _lengths_table(symbols: np.ndarray, sizes: np.ndarray) -> bytes:
    """Code lengths from the first symbol to the last; symbols without a code between them are told as runs."""
    gaps = np.diff(symbols, prepend=symbols[0] - 1) - 1
    k, of = _pieces(-(-gaps // 261) + 1)
    take = np.minimum(gaps[of] - 261 * k, 261)
    own = k == -(-gaps[of] // 261)  # after the runs before it comes the symbol itself
    value = np.where(own, sizes[of], np.where(take >= 6, 63 << 8 | take - 6, np.where(take > 1, take + 57, 0)))
    return _bits(value, np.where(~own & (take >= 6), 14, 6))


def _huffed(words: np.ndarray) -> bytes:
    """Huffman codes of words; repeats of a word as runs."""
    edges = np.flatnonzero(np.diff(words.astype(int), prepend=-1, append=-1))
    heads, sizes = words[edges[:-1]].astype(np.int64), np.diff(edges)
    found, first, n = np.unique(heads, return_index=True, return_counts=True)
    runs = -(-(sizes - 1) // 255)
    least, most = int(found[0]), int(found[-1]) + 1
    order = np.argsort(first)
    counts = {most: 1 + int(runs.sum())} | dict(zip(found[order].tolist(), n[order].tolist(), strict=True))
    symbols, lengths, codes = canonical(_code_lengths(counts))
    at = np.searchsorted(symbols, heads)
    k, of = _pieces(1 + 2 * runs)  # a word's code; then for each run the greatest symbol's and a number
    number, again = (k > 0) & (k % 2 == 0), k % 2 == 1
    value = np.where(number, np.minimum(sizes[of] - 1 - 255 * (k // 2 - 1), 255), np.where(again, codes[-1], codes[at[of]]))
    taken = np.where(number, 8, np.where(again, lengths[-1], lengths[at[of]]))
    return struct.pack("<5I", least, most, 0, int(taken.sum()), 0) + _lengths_table(symbols, lengths) + _bits(value, taken)


def _piz(lines: list[list[np.ndarray]], kinds: list[int]) -> bytes:
    return _wavelets(_stacked(lines, kinds))


def _wavelets(planes: list[np.ndarray]) -> bytes:
    words = [np.ascontiguousarray(p).view("<u2").astype(np.int64).reshape(*p.shape, -1) for p in planes]
    present = np.union1d(np.concatenate([w.ravel() for w in words]), [0])
    least, most = (int(present[1]) >> 3, int(present[-1]) >> 3) if len(present) > 1 else (8191, 0)
    flags = np.zeros(8 * max(0, most - least + 1), bool)
    flags[present[1:] - 8 * least] = True
    bitmap = np.packbits(flags, bitorder="little").tobytes()
    flat = []
    for w in words:
        w = np.searchsorted(present, w)
        for k in range(w.shape[2]):
            w[:, :, k] = _waved(w[:, :, k].copy(), len(present) - 1 < 1 << 14)
        flat.append(w.ravel())
    codes = _huffed(np.concatenate(flat).astype(np.uint16))
    return struct.pack("<2H", least, most) + bitmap + struct.pack("<I", len(codes)) + codes


def coded(planes: list[np.ndarray], kinds: list[int], names: list[str], compression: int, **options: int) -> bytes:
    """The payload of one chunk, given the lines of each channel: coded, or raw where that is not smaller."""
    raw = _raw(planes)
    if not raw:
        return raw
    ways = {
        1: lambda: _runs(_predicted(raw)),
        2: lambda: zlib.compress(_predicted(raw)),
        3: lambda: zlib.compress(_predicted(raw)),
        4: lambda: _wavelets(planes),
        5: lambda: _pxr24(planes, kinds),
        6: lambda: _b44(planes, kinds, False),
        7: lambda: _b44(planes, kinds, True),
        8: lambda: _transformed(planes, kinds, names, **options),
        9: lambda: _transformed(planes, kinds, names, **options),
    }
    small = ways.get(compression, lambda: raw)()
    return small if len(small) < len(raw) else raw


def _coded_lines(planes: list[np.ndarray], compression: int) -> list[bytes]:
    """The payloads of chunks of one line each, of all lines at once, by the schemes RLE and ZIPS."""
    raw = np.frombuffer(_raw(planes), np.uint8).reshape(len(planes[0]), -1)
    rows = _predicted_rows(raw)
    small = _runs_rows(rows) if compression == 1 else [zlib.compress(r) for r in rows]
    return [p if len(p) < raw.shape[1] else r.tobytes() for p, r in zip(small, raw, strict=True)]


def encoded(planes: list[np.ndarray], kinds: list[int], names: list[str], compression: int, sampling: int = 1, size: tuple[int, int] | None = None, extra: bytes = b"", **options: int) -> bytes:
    """A file of one part; planes are rows of samples of their kind ('<f2', '<f4' or '<u4')."""
    height, width = size or planes[0].shape
    head = struct.pack("<II", MAGIC, 2) + header(width, height, compression, [(n, k, sampling, sampling) for n, k in zip(names, kinds, strict=True)], extra)
    return _file(head, [_chunks(planes, kinds, names, compression, height, sampling, **options)], None)


def _chunks(planes: list[np.ndarray], kinds: list[int], names: list[str], compression: int, height: int, sampling: int = 1, **options: int) -> list[tuple[int, bytes]]:
    """(first line, payload) of each chunk."""
    per = SCHEMES[compression].lines if compression in SCHEMES else 1
    if compression in (1, 2) and sampling == 1 and planes and all(p.shape[0] == height and p.size for p in planes):
        return list(enumerate(_coded_lines(planes, compression)))
    each = lambda top: [p[-(-top // sampling) : -(-min(top + per, height) // sampling)] for p in planes]
    return [(top, coded(each(top), kinds, names, compression, **options)) for top in range(0, height, per)]


def _file(head: bytes, parts: list[list[tuple[int, bytes]]], numbers: list[int] | None) -> bytes:
    """Header, offset tables and chunks; numbers: what the chunks of each part say that their part is (None: a file of one part)."""
    mark = lambda i: b"" if numbers is None else struct.pack("<i", numbers[i])
    blocks = [mark(i) + struct.pack("<ii", y, len(payload)) + payload for i, part in enumerate(parts) for y, payload in part]
    at, table = len(head) + 8 * len(blocks), b""
    for b in blocks:
        table += struct.pack("<Q", at)
        at += len(b)
    return head + table + b"".join(blocks)


def multipart(parts: list[tuple[list[np.ndarray], list[int], list[str], int]], numbers: list[int] | None = None) -> bytes:
    """A file of several parts (planes, kinds, names, compression); numbers: what their chunks say, if not 0, 1, 2 ..."""
    head, own = struct.pack("<II", MAGIC, 2 | MULTIPART << 8), []
    for i, (planes, kinds, names, compression) in enumerate(parts):
        height, width = planes[0].shape
        extra = _attribute("name", "string", f"part{i}".encode()) + _attribute("type", "string", b"scanlineimage")
        head += header(width, height, compression, [(n, k, 1, 1) for n, k in zip(names, kinds, strict=True)], extra)
        own.append(_chunks(planes, kinds, names, compression, height))
    return _file(head + b"\0", own, numbers or list(range(len(parts))))


FORMS = {HALF: "<f2", FLOAT: "<f4"}


#: Bytes of the batches of rows that go to Python at once, at most; a longer row is a batch by itself.
BATCH_BYTES = 1 << 20
#: Bytes of rows, and of the files made of them, that a task remembers at most.
MEMO_BYTES = 4 << 20


def small_batches(rows: DataFrame) -> DataFrame:
    """Bound what a Python worker holds of rows at once, in this session (Spark's own bound is 10,000 rows of any size)."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return rows


def spread(images: DataFrame) -> DataFrame:
    """A table, dealt to as many tasks as run at once, or as it has partitions: to encode and decode an image costs far more than to move its row.

    All tables are dealt, as a file is read in as many partitions as its bytes
    ask for, but all rows of one of its row groups go to one of them.
    """
    n = images.sparkSession.sparkContext.defaultParallelism
    return images.repartition(max(n, images.rdd.getNumPartitions()))


def made(rows: DataFrame, path: Column, columns: list[Column], make: Callable[..., bytes]) -> DataFrame:
    """(path, length, content): a file for each row, made of the values of columns (arrays as arrays of numbers).

    Rows are dealt to the tasks before the columns are made of them.  Files are
    made once: nothing that is asked of them later is pushed below this step.
    Rows of a task that have the same values share one call of make, as long as
    MEMO_BYTES hold them.
    """
    if not rows.isStreaming:
        rows = spread(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, bytes] = {}
        held = 0
        for batch in batches:
            values = [_values(c) for c in batch.columns[1:]]
            content = []
            for row in zip(*values, strict=True):
                same = tuple(v.tobytes() if isinstance(v, np.ndarray) else v for v in row)
                one = done.get(same)
                if one is None:
                    one = make(*row)
                    held += len(one) + sum(len(v) if isinstance(v, bytes) else 64 for v in same)
                    if held > MEMO_BYTES:
                        done.clear()
                        held = len(one) + sum(len(v) if isinstance(v, bytes) else 64 for v in same)
                    done[same] = one
                content.append(one)
            for run in runs_of([len(c) for c in content], BATCH_BYTES):
                own = content[run.start : run.stop]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.start, len(own)), pa.array([len(c) for c in own], pa.int64()), pa.array(own, pa.binary())], names=["path", "length", "content"])

    given = rows.select(path.alias("path"), *(c.alias(f"c{i}") for i, c in enumerate(columns)))
    return small_batches(given).mapInArrow(write, "path string, length long, content binary")


def _values(column: pa.Array) -> list:
    """The rows of a column: parts of one array where they are lists."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def image_name(key: str) -> Column:
    return F.concat(F.lit("image/"), F.col(key).cast("string"), F.lit(".exr"))


def _column(values: str | Column) -> Column:
    return F.col(values) if isinstance(values, str) else values


def image_files(images: DataFrame, key: str, channels: list[tuple[str, int, str | Column]], width: int, compression: int, **options: int) -> DataFrame:
    """(path, length, content): a file for each row; channels are (name, pixel type, column of row-major values)."""
    names, kinds = [c[0] for c in channels], [c[1] for c in channels]

    def make(*row: np.ndarray) -> bytes:
        planes = [v.astype(FORMS.get(k, "<u4")).reshape(-1, width) for v, k in zip(row, kinds, strict=True)]
        return encoded(planes, kinds, names, compression, **options)

    return made(images, image_name(key), [_column(c[2]) for c in channels], make)


def single_channel_files(images: DataFrame, key: str, values: str | Column, width: int, kind: int, compression: int, name: str = "Y") -> DataFrame:
    """A file for each row, of one channel whose row-major values are an array."""
    return image_files(images, key, [(name, kind, values)], width, compression)


def multipart_files(images: DataFrame, key: str, parts: list[tuple[str, int, str | Column, int]], width: int, numbers: list[int] | None = None) -> DataFrame:
    """A file of several parts for each row; parts are (channel, pixel type, column, compression)."""

    kinds = [(n, k, c) for n, k, _, c in parts]

    def make(*row: np.ndarray) -> bytes:
        own = [([v.astype(FORMS.get(k, "<u4")).reshape(-1, width)], [k], [n], c) for v, (n, k, c) in zip(row, kinds, strict=True)]
        return multipart(own, numbers)

    return made(images, image_name(key), [_column(p[2]) for p in parts], make)


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Write files (path, content) below a folder, each by one task; (path, name, length) of what was written, once it is asked for.

    A file is written under a name of its own and then renamed, so a repeated
    task leaves a whole file with the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column("path").to_pylist()
            for i, name in enumerate(names):
                at, part = f"{root}/{name}", f"{root}/{name}.{uuid.uuid4().hex}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(batch.column("content")[i].as_buffer())
                system.move(part, at)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), batch.column("path"), pa.array([len(c.as_buffer()) for c in batch.column("content")], pa.int64())], names=["path", "name", "length"])

    return files.select("path", "content").mapInArrow(write, "path string, name string, length long")
