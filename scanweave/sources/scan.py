"""Offset tables and chunk heads, read in array operations from bytes in memory or from a file by offset."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs

#: The largest offset that counts (2**53 - 1).
MOST = (1 << 53) - 1
#: Ranges of a file that lie no farther apart are one read, up to a number of bytes: for payloads (a chunk's head lies between), and for heads.
GAP, HEAD_GAP, READ = 12, 512, 8 << 20


class Memory:
    """The bytes of a file that is in memory, without copies."""

    def __init__(self, content: pa.Buffer | bytes):
        self.bytes = np.frombuffer(content, np.uint8)
        self.length = len(self.bytes)

    def read(self, at: int, n: int) -> memoryview:
        return self.bytes[at : at + n].data

    def rows(self, at: np.ndarray, n: int) -> np.ndarray:
        """n bytes at each place, a row each."""
        return self.bytes[at[:, None] + np.arange(n)]


class Ranges:
    """A file that is read by offset; counts the bytes that were read.

    The path is local, or a URI of a store that Arrow's file systems know.
    """

    def __init__(self, path: str, length: int | None = None):
        if "://" in path or path.startswith("file:"):
            system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        else:
            system, name = fs.LocalFileSystem(), path
        self.file = system.open_input_file(name)
        self.length = self.file.size() if length is None else length
        self.read_bytes = 0

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> memoryview:
        self.read_bytes += n
        return memoryview(self.file.read_at(n, at))

    def many(self, at: np.ndarray, sizes: np.ndarray, gap: int = GAP) -> list[memoryview]:
        """The bytes of each range; neighbours are read together."""
        out: list[memoryview] = [memoryview(b"")] * len(at)
        order = np.argsort(at, kind="stable").tolist()
        first = 0
        while first < len(order):
            begin = int(at[order[first]])
            end, last = begin + int(sizes[order[first]]), first + 1
            while last < len(order) and at[order[last]] <= end + gap and at[order[last]] + sizes[order[last]] - begin <= READ:
                end, last = max(end, int(at[order[last]] + sizes[order[last]])), last + 1
            block = self.read(begin, end - begin)
            for i in order[first:last]:
                out[i] = block[int(at[i]) - begin : int(at[i] + sizes[i]) - begin]
            first = last
        return out

    def rows(self, at: np.ndarray, n: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.many(at, np.full(len(at), n), HEAD_GAP)), np.uint8).reshape(len(at), n)


@dataclass
class Heads:
    """The chunks of a part, as arrays: their place in the file, the part that they name, first line, size of the payload, and errors.

    Of a chunk whose head is not within the file, own, y and size mean nothing (safe is False).
    """

    at: np.ndarray
    known: np.ndarray
    safe: np.ndarray
    own: np.ndarray
    y: np.ndarray
    size: np.ndarray
    fits: np.ndarray
    head: int

    def code(self, i: int) -> str | None:
        return "MALFORMED_OFFSET_TABLE" if not self.known[i] else None if self.fits[i] else "MALFORMED_CHUNK"

    def place(self, i: int) -> int:
        """Where a chunk's payload begins."""
        return int(self.at[i]) + self.head


def heads(source: Memory | Ranges, table_at: int, n: int, multi: bool, part_id: int) -> Heads:
    """The n chunks whose offsets stand at table_at."""
    head = 12 if multi else 8
    offsets = np.frombuffer(source.read(table_at, 8 * n), "<u8")
    known = offsets <= MOST
    at = np.where(known, offsets, 0).astype(np.int64)
    safe = known & (at + head <= source.length)
    words = np.zeros((n, head // 4), np.int64)
    words[safe] = np.ascontiguousarray(source.rows(at[safe], head)).view("<i4")
    own = words[:, 0] if multi else np.full(n, part_id)
    y, size = words[:, -2], words[:, -1]
    return Heads(at, known, safe, own, y, size, safe & (size >= 0) & (at + head + size <= source.length), head)


def last_writers(ys: list[int], lines: int) -> list[list[tuple[int, int]]]:
    """For chunks of `lines` lines each, the spans of lines (end not included) that no later chunk of the list holds.

    A sweep over the chunks' ends, from above: between two neighbouring ends the
    latest of the chunks that are open has the lines.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in ys]
    begins = sorted(range(len(ys)), key=lambda i: ys[i])
    bounds = sorted({b for y in ys for b in (y, y + lines)})
    open_: list[int] = []
    at = 0
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        while at < len(begins) and ys[begins[at]] == lo:
            heapq.heappush(open_, -begins[at])
            at += 1
        while open_ and ys[-open_[0]] + lines <= lo:
            heapq.heappop(open_)
        if open_:
            spans = out[-open_[0]]
            if spans and spans[-1][1] == lo:
                spans[-1] = (spans[-1][0], hi)
            else:
                spans.append((lo, hi))
    return out


def kept_spans(found: Heads, part_id: int, y_min: int, lines: int) -> dict[int, list[tuple[int, int]]] | None:
    """The lines that each chunk of the part gives, of lines given twice the later chunk's count; None if the chunks stand on the usual grid, where all do."""
    mine = found.own == part_id
    if bool((found.safe & mine).all()) and len(np.unique(found.y)) == len(found.y) and not ((found.y - y_min) % lines).any():
        return None
    own = np.flatnonzero(found.safe & mine).tolist()
    return dict(zip(own, last_writers([int(found.y[i]) for i in own], lines), strict=True))


def gaps(found: Heads | None, part_id: int, y_min: int, y_max: int, lines: int) -> list[tuple[int, int]]:
    """The lines of a window that no chunk of the part gives."""
    at, out = y_min, []
    ys = np.unique(found.y[found.safe & (found.own == part_id)]).tolist() if found else []
    for y in ys:
        if y + lines <= at:
            continue
        if min(y, y_max + 1) > at:
            out.append((at, min(y, y_max + 1)))
        at = max(at, y + lines)
    return [*out, (at, y_max + 1)] if at <= y_max else out


def binaries(parts: list[memoryview | None]) -> pa.Array:
    """A binary column of these values; each is copied once."""
    sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = np.packbits([p is not None for p in parts], bitorder="little").tobytes()
    data = b"".join(p for p in parts if p is not None)
    return pa.Array.from_buffers(pa.binary(), len(parts), [pa.py_buffer(mask), pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def runs_of(sizes: list[int], most: int = 1 << 20, rows: int = 4096) -> list[range]:
    """Numbers in runs whose sizes add up to `most` at most, or of one."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and (total + n > most or i - first >= rows):
            out.append(range(first, i))
            first, total = i, 0
        total += n
    return [*out, range(first, len(sizes))] if sizes else out
