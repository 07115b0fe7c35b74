"""Bytes of compressed chunks to bytes of scanlines: small kernels over NumPy, one a scheme.

The registry can be extended: register() adds a scheme under its number.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from scanweave.sources.dwa import planes_of as transform_planes
from scanweave.sources.halves import half_bits
from scanweave.sources.header import ExrError
from scanweave.sources.piz import words as wavelet_words
from scanweave.sources.scan import runs_of

UINT, HALF, FLOAT = 0, 1, 2


@dataclass(frozen=True)
class Plane:
    """A channel's part in a chunk: its samples stand in `rows` rows of `width`; ys are the lines they belong to."""

    kind: int
    linear: int
    width: int
    ys: tuple[int, ...]
    name: str = ""
    whole: bool = True  # sampled at every pixel
    compat: bool = False  # halves that a scheme makes round as half_bits(compat) does

    @property
    def size(self) -> int:
        return 2 if self.kind == HALF else 4


Kernel = Callable[[bytes, int, list[Plane]], bytes]


def _unpredicted(raw: np.ndarray) -> bytes:
    """Undo the predictor, then put the two halves of the bytes in turn."""
    return _unpredicted_rows(raw[None]).tobytes()


def _unpredicted_rows(rows: np.ndarray) -> np.ndarray:
    n = rows.shape[1]
    steps = rows.astype(np.uint8)
    steps[:, 1:] -= 128
    flat = np.cumsum(steps, axis=1, dtype=np.uint8)  # modulo 256
    out = np.empty(rows.shape, np.uint8)
    out[:, 0::2], out[:, 1::2] = flat[:, : (n + 1) // 2], flat[:, (n + 1) // 2 :]
    return out


def _inflated(payload: bytes, expected: int) -> bytes:
    out = zlib.decompress(payload)
    if len(out) != expected:
        raise ValueError(f"{len(out)} bytes instead of {expected}")
    return out


def run_lengths(payload: bytes, expected: int) -> bytes:
    """A signed count, then as many literal bytes (count below 0) or one byte to repeat count + 1 times."""
    out, at = bytearray(), 0
    while at < len(payload):
        n = payload[at] - 256 if payload[at] > 127 else payload[at]
        take = -n if n < 0 else 1
        got = payload[at + 1 : at + 1 + take]
        if len(got) < take:
            raise ValueError("a run is cut short")
        out += got if n < 0 else got * (n + 1)
        at += 1 + take
    if len(out) != expected:
        raise ValueError(f"{len(out)} bytes instead of {expected}")
    return bytes(out)


def run_lengths_many(payloads: list[bytes], expected: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes, which of the payloads they are) of run lengths that give the expected number of bytes; all payloads go on by one run at a time."""
    b = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.array([len(p) for p in payloads])
    ends = np.cumsum(size)
    at, filled = ends - size, np.zeros(len(payloads), np.int64)
    times = np.ones(len(b), np.int64)  # how often each byte stands in the rows
    left = np.flatnonzero(size > 0)
    while len(left):
        head = at[left]
        n = b[head].astype(np.int64)
        literal = n > 127
        n = np.where(literal, 256 - n, n + 1)
        times[head] = 0
        at[left] += np.where(literal, n, 1) + 1
        whole = at[left] <= ends[left]
        filled[left] = np.where(whole, filled[left] + n, expected + 1)  # one that is cut short never fits
        run = whole & ~literal
        times[head[run] + 1] = n[run]
        left = left[(at[left] < ends[left]) & (filled[left] <= expected)]
    good = filled == expected
    times[np.repeat(~good, size)] = 0
    return np.repeat(b, times).reshape(-1, expected), np.flatnonzero(good)


def by_lines(planes: list[Plane], data: list[np.ndarray]) -> bytes:
    """Planes (rows of bytes each) to lines: for each y, the channels in order."""
    if all(p.ys == planes[0].ys for p in planes):
        rows = [np.ascontiguousarray(d).view(np.uint8).reshape(len(d), -1) for d in data]
        return np.concatenate(rows, 1).tobytes() if len(rows) > 1 else rows[0].tobytes() if rows else b""
    rows = [(y, c, data[c][i]) for c, p in enumerate(planes) for i, y in enumerate(p.ys)]
    return b"".join(r[2].tobytes() for r in sorted(rows, key=lambda r: r[:2]))


def none(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """As it is: bytes after the last line are ignored, and a line that is missing is found by whoever reads the lines."""
    return payload


def rle(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    return _unpredicted(np.frombuffer(run_lengths(payload, expected), np.uint8))


def zipped(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    return _unpredicted(np.frombuffer(_inflated(payload, expected), np.uint8))


#: Fewer chunks than these are decoded one after the other.
TOGETHER = 32


def rle_many(payloads: list[bytes], expected: int, planes: list[Plane]) -> list[bytes | None]:
    rows, good = run_lengths_many(payloads, expected)
    return _placed(len(payloads), rows, good.tolist())


def zipped_many(payloads: list[bytes], expected: int, planes: list[Plane]) -> list[bytes | None]:
    out: list[bytes] = []
    good = []
    for i, payload in enumerate(payloads):
        try:
            out.append(_inflated(payload, expected))
            good.append(i)
        except (ValueError, zlib.error):
            continue
    return _placed(len(payloads), np.frombuffer(b"".join(out), np.uint8).reshape(-1, expected), good)


def _placed(n: int, rows: np.ndarray, places: list[int]) -> list[bytes | None]:
    out: list[bytes | None] = [None] * n
    for i, row in zip(places, _unpredicted_rows(rows), strict=True):
        out[i] = row.tobytes()
    return out


def pxr24(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """Rows of big-endian byte planes of differences; floats have their upper 24 bits alone."""
    width = {UINT: 4, HALF: 2, FLOAT: 3}
    if any(p.kind not in width for p in planes):
        raise ValueError("unknown pixel type")
    raw = np.frombuffer(_inflated(payload, sum(width[p.kind] * p.width * len(p.ys) for p in planes)), np.uint8)
    each = [width[p.kind] * p.width for p in planes]
    if all(p.ys == planes[0].ys for p in planes):
        rows = raw.reshape(len(planes[0].ys) if planes else 0, -1)
        own = np.split(rows, np.cumsum(each)[:-1], axis=1)
    else:
        lines = sorted((y, c) for c, p in enumerate(planes) for y in p.ys)
        at = np.cumsum([0, *(each[c] for _, c in lines)]).tolist()
        cut: list[list[np.ndarray]] = [[np.zeros(0, np.uint8)] for _ in planes]
        for (_, c), lo, hi in zip(lines, at, at[1:], strict=False):
            cut[c].append(raw[lo:hi])
        own = [np.concatenate(parts).reshape(len(p.ys), -1) if p.ys else np.zeros((0, 0), np.uint8) for p, parts in zip(planes, cut, strict=True)]
    return by_lines(planes, [_summed(o.reshape(len(p.ys), width[p.kind], p.width), p.kind) for o, p in zip(own, planes, strict=True)])


def _summed(parts: np.ndarray, kind: int) -> np.ndarray:
    """Lines of samples from their byte planes (lines, bytes of a difference, samples), the highest byte first."""
    size = 2 if kind == HALF else 4
    diff = np.zeros((parts.shape[0], parts.shape[2], size), np.uint8)
    diff[:, :, : parts.shape[1]] = parts.transpose(0, 2, 1)  # a float's lowest byte is 0
    form = "u2" if kind == HALF else "u4"
    return np.cumsum(diff.view(">" + form)[:, :, 0], axis=1, dtype=form).astype("<" + form)


def piz(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """Planes of 16-bit words, one after the other; a sample of four bytes is two words."""
    data = wavelet_words(payload, [(len(p.ys), p.width, p.size // 2) for p in planes])
    return by_lines(planes, data)


def _log_table(compat: bool = False) -> np.ndarray:
    """Half bits of 8 * ln(x) for half bits of x, for channels marked as linear; negative and non-finite values become 0."""
    x = np.arange(1 << 16, dtype=np.uint16).view(np.float16).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(np.isfinite(x) & (x >= 0), 8 * np.log(np.abs(x)), 0.0)
    return half_bits(out, compat)


def b44(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """4 x 4 blocks of halves, 14 bytes each, or 3 for a flat one; other channels stand raw."""
    data, at = [], 0
    for p in planes:
        rows = len(p.ys)
        if p.kind != HALF:
            n = rows * p.width * p.size
            data.append(np.frombuffer(payload, np.uint8, n, at).reshape(rows, -1))
            at += n
            continue
        starts = _starts(payload, at, -(-p.width // 4) * -(-rows // 4))
        at, starts = int(starts[-1]), starts[:-1]
        data.append(_b44_planes(np.frombuffer(payload + b"\0" * 14, np.uint8)[starts[:, None] + np.arange(14)], p)[0])
    out = by_lines(planes, data)
    if len(out) != expected:
        raise ValueError(f"{len(out)} bytes instead of {expected}")
    return out


def b44_many(payloads: list[bytes], expected: int, planes: list[Plane]) -> list[bytes | None]:
    """All chunks go on by one block at a time to find where their blocks begin; then all blocks are undone at once."""
    if any(p.ys != planes[0].ys for p in planes) or sum(len(p.ys) * p.width * p.size for p in planes) != expected:
        return [_or_none(b44, payload, expected, planes) for payload in payloads]
    b = np.frombuffer(b"".join(payloads) + b"\0" * 14, np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    at, last = ends - [len(p) for p in payloads], len(b) - 14
    data = []
    for p in planes:
        rows = len(p.ys)
        if p.kind != HALF:
            n = rows * p.width * p.size
            data.append(b[np.minimum(at, max(0, last - n))[:, None] + np.arange(n)].reshape(len(at), rows, -1) if n <= last else np.zeros((len(at), rows, p.width * p.size), np.uint8))
            at = at + n
            continue
        starts = np.zeros((len(at), -(-p.width // 4) * -(-rows // 4)), np.int64)
        for k in range(starts.shape[1]):
            starts[:, k] = np.minimum(at, last)  # one that ran past its end isn't good whatever follows
            at = at + np.where(b[starts[:, k] + 2] >= 13 << 2, 3, 14)
        data.append(_b44_planes(b[starts.reshape(-1, 1) + np.arange(14)], p).view(np.uint8).reshape(len(at), rows, -1))
    whole = np.concatenate(data, 2).reshape(len(at), -1)
    return [w.tobytes() if g else None for w, g in zip(whole, (at <= ends).tolist(), strict=True)]


def _or_none(kernel: Kernel, payload: bytes, expected: int, planes: list[Plane]) -> bytes | None:
    try:
        return kernel(payload, expected, planes)
    except (ValueError, IndexError):
        return None


def _b44_planes(blocks: np.ndarray, p: Plane) -> np.ndarray:
    """Half bits of planes that are alike, given their blocks one plane after the other, as rows of 14 bytes."""
    rows, across, down = len(p.ys), -(-p.width // 4), -(-len(p.ys) // 4)
    planes = _b44_blocks(blocks).reshape(-1, down, across, 4, 4).transpose(0, 1, 3, 2, 4).reshape(-1, 4 * down, 4 * across)[:, :rows, : p.width]
    if p.linear:
        planes = _log_table(p.compat)[planes]
    return np.ascontiguousarray(planes.astype("<u2"))


def _starts(payload: bytes, at: int, n: int) -> np.ndarray:
    """Where n blocks of 3 or 14 bytes begin, and where the last one ends: each place tells the next, in hops of powers of two."""
    size = len(payload)
    third = np.frombuffer(payload, np.uint8)[2:]
    hop = np.full(size + 15, size + 14)
    hop[: len(third)] = np.arange(len(third)) + np.where(third >= 13 << 2, 3, 14)
    out = np.array([at])
    while len(out) <= n:  # the starts known so far, and as many after them
        out = np.concatenate([out, hop[out]])
        hop = hop[hop]
    if int(out[n]) > size:
        raise ValueError("a block is cut short")
    return out[: n + 1]


def _b44_blocks(b: np.ndarray) -> np.ndarray:
    """Half bits of blocks given as rows of 14 bytes."""
    b = b.astype(np.int64)
    first = b[:, 0] << 8 | b[:, 1]
    shift = b[:, 2] >> 2
    bits = np.unpackbits(b[:, 2:].astype(np.uint8), axis=1)[:, 6:]
    deltas = bits.reshape(len(b), 15, 6) @ (1 << np.arange(5, -1, -1))
    step = (deltas << np.minimum(shift, 12)[:, None]) - (0x20 << np.minimum(shift, 12))[:, None]
    out = np.zeros((len(b), 16), np.int64)
    out[:, 0] = first
    order = [4, 8, 12] + [x for col in (1, 2, 3) for x in (col, col + 4, col + 8, col + 12)]
    for k, to in enumerate(order):  # the first column goes down, each further one takes from its left
        out[:, to] = (out[:, to - 4 if k < 3 else to - 1] + step[:, k]) & 0xFFFF
    flat = b[:, 2] >= 13 << 2
    out[flat] = first[flat, None]
    return np.where(out & 0x8000, out & 0x7FFF, ~out & 0xFFFF)


def dwa(payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """Cosine blocks and run-length planes; channels must be sampled at every pixel."""
    if not all(p.whole for p in planes):
        raise ValueError("subsampled channels")
    rows, width = (len(planes[0].ys), planes[0].width) if planes else (0, 0)
    if not rows or not width:
        return b""
    data = transform_planes(payload, [p.name for p in planes], [p.kind for p in planes], rows, width, _unpredicted, run_lengths, planes[0].compat)
    return by_lines(planes, data)


@dataclass(frozen=True)
class Scheme:
    name: str
    lines: int
    kernel: Kernel | None
    many: Callable[[list[bytes], int, list[Plane]], list[bytes | None]] | None = None  # the same for many chunks, None for those that can't be decoded


# Numbers, names and lines a chunk of the format's schemes.
SCHEMES: dict[int, Scheme] = {
    0: Scheme("NO_COMPRESSION", 1, none),
    1: Scheme("RLE", 1, rle, rle_many),
    2: Scheme("ZIPS", 1, zipped, zipped_many),
    3: Scheme("ZIP", 16, zipped, zipped_many),
    4: Scheme("PIZ", 32, piz),
    5: Scheme("PXR24", 16, pxr24),
    6: Scheme("B44", 32, b44, b44_many),
    7: Scheme("B44A", 32, b44, b44_many),
    8: Scheme("DWAA", 32, dwa),
    9: Scheme("DWAB", 256, dwa),
}


def register(number: int, name: str, lines: int, kernel: Kernel) -> None:
    """Add or replace a scheme.  Call it on the driver, before a query is made: the table goes to the tasks with the query."""
    SCHEMES[number] = Scheme(name, lines, kernel)


def decoded(scheme: Scheme | None, payload: bytes, expected: int, planes: list[Plane]) -> bytes:
    """Bytes of a chunk; a chunk of the expected size is stored raw, whatever its scheme."""
    if len(payload) == expected:
        return payload
    if scheme is None or scheme.kernel is None:
        raise ExrError("UNSUPPORTED_COMPRESSION", "no such scheme")
    try:
        return scheme.kernel(payload, expected, planes)
    except (ValueError, zlib.error, IndexError, struct.error) as e:
        raise ExrError("DECOMPRESSION_FAILED", f"{scheme.name}: {e}") from e


def decoded_many(scheme: Scheme | None, payloads: list[bytes], expected: int, planes: list[Plane]) -> list[bytes | None]:
    """Bytes of chunks that have the same channels and lines; None for a chunk that can't be decoded.  Chunks of the same bytes are decoded once."""
    done: dict[bytes, bytes | None] = {}
    if scheme is not None and scheme.many is not None and expected > 0:
        small = [p for p in dict.fromkeys(payloads) if len(p) != expected]
        for run in runs_of([expected] * len(small), 1 << 19):
            if len(run) >= TOGETHER:
                some = small[run.start : run.stop]
                done |= dict(zip(some, scheme.many(some, expected, planes), strict=True))
    for payload in payloads:
        if payload in done:
            continue
        try:
            done[payload] = decoded(scheme, payload, expected, planes)
        except ExrError:
            done[payload] = None
    return [done[payload] for payload in payloads]
