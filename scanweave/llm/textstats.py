"""Counts over whole texts, for many texts at once.

Texts of a batch stand in one byte array, so every count is a few vectorised
passes whatever the number of texts.  Words are runs of bytes other than blank,
tab, line feed, vertical tab, form feed and carriage return; they and lines are
compared by 64-bit hashes of all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scanweave.llm.common import BLANKS, mix64

#: Bytes of text handled at once (one longer text is handled alone).
CHUNK_BYTES = 1 << 20
SYMBOLS = "#*$%&|<>"

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _FACTOR)
_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    """_FACTOR to the powers 0..n-1, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _FACTOR)])
    return _powers[:n]


def _flags(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode() if isinstance(chars, str) else chars, np.uint8)] = True
    return out


_BLANK, _SYMBOL, _MARK = _flags(BLANKS), _flags(SYMBOLS), _flags("!?")
_UPPER, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_INNER = _flags(bytes(range(128, 192)))  # bytes of a character but for its first
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as bytes) of runs of about CHUNK_BYTES."""
    held: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK_BYTES:
            yield first, held
            held, size, first = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


class Text:
    """One run of texts: its bytes, with a line end after each text, and where words are.  gaps flags the bytes between words (by default blanks; a line end must be one)."""

    def __init__(self, raws: list[bytes], lower: bool = False, gaps: np.ndarray | None = None):
        self.n = len(raws)
        self.sizes = np.fromiter(map(len, raws), np.int64, self.n)
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.bytes = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        if lower:
            self.bytes = _LOWERED[self.bytes]
        word = ~(_BLANK if gaps is None else gaps)[self.bytes]
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: words before each text, and in each
        self.first_word = np.searchsorted(self.starts, self.begins)
        self.n_words = np.searchsorted(self.starts, self.begins + self.sizes) - self.first_word
        self._word = word

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one a byte) over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.begins + self.sizes] - total[self.begins]

    def per_word(self, flags: np.ndarray) -> np.ndarray:
        """Sum of flags (one a word) over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.first_word + self.n_words] - total[self.first_word]

    def _hashes(self, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span; covered marks all bytes of spans."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(covered)
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(at)) - np.repeat(first, lengths)
        terms = _TABLE[self.bytes[at]] * _powers_to(int(lengths.max()) + 1)[place]
        return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * _FACTOR)

    def word_hashes(self) -> np.ndarray:
        return self._hashes(self.starts, self.ends, self._word)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of every window of k words that lies in one text."""
        if len(hashes) < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner, last = self.text_of_words(), len(hashes) - k + 1
        at = np.flatnonzero(owner[:last] == owner[k - 1 :])
        out = hashes[at]
        for i in range(1, k):
            out = mix64(out * _FACTOR + hashes[at + i])
        return at, out

    def repeated(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For items of texts: is it there twice or more in its text, and does an equal one stand before it?"""
        own = mix64(hashes + mix64(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        later, more = np.zeros(len(own), bool), np.zeros(len(own), bool)
        later[order[1:][same]] = True
        more[order[1:][same]] = True
        more[order[:-1][same]] = True
        return more, later

    def repeat_words(self, hashes: np.ndarray, k: int = 3) -> np.ndarray:
        """Words of each text in windows of k words that the text holds twice or more."""
        at, window = self.windows(hashes, k)
        covered = np.zeros(len(hashes), bool)
        if len(at):
            more, _ = self.repeated(window, self.text_of_words()[at])
            for i in range(k):
                covered[at[more] + i] = True
        return self.per_word(covered)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of lines with a word, of these the ones equal to an earlier line) of each text."""
        line_end = np.flatnonzero(self.bytes == 10)
        start = np.concatenate([[0], line_end[:-1] + 1])
        words = np.searchsorted(self.starts, line_end) - np.searchsorted(self.starts, start)
        start, end = start[words > 0], line_end[words > 0]
        inside = np.zeros(len(self.bytes) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        hashes = self._hashes(start, end, np.cumsum(inside[:-1]).astype(bool))
        owner = np.searchsorted(self.begins, start, "right") - 1
        _, later = self.repeated(hashes, owner)
        return np.bincount(owner, minlength=self.n), np.bincount(owner[later], minlength=self.n)

    def counts(self) -> dict[str, np.ndarray]:
        h = self.word_hashes()
        _, again = self.repeated(h, self.text_of_words())
        n_lines, dup_lines = self.lines()
        char = ~_INNER[self.bytes]
        return {
            "n_words": self.n_words,
            "word_chars": self.per_text(char & self._word),
            "n_symbols": self.per_text(_SYMBOL[self.bytes]),
            "n_dup_lines": dup_lines,
            "n_repeat_words": self.repeat_words(h),
            "n_lines": n_lines,
            "n_again": self.per_word(again),
            "n_upper": self.per_text(_UPPER[self.bytes]),
            "n_digits": self.per_text(_DIGIT[self.bytes]),
            "n_marks": self.per_text(_MARK[self.bytes]),
        }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_again", "n_upper", "n_digits", "n_marks")
COUNTS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS)


def counts(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS of each text; a null text is an empty one."""
    parts = [Text(raws).counts() for _, raws in chunks(texts)]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def add_counts(batches: Iterator[pa.RecordBatch], first: int = 1) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: COUNTS of the texts in the first column come after the columns from number `first` on."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            got = counts(some.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*some.columns[first:], *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=[*some.schema.names[first:], *COUNTS])


def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with the texts kept."""
    return add_counts(batches, 0)
