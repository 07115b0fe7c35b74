"""Blocks of documents with the postings of their terms: what phrase search and ranked search store.

A term is a run of digits, letters a-z and characters beyond ASCII, after A-Z
are lower-cased; all bytes of UTF-8 beyond ASCII are above 127, so runs of bytes
are runs of characters.  A term stands as a 64-bit hash of all its bytes; a
term of a query is taken for another one of the corpus with a probability of
their numbers' product over 2**64.

Documents stay in the order of their task, cut into blocks of about BLOCK_WORDS
words or BLOCK_DOCS documents.  An index of blocks is split by documents, so it
is made without a shuffle, a term of every document has no list of its own
length anywhere, and a query meets every block.  Queries go to the tasks in
slices of a bounded number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanweave.llm.common import written
from scanweave.llm.textstats import Text, chunks

BLOCK_WORDS, BLOCK_DOCS = 1 << 18, 1 << 15

#: Bytes that no term holds, after A-Z are lower-cased.
GAPS = np.ones(256, bool)
GAPS[48:58] = GAPS[97:123] = GAPS[128:] = False


def terms_of(texts: list[str | None], hashed: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(number of the first text, terms of each text, hashes of all terms in order if these are asked for) of runs of texts."""
    for first, raws in chunks(texts):
        text = Text(raws, lower=True, gaps=GAPS)
        yield first, text.n_words, text.word_hashes() if hashed else None


def blocks_of(batches: Iterator[pa.RecordBatch], words: int = BLOCK_WORDS, docs: int = BLOCK_DOCS) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(number of the block, ids, terms of each document, hashes) for rows (id, text) of one task."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    ids, sizes, hashes, held = [], [], [], [0, 0]

    def block() -> tuple:
        nonlocal seq
        out = (part << 32 | seq, pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(hashes))
        seq += 1
        for x in (ids, sizes, hashes):
            x.clear()
        held[:] = 0, 0
        return out

    for batch in batches:
        for first, n, h in terms_of(batch.column(1).to_pylist()):
            ids.append(batch.column(0).slice(first, len(n)))
            sizes.append(n)
            hashes.append(h)
            held[0] += len(h)
            held[1] += len(n)
            if held[0] >= words or held[1] >= docs:
                yield block()
    if ids:
        yield block()


def lists(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each is there) of a sorted array."""
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1]]))
    return sorted_[new], np.diff(new, append=len(sorted_))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + count[i] - 1 of all i, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value in the sorted keys, is it there); places of those that aren't there mean nothing."""
    if not len(keys):
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def stored(blocks: DataFrame, tag: str) -> DataFrame:
    """Write an index.  Its rows are large, so the writer looks at its memory often."""
    return written(blocks, tag, **{"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2", "parquet.page.size.row.check.max": "8"})


def row_of(batch: pa.RecordBatch, k: int, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """Binary columns of a row as arrays, without copies."""
    return {name: np.frombuffer(batch.column(name)[k].as_buffer(), kind) for name, kind in kinds.items()}
