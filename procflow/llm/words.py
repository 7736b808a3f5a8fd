"""Words and their hashes inside Python workers: bytes in, numpy arrays out.

``bytes.split`` cuts at ``[\\x20\\x09-\\x0D]+`` and ``bytes.lower`` lowers A-Z only, which is the
definition of words and case throughout this package.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20

# Odd 64-bit multipliers.
K1 = np.uint64(0x9E3779B97F4A7C15)
K2 = np.uint64(0xC2B2AE3D27D4EB4F)
K3 = np.uint64(0xBF58476D1CE4E5B9)
K4 = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    most = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * K3
    x = (x ^ (x >> np.uint64(27))) * K4
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of sequence ``a`` followed by sequence ``b``, from their hashes."""
    return mix(a * K1 + b * K2)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; hashes of doubled lengths are combined."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        if n & size:
            last = len(h) - done - size + 1
            out = part[:last] if out is None else joined(out[:last], part[done : done + last])
            done += size
        if size * 2 > n:
            return out
        part = joined(part[:-size], part[size:])
        size *= 2


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word shingles; fewer words, but not none, make one shingle."""
    if not len(h):
        return h
    return np.unique(window_hashes(h, min(n, len(h))))


def pieces(lengths: np.ndarray, most: int = PIECE_BYTES) -> Iterator[slice]:
    """Slices of texts of these ``lengths``, of about ``most`` bytes each."""
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def free_unused() -> None:
    """Give memory that nothing holds any more back to the system, as a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_texts(batches: Iterator[pa.RecordBatch], field: str) -> Iterator[pa.RecordBatch]:
    """``batches`` with the bytes of the text ``field`` of their first column, a struct, as the last column.

    A text that a row carries anyway thus comes to the worker once; a missing one is empty.
    """
    for batch in batches:
        text = batch.column(0).field(field)
        text = (text.fill_null("") if text.null_count else text).cast(pa.binary())
        names = [*batch.schema.names, "_bytes"]
        yield pa.RecordBatch.from_arrays([*batch.columns, text], names)


def small_batches(
    batches: Iterator[pa.RecordBatch], column: int | str, most: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the texts in ``column`` (bytes) are about ``most`` at a time."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        for piece in pieces(lengths, most):
            yield batch.slice(piece.start, piece.stop - piece.start)
    free_unused()
