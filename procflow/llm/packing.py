"""Hierarchical packing of documents into sequences of several context sizes.

Each document is encoded where it is read. Its full windows of the longest size become sequences
at once; what is left is routed to the smallest tier that holds it. A buffer of such rests is
packed tier by tier, longest first: the longest rest opens a sequence, its gap is filled with the
largest rests of this and the shorter tiers that fit, and the last of the gap with a cut from the
shortest rest. So every sequence is exactly as long as its tier, and nothing is padded. What stays
over is carried into the next buffer; at the end of a partition the last rests form sequences whose
lengths are powers of two.

Sequences of one tier are dealt to steps of the same number of tokens, so that all steps cost
about the same. No rows are moved between partitions, and memory holds one buffer of rests.

Defined cases: a null or empty text has the end id alone; rows without doc_id are packed with a
null doc_id; repeated rows are documents of their own; an empty table gives no rows; columns other
than doc_id and text are not read. Sequence ids depend on how the input is split into partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.llm.common import text_bytes
from procflow.llm.tokens import WordTokens, encoded_pieces

TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 1 << 15
BUFFER = 2048
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
SCHEMA = ", ".join(f"{f} long" for f in FIELDS)


@dataclass(frozen=True)
class Rest:
    """A run of a document's ids that is not in a sequence yet."""

    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Rest, Rest]:
        return (
            Rest(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Rest(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


class Pool:
    """Rests in the order of their lengths; equal lengths in the order of arrival."""

    def __init__(self):
        self.order: list[tuple[int, int]] = []
        self.rests: dict[int, Rest] = {}
        self.tokens = self.added = 0

    def add(self, rest: Rest) -> None:
        insort(self.order, (len(rest.ids), self.added))
        self.rests[self.added] = rest
        self.added += 1
        self.tokens += len(rest.ids)

    def take(self, at: int) -> Rest:
        length, key = self.order.pop(at)
        self.tokens -= length
        return self.rests.pop(key)

    def up_to(self, n: int) -> int:
        """Place of the longest rest of at most ``n`` ids; -1 if there is none."""
        return bisect_right(self.order, (n, self.added)) - 1

    def fill(self, size: int) -> list[Rest]:
        """Rests of exactly ``size`` ids, which must be there: the longest that fit, then a cut."""
        out, gap = [], size
        while gap:
            at = self.up_to(gap)
            if at < 0:
                head, tail = self.take(0).cut(gap)
                self.add(tail)
            else:
                head = self.take(at)
            out.append(head)
            gap -= len(head.ids)
        return out


class Packer:
    """Packs the documents of one partition; ``take`` hands out the finished pieces."""

    def __init__(self, part: int, tiers: tuple[int, ...], step_tokens: int, with_ids: bool):
        self.tiers, self.step_tokens, self.with_ids = tiers, step_tokens, with_ids
        self.base = part << 33
        self.sequences = 0
        self.dealt = dict.fromkeys(tiers, 0)
        self.pool = Pool()
        self.rows: list[tuple] = []

    def tier_of(self, n: int) -> int:
        return next(t for t in self.tiers if n <= t)

    def emit(self, rests: list[Rest]) -> None:
        size = sum(len(r.ids) for r in rests)
        tier = self.tier_of(size)
        step = self.base + (self.dealt[tier] // self.step_tokens) * len(self.tiers) + self.tiers.index(tier)
        self.dealt[tier] += size
        offset = 0
        for r in rests:
            n = len(r.ids)
            row = (r.doc_id, r.start, n, zlib.crc32(r.ids.astype("<u4", copy=False)), r.doc_tokens)
            row += (self.base + self.sequences, offset, tier, step)
            self.rows.append((*row, r.ids) if self.with_ids else row)
            offset += n
        self.sequences += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        longest, n = self.tiers[-1], len(ids)
        full = n - n % longest
        for start in range(0, full, longest):
            self.emit([Rest(doc_id, start, n, ids[start : start + longest])])
        if n > full:
            self.pool.add(Rest(doc_id, full, n, ids[full:].copy()))

    def pack(self) -> None:
        """Pack the rests tier by tier, as long as they fill the windows of a tier."""
        shorter = (0, *self.tiers)
        for k in range(len(self.tiers) - 1, -1, -1):
            tier, below = self.tiers[k], shorter[k]
            while self.pool.tokens >= tier and self.pool.order[-1][0] > below:
                self.emit(self.pool.fill(tier))

    def close(self) -> None:
        self.pack()
        while self.pool.tokens:
            size = min(1 << (self.pool.tokens.bit_length() - 1), self.tiers[-1])
            self.emit(self.pool.fill(size))

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            rows, self.rows = self.rows, []
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.int64()) for c in columns[: len(FIELDS)]]
            names = list(FIELDS)
            if self.with_ids:
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in columns[-1]])])
                flat = np.concatenate(columns[-1]).view(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece of a document, with its place in its sequence; tiers are powers of two."""
    if list(tiers) != sorted(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be ascending powers of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of_worker(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), tiers, step_tokens, with_ids)
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for piece, ids, bounds in encoded_pieces(words, batch.column(1), end_id):
                for doc_id, a, b in zip(ids_of[piece], bounds, bounds[1:], strict=False):
                    packer.add(doc_id, ids[a:b])
                    if len(packer.pool.order) >= BUFFER:
                        packer.pack()
                yield from packer.take()
        packer.close()
        yield from packer.take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(pack, SCHEMA + (", ids array<int>" if with_ids else ""))
