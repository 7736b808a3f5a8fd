"""Substring dedup by level-wise doubling: repeated windows alone are extended to twice their length.

Removed are the words that a window of ``window`` words covers whose word sequence also starts in a
document with a smaller doc_id.

The levels double a short length until it is half a window (13, 25 words, then the window of 50).
At each level the smallest hash of the runs of that length inside a window is the window's anchor.
Equal windows have equal anchors, and neighbouring windows mostly share theirs, so only a few per
cent of all places are sent: (anchor, doc_id), once per row. Anchors that a single document holds
end there, and with them all windows they stand for; only windows whose anchor is repeated are
extended to the next length, in the rows that have such windows. The loop ends when no candidates
survive, or at the whole window.

Whole windows. The key of a window that survived all levels is the pair of hashes of its halves
(128 bits). The smallest document of each key is found with a map-side minimum and joined back; that
window is removed from all other documents. No longer level is needed, as longer repeats are covered
by these windows.

Documents whose whole text also belongs to a smaller doc_id are set aside first: all their windows
are in that document, too, which is a source of the same windows with a smaller doc_id.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Defined cases: null and empty texts have no words; a
document of fewer words than a window keeps all; rows without doc_id are one document after all
others; rows that share a doc_id are one document, so nothing is removed from one for the other's
sake (each row is worked on by its own number in a written copy); a very long text is one row's work,
and sends its repeated windows only; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procflow.llm.common import BROADCAST_IDS, id_or_last, keep_ids, stage, text_bytes
from procflow.llm.words import WordHashes, small_batches, window_hashes

WINDOW = 50
#: The first level's length is the largest one of at most so many words that doubles to a window.
START = 13


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of ``n`` values, by doubling."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def levels(window: int, start: int = START) -> list[int]:
    """Lengths below a window, ascending: each at least half the next one, the last half a window."""
    sizes = [(window + 1) // 2]
    while sizes[0] > max(start, 1):
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


def window_anchors(h: np.ndarray, size: int, window: int) -> np.ndarray:
    """The anchor of every window over word hashes ``h``: its smallest hash of ``size`` words."""
    return sliding_minimum(window_hashes(h, size), window - size + 1)


def surviving(h: np.ndarray, wanted: pa.Scalar, size: int, window: int) -> np.ndarray:
    """Starts of the windows whose anchor of the level ``size`` is wanted."""
    known = wanted.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.flatnonzero(np.isin(window_anchors(h, size, window), known))


def numbered(docs: DataFrame) -> DataFrame:
    """(_r, _d, row): the rows with a number of their own, written so that all later reads see the same."""
    row = F.monotonically_increasing_id().alias("_r")
    return stage(docs.select(row, id_or_last().alias("_d"), F.struct(*docs.columns).alias("row")), "numbered-texts")


def copies(rows: DataFrame) -> DataFrame:
    """(_r) of the rows whose whole text also belongs to a smaller doc_id."""
    keyed = rows.select("_r", "_d", F.unhex(F.md5(text_bytes("row.text"))).alias("m"))
    first = stage(keyed.groupBy("m").agg(F.min("_d").alias("first"), F.max("_d").alias("last")).where("first < last"), "copied-texts")
    return keyed.join(first, "m").where("_d > first").select("_r")


def anchors(rows: DataFrame, size: int, window: int, before: int | None) -> DataFrame:
    """(anchor, _d, _r), once per row, of the windows that survived the level ``before`` (all, if None)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, 2):
            found = []
            for k, text in enumerate(batch.column(2).to_pylist()):
                h = hashes.of(text.split())
                of_window = window_anchors(h, size, window)
                if before is not None:
                    of_window = of_window[surviving(h, batch.column(3)[k], before, window)]
                found.append(np.unique(of_window))
            flat = np.concatenate(found).view(np.int64)
            of_row = [np.repeat(batch.column(i).to_numpy(), [len(f) for f in found]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (flat, *of_row)], ["anchor", "_d", "_r"])

    columns = ["_d", "_r", "_bytes"] + ([] if before is None else ["wanted"])
    return rows.select(*columns).mapInArrow(find, "anchor long, _d long, _r long")


def windows_at(rows: DataFrame, size: int, window: int) -> DataFrame:
    """(h1, h2, _d, _r, place) of the windows that survived the level ``size``, half a window."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, 2):
            ids, numbers = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = [[], [], [], [], []]
            for d, r, text, wanted in zip(ids, numbers, batch.column(2).to_pylist(), batch.column(3), strict=True):
                h = hashes.of(text.split())
                halves, at = window_hashes(h, size), surviving(h, wanted, size, window)
                out[0].append(halves[at].view(np.int64))
                out[1].append(halves[at + window - size].view(np.int64))
                out[2].append(np.full(len(at), d))
                out[3].append(np.full(len(at), r))
                out[4].append(at.astype(np.int32))
            names = ["h1", "h2", "_d", "_r", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    rows = rows.select("_d", "_r", "_bytes", "wanted")
    return rows.mapInArrow(extend, "h1 long, h2 long, _d long, _r long, place int")


def repeated_windows(rows: DataFrame, window: int = WINDOW, start: int = START) -> tuple[DataFrame, DataFrame]:
    """(_r, places: starts of the windows to remove) and (_r) of whole copies, for numbered rows."""
    whole = stage(copies(rows), "whole-copies")
    first = _without(rows.select("_r", "_d", text_bytes("row.text").alias("_bytes")), whole, ["_r"])
    alive, before = first, None
    for size in levels(window, start):
        held = stage(anchors(alive, size, window, before), "anchors")
        repeated = held.groupBy("anchor").agg(F.min("_d").alias("a"), F.max("_d").alias("b")).where("a < b").select("anchor")
        repeated = stage(repeated, "repeated-anchors")
        # A row's own anchors, as many as its text has at most.
        wanted = held.join(repeated, "anchor").groupBy("_r").agg(F.collect_set("anchor").alias("wanted"))
        wanted = stage(wanted, "wanted-anchors")
        if wanted.isEmpty():
            return rows.select("_r", F.array().cast("array<int>").alias("places")).where("false"), whole
        alive, before = keep_ids(first, wanted, "_r").join(wanted, "_r"), size
    found = stage(windows_at(alive, before, window), "surviving-windows")
    owner = found.groupBy("h1", "h2").agg(F.min("_d").alias("owner"), F.max("_d").alias("b"))
    owner = stage(owner.where("owner < b").select("h1", "h2", "owner"), "window-owners")
    lost = found.join(owner, ["h1", "h2"]).where("_d > owner")
    lost = lost.groupBy("_r").agg(F.collect_set("place").alias("places"))
    return stage(lost, "lost-windows"), whole


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in the staged table ``gone``, which is broadcast only if it is small."""
    gone = gone.select(*keys).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, keys, "left_anti")


def covered(places: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``places``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, start: int = START) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256[, kept]) for every row of ``docs``; ``kept`` are the words left."""
    rows = numbered(docs)
    lost, whole = repeated_windows(rows, window, start)
    carried = [F.col("row")[c].alias(c) for c in docs.columns if with_text or c != "text"]
    every = rows.select(F.struct(*carried).alias("row"), "_r", text_bytes("row.text").alias("_bytes"))
    change = lost.select("_r", "places", F.lit(False).alias("entire"))
    change = change.unionAll(whole.select("_r", F.array().cast("array<int>"), F.lit(True)))
    changed = keep_ids(every, change, "_r").join(change, "_r")
    same = _without(every, change, ["_r"]).withColumn("places", F.lit(None).cast("array<int>")).withColumn("entire", F.lit(False))
    return _cut(changed, window, with_text).unionAll(_cut(same, window, with_text))


def _cut(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, places, everything in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                n = len(words)
                if everything and n >= window:
                    words = []
                elif places.is_valid:
                    gone = covered(places.values.to_numpy(zero_copy_only=False).astype(np.int64), window, n)
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept)
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["row", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = rows.select("row", "_bytes", "places", "entire")
    found = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return rows.mapInArrow(cut, StructType([rows.schema["row"], *StructType.fromDDL(found).fields]))
