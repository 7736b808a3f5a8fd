"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is cut into passages of ``PASSAGE_WORDS`` words, all of them. Each passage is described by
the shares of byte classes (letters, capitals, digits, every ASCII mark by itself, bytes above
0x7F) and by its words (length, capitals, immediate repeats), and encoded by a tanh layer. Gated
attention (tanh times sigmoid) gives each passage a weight; the weighted mean of the encodings is
scored by a logistic layer. Labels exist for documents only, and all layers are learned from them.

Training uses at most ``TRAIN_DOCS`` labelled documents (those with the smallest hash of doc_id),
of which the passages' descriptions reach the driver, not the texts. Scoring runs over all texts
where they are read; nothing is shuffled.

Only the text enters a score. Defined cases: a null or empty text has one passage without words
and gets a score like any other; labels without quality are ignored, of repeated labels the lowest
counts; without any label every score is 0.5; rows without doc_id are scored, not learned from;
rows that share a doc_id are scored one by one; other columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from procflow.llm.common import carried_text, text_bytes
from procflow.llm.words import small_batches, with_texts

PASSAGE_WORDS = 64
TRAIN_DOCS = 6000
THRESHOLD = 0.7
#: Bytes of text that are described at once; a byte takes about 50 meanwhile.
DESCRIBED = 1 << 20

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 4, np.int64)
    kind[ord("a") : ord("z") + 1] = 0
    kind[ord("A") : ord("Z") + 1] = 1
    kind[ord("0") : ord("9") + 1] = 2
    kind[0x80:] = 3
    kind[_MARKS] = 5 + np.arange(len(_MARKS))
    return kind


CLASSES = 5 + len(_MARKS)
FEATURES = CLASSES + 5


def held_out(folds: int, doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 by ``folds``; rows without doc_id are not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 2, F.lit(False))


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x FEATURES, number of passages of each text)."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    text_of = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text_of, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    out = np.zeros((int(passages.sum()), FEATURES), np.float32)
    if not len(starts):
        return out, passages
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    passage = np.repeat(np.cumsum(passages) - passages, words) + nth // PASSAGE_WORDS
    n = len(out)
    word = np.cumsum(first) - 1
    of_byte = passage[word[inside]]
    kinds = np.bincount(of_byte * CLASSES + _byte_classes()[raw[inside]], minlength=n * CLASSES)
    kinds = kinds.reshape(n, CLASSES).astype(np.float32)
    n_bytes, n_words = kinds.sum(1), np.bincount(passage, minlength=n).astype(np.float32)
    # Words are told apart by the sum of a random value for each of their bytes.
    value = np.random.default_rng(7).integers(1, 2**40, 256)
    value[[32, 9, 10, 11, 12, 13]] = 0
    sums = np.add.reduceat(value[raw], starts)
    same = np.zeros(len(starts), bool)
    same[1:] = (sums[1:] == sums[:-1]) & (passage[1:] == passage[:-1])
    capital = (raw[starts] >= 65) & (raw[starts] <= 90)
    some = np.maximum(n_words, 1)
    out[:, :CLASSES] = np.sqrt(kinds / np.maximum(n_bytes, 1)[:, None])
    out[:, CLASSES] = n_words / PASSAGE_WORDS
    out[:, CLASSES + 1] = np.log1p(n_bytes / some) / 3
    out[:, CLASSES + 2] = np.sqrt(np.bincount(passage, same, n) / some)
    out[:, CLASSES + 3] = np.bincount(passage, capital, n) / some
    out[:, CLASSES + 4] = n_words > 0
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Attention:
    """Encoder E, attention V, U, w and output c; ``mean`` and ``scale`` put features on one scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        p = self.weights
        at = np.cumsum(counts) - counts
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (v * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, at), counts))
        a = s / np.repeat(np.add.reduceat(s, at), counts)
        z = np.add.reduceat(a[:, None] * h, at)
        return x, h, v, u, a, z, _sigmoid(z @ p["c"] + p["b"])

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), counts)[-1] if len(counts) else np.empty(0)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        at = np.cumsum(counts) - counts
        x, h, v, u, a, z, score = self.forward(x, counts)
        d_out = (score - y) * weight / weight.sum()
        g = {"c": z.T @ d_out, "b": d_out.sum(keepdims=True)}
        d_z = np.repeat(d_out[:, None] * p["c"], counts, axis=0)
        d_a = (d_z * h).sum(1)
        d_s = a * (d_a - np.repeat(np.add.reduceat(a * d_a, at), counts))
        g["w"] = (v * u).T @ d_s
        d_v, d_u = d_s[:, None] * p["w"] * u * (1 - v * v), d_s[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ d_v, h.T @ d_u
        d_h = (a[:, None] * d_z + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - h * h)
        g["E"], g["e"] = x.T @ d_h, d_h.sum(0)
        return g


def train(features: list[np.ndarray], labels: np.ndarray, hidden: int = 24, epochs: int = 25, batch: int = 128) -> Attention:
    """Adam on the weighted log loss of the documents; both classes weigh the same in total."""
    rng = np.random.default_rng(11)
    flat = np.concatenate(features).astype(np.float64)
    shape = {"E": (FEATURES, hidden), "e": (hidden,), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,), "b": (1,)}
    weights = {k: rng.normal(0, 0.3, s) if k in "EVUwc" else np.zeros(s) for k, s in shape.items()}
    model = Attention(flat.mean(0), np.maximum(flat.std(0), 0.02), weights)
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first, second, steps = {k: 0.0 for k in shape}, {k: 0.0 for k in shape}, 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), batch):
            pick = order[low : low + batch]
            counts = np.array([len(features[i]) for i in pick])
            x = np.concatenate([features[i] for i in pick]).astype(np.float64)
            g = model.gradients(x, counts, labels[pick], weight[pick])
            steps += 1
            for k in shape:
                slope = g[k] + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = 0.01 / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                weights[k] -= rate * first[k] / (1 - 0.9**steps)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, most: int) -> DataFrame:
    """(doc_id, quality, _bytes) of at most ``most`` labelled documents that are not held out."""
    known = labels.where("quality is not null and doc_id is not null")
    known = known.where(~held_out(folds)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", text_bytes().alias("_bytes"))
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "_bytes")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, most: int = TRAIN_DOCS) -> Attention | None:
    """Learn from the labelled documents outside the held-out fold; None without any."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, DESCRIBED):
            x, counts = describe(batch.column(2).to_pylist())
            cuts = [c.tobytes() for c in np.split(x, np.cumsum(counts)[:-1])]
            columns = [batch.column(0), batch.column(1), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "x"])

    rows = training_rows(docs, labels, folds, most)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "_bytes")
    found = rows.mapInArrow(prepare, "doc_id long, quality int, x binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not found:
        return None
    features = [np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, FEATURES) for r in found]
    return train(features, np.array([float(r["quality"]) for r in found]))


def score_texts(docs: DataFrame, model: Attention | None, carry: list[str] | None = None) -> DataFrame:
    """(row: struct of ``carry``, by default all columns, score) for every row of ``docs``."""
    carry = carry or docs.columns
    held = carried_text(docs, carry)
    rows = docs.select(F.struct(*carry).alias("row"), *([] if held else [text_bytes().alias("_bytes")]))
    if model is None:
        return rows.select("row", F.lit(0.5).alias("score"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = with_texts(batches, "text") if held else batches
        for batch in small_batches(batches, 1, DESCRIBED):
            scores = np.round(model.scores(*describe(batch.column(1).to_pylist())), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(judge, StructType([rows.schema["row"], StructField("score", DoubleType())]))
