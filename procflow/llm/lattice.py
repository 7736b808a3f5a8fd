"""Language-model scores: likelihood of a text over all segmentations of a subword lattice.

The arcs of a word's lattice are the pieces of an existing subword vocabulary, the bytes of each
character, and the word itself as counted in the training texts. Pieces never join characters
across white space, so a text's likelihood is the product over its words and its end.

- Piece weights: every distinct training word is segmented with the existing vocabulary, whose own
  scores (ranks of merges) decide how; the pieces' counts over the distinct words give the
  probability of each piece (add-``ALPHA``). Words count once each, as the lattice stands in for
  words that were not counted.
- Lattice: the log-space forward recursion sums all paths through '▁' + word.
- Word arcs: a word counted c times of N has (c - D) / N; the mass D * types / N that discounting
  sets free is shared out by the lattice, so unseen words have a probability and all sum to 1. D
  is n1 / (n1 + 2 n2), from the numbers of words seen once and twice. The end has its plain share.

Counts cover all training texts. A word's probability is computed once per distinct word. Words
with at least a ``FREQUENT``-th of all occurrences, of which there are ``FREQUENT`` at most, are sent to
all tasks; the occurrences of the others are shuffled by word, packed per block of documents, and
come back by block, where they are summed per document.

Defined cases: a null or empty text has the end as its only token; rows without doc_id are scored
and learned from; rows that share a doc_id are scored one by one; without training texts every
word has its lattice probability under even piece weights and the end costs nothing; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.llm.common import stage, text_bytes
from procflow.llm.quality import held_out
from procflow.llm.words import small_batches

ALPHA = 0.1
FREQUENT = 100_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of a block of documents; a longer text is a block of its own.
BLOCK_WORDS = 1_000_000
BLOCK_DOCS = 60_000
SPACE_MARK = "▁"


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public subword vocabulary of this name lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_table(docs: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in the training texts and in all texts, for every word of any text.

    The end of a text is the empty word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = [w for s in seen for w in s]
            n = [x for s in seen for x in s.values()]
            c = list(seen[0].values()) + [0] * len(seen[1])
            for s in seen:
                s.clear()
            arrays = [pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["word", "c", "n"])

        for batch in small_batches(batches, 1):
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.lower().split()
                words.append(b"")
                seen[held].update(words)
                if len(seen[0]) + len(seen[1]) > COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select("held_out", "_bytes").mapInArrow(count, "word binary, c long, n long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_counts(words: DataFrame, vocabulary: str) -> DataFrame:
    """(piece, n) over the distinct training words, each segmented with the existing vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for low in range(0, len(texts), 4096):
                ids = model.encode(texts[low : low + 4096], num_threads=1)
                total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["piece", "n"])

    rows = words.where("c > 0 and word <> x''").select("word").mapInArrow(count, "piece long, n long")
    return rows.groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Piece weights and the forward recursion; weights are natural logarithms."""

    def __init__(self, pieces: dict[str, float], byte: list[float]):
        self.pieces, self.byte = pieces, byte
        self.starts = {p[:i] for p in pieces for i in range(1, len(p) + 1)}

    @classmethod
    def weighted(cls, vocabulary: str, counts: dict[int, int]) -> Lattice:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        size = model.get_piece_size()
        total = math.log(sum(counts.values()) + ALPHA * size)
        weight = [math.log(counts.get(i, 0) + ALPHA) - total for i in range(size)]
        pieces, byte = {}, [0.0] * 256
        for i in range(size):
            if model.is_byte(i):
                byte[int(model.id_to_piece(i)[3:-1], 16)] = weight[i]
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = weight[i]
        return cls(pieces, byte)

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the summed probability of all segmentations of '▁' + ``word``."""
        text = SPACE_MARK + word
        pieces, starts, byte = self.pieces, self.starts, self.byte
        n = len(text)
        arrive: list[list[float]] = [[] for _ in range(n + 1)]
        forward = 0.0
        for i, char in enumerate(text):
            if i:
                paths = arrive[i]
                top = max(paths)
                forward = top + math.log(sum([math.exp(p - top) for p in paths])) if len(paths) > 1 else top
                arrive[i] = []
            arrive[i + 1].append(forward + sum([byte[b] for b in char.encode()]))
            for j in range(i + 1, n + 1):
                part = text[i:j]
                if part not in starts:
                    break
                if part in pieces:
                    arrive[j].append(forward + pieces[part])
        top = max(arrive[n])
        return top + math.log(sum(math.exp(p - top) for p in arrive[n]))


class Model:
    """Token probabilities; ``base`` is add-one smoothing, ``log10`` the lattice with word arcs."""

    def __init__(self, lattice: Lattice, n: int, types: int, ends: int, once: int, twice: int):
        self.lattice, self.n, self.types = lattice, n, types
        # Below 1, so that a word seen once keeps some mass of its own.
        self.discount = min(once / (once + 2 * twice), 0.95) if once else 0.0
        # The lattice's mass; when nothing is discounted, that of one more token.
        if self.discount:
            self.free, self.scale = self.discount * (types - (ends > 0)) / n, 1.0
        else:
            self.free, self.scale = 1 / (n + 1), n / (n + 1)

    def base(self, c: int) -> float:
        return math.log10((c + 1) / (self.n + self.types + 1))

    def log10(self, word: bytes, c: int) -> float:
        if not word:
            return math.log10(c / self.n * self.scale) if c else 0.0
        spelled = self.lattice.log_probability(word.decode("utf-8", "replace"))
        if not c:
            return (spelled + math.log(self.free)) / math.log(10)
        counted = math.log((c - self.discount) / self.n * self.scale)
        spelled += math.log(self.free)
        top = max(counted, spelled)
        return (top + math.log(math.exp(counted - top) + math.exp(spelled - top))) / math.log(10)


def scored_words(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, known, base, score) of every word; ``score`` is log10 of its probability."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            arrays = [
                batch.column(0),
                batch.column(2),
                pa.array([c > 0 for c in counts], pa.bool_()),
                pa.array([model.base(c) for c in counts], pa.float64()),
                pa.array([model.log10(w, c) for w, c in zip(texts, counts, strict=True)], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "known", "base", "score"])

    rows = words.select("word", "c", "n")
    return rows.mapInArrow(score, "word binary, n long, known boolean, base double, score double")


class LocalIds(dict):
    """word -> number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


PACKED = "word binary, block long, docs binary, head binary"


def packed_occurrences(docs: DataFrame, frequent: dict[bytes, tuple[bool, float, float]]) -> DataFrame:
    """Per block of documents: a row per infrequent word with its documents, and a head row.

    The head holds, per document of the block, doc_id, held_out and the sums over its frequent words; its
    ``word`` contains a blank, so that it equals no word.
    """
    names = list(frequent)
    known, base, score = (np.array([frequent[w][i] for w in names], float) for i in range(3))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId() << 24, 0
        first = {w: i for i, w in enumerate(names)}
        schema = pa.schema([("word", pa.binary()), ("block", pa.int64()), ("docs", pa.binary()), ("head", pa.binary())])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, found, heads, size, block
            number = part + block
            flat = np.concatenate(found) if found else np.empty(0, np.int64)
            lengths = [len(f) for f in found]
            doc = np.repeat(np.arange(len(found)), lengths)
            often = flat < len(names)
            sums = [np.bincount(doc[often], v[flat[often]], len(found)) for v in (known, base, score)]
            head = np.array([(h[0] is None, h[0] or 0, h[1], n, *s) for h, n, s in zip(heads, lengths, zip(*sums, strict=True), strict=True)], HEAD)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b" %d" % number]), pa.array([number]), pa.array([b""]), pa.array([head.tobytes()], pa.binary())], schema=schema
            )
            rare, rare_doc = flat[~often] - len(names), doc[~often].astype("<u2")
            order = np.argsort(rare, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=len(ids) - len(names)))]) * 2
            words = list(ids)[len(names) :]
            rare_doc = rare_doc[order]
            for low in range(0, len(words), 50_000):
                high = min(low + 50_000, len(words))
                offsets = bounds[low : high + 1] - bounds[low]
                data = rare_doc[bounds[low] // 2 : bounds[high] // 2].tobytes()
                lists = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[low:high], pa.binary()), pa.array(np.full(high - low, number)), lists, pa.nulls(high - low, pa.binary())], schema=schema
                )
            ids, found, heads, size, block = LocalIds(first), [], [], 0, block + 1

        ids, found, heads, size = LocalIds(first), [], [], 0
        for batch in small_batches(batches, 2):
            for doc_id, held, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = text.lower().split()
                words.append(b"")
                found.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
                heads.append((doc_id, held))
                size += len(words)
                if size >= BLOCK_WORDS or len(found) >= BLOCK_DOCS:
                    yield from close()
        if found:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), "held_out", "_bytes").mapInArrow(pack, PACKED)


HEAD = np.dtype([("none", "?"), ("id", "<i8"), ("held", "?"), ("tokens", "<i8"), ("known", "<f8"), ("base", "<f8"), ("score", "<f8")])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _summed(table: pa.Table) -> pa.Table:
    """Per document of one block: the sums over its frequent and its other words."""
    head = np.frombuffer(next(h for h in table.column("head").to_pylist() if h is not None), HEAD)
    rows = table.filter(pc.is_null(table.column("head")))
    docs = rows.column("docs").to_pylist()
    flat = np.frombuffer(b"".join(docs), "<u2")
    lengths = np.fromiter(map(len, docs), np.int64, len(docs)) // 2
    known, base, score = (
        head[name] + np.bincount(flat, np.repeat(rows.column(name).to_numpy().astype(float), lengths), len(head))
        for name in ("known", "base", "score")
    )
    return pa.table(
        {
            "doc_id": pa.array(head["id"], mask=head["none"]),
            "held_out": head["held"],
            "n_tokens": head["tokens"],
            "n_known": np.rint(known).astype(np.int64),
            "base_score": base,
            "score": score,
        }
    )


def lattice_scores(docs: DataFrame, vocabulary: str, folds: int = 7, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    docs = docs.select("doc_id", held_out(folds).alias("held_out"), text_bytes().alias("_bytes"))
    words = stage(word_table(docs), "lm-words")
    is_word = F.col("word") != F.lit(bytearray())
    once, twice = (F.count_if(is_word & (F.col("c") == k)).alias(f"c{k}") for k in (1, 2))
    ends = F.sum(F.when(~is_word, F.col("c"))).alias("ends")
    t = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("types"), F.sum("n").alias("all"), ends, once, twice).first()
    # At most as many rows as the vocabulary has pieces.
    counts = {r["piece"]: r["n"] for r in piece_counts(words, vocabulary).collect()}
    model = Model(Lattice.weighted(vocabulary, counts), t["n"] or 0, t["types"], t["ends"] or 0, t["c1"], t["c2"])
    scored = stage(scored_words(words, model), "lm-scores")
    # A word with a share of 1 / frequent or more: there are at most ``frequent`` of them.
    often = scored.where(F.col("n") * frequent >= F.lit(t["all"] or 0))
    held = {bytes(r["word"]): (r["known"], r["base"], r["score"]) for r in often.collect()}
    rare = scored.where(F.col("n") * frequent < F.lit(t["all"] or 0)).select("word", "known", "base", "score")
    packed = packed_occurrences(docs, held).join(rare, "word", "left")
    packed = packed.select("block", "docs", "head", "known", "base", "score")
    out = packed.groupBy("block").applyInArrow(_summed, RESULT)
    return out.withColumn("train_tokens", F.lit(model.n).cast("long"))


