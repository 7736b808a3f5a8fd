"""Vector code compression: codebooks per part, trained with norm-of-sum bounds.

A vector of whole numbers (components times ``scale``, floored) is cut into equal parts; each part
position has a codebook, and a part is replaced by the index of its nearest entry. Codebooks are
trained by rounds of assigning every part and moving every entry to the floored mean of its parts.

Bounds. For each part and entry a lower bound on their distance is kept, with a stamp: the round in
which it was measured. The codebooks of all rounds are kept, so the bound now is the old one less
the distance between the entry as it was at the stamp and as it is now: the norm of the sum of its
moves, never more than the sum of their norms that accumulated drifts would take off. In a round
only the distance to the assigned entry is computed; an entry whose bound is above it can't be
nearest and is passed over, the others are measured exactly and their bounds stamped anew. Bounds
are floored to whole units and cut at 65,535, which keeps them lower bounds. All distances that
decide are exact integers, so the result is that of a full search.

On Spark. The kept vectors are written once with assignment, bounds and stamps, and each round reads
that table and writes the next; the one before is deleted then, so two exist at most. A round's
sums are added up per task, then by Spark, and only the entries (parts x entries x components)
reach the driver, where the next codebooks are made. A lost executor repeats its tasks of a round.

Defined cases: dropped are rows whose vector is null or holds null, NaN or infinite components, and
rows whose vector has not the commonest length (of equally common ones the longest), as codebooks
have one length. A length that ``parts`` does not divide is an error, and so are components so large
that sums of squares would leave 64 bits. Fewer kept rows than entries give smaller codebooks; no
rows give no rows. Equal ids are rows of their own; of the rows that start the codebooks, equal ids
are ordered by vector, null ids come last. Null labels form one group. Equal vectors get equal codes.
Only id, vector and label are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from procflow.llm.common import BROADCAST_IDS, new_folder

#: Rows that a worker holds at once.
ROWS = 8192
#: Bounds are kept in 16 bits.
TOP = 65_535


@dataclass(frozen=True)
class VectorCodes:
    """``rows``: id, label, code (index per part), error; ``books``: (parts, entries, components)."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position, as decimals joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def label_errors(self) -> DataFrame:
        """``rows`` with ``label_error``, the sum of ``error`` over equal labels."""
        sums = self.rows.groupBy("label").agg(F.sum("error").alias("label_error"))
        sums = sums.withColumnRenamed("label", "_label")
        few = self.rows.select("label").distinct().count() <= BROADCAST_IDS
        sums = F.broadcast(sums) if few else sums
        return self.rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def whole_vectors(vectors: DataFrame, scale: int, names: tuple[str, str, str]) -> DataFrame:
    """(id, label, v) of the rows with finite components only; ``v`` has floor(scale * component)."""
    id_, vector, label = names
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & finite)
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return kept.select(F.col(id_).alias("id"), F.col(label).alias("label"), v.alias("v"))


def _of_one_length(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """The rows of the commonest length, with components of 32 bits, and that length."""
    ends = [F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")]
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), *ends)
    common = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not common:
        return rows.withColumn("v", F.col("v").cast("array<int>")), 0
    size, n, high, low = common[0]
    if size % parts:
        raise ValueError(f"vectors of {size} components cannot be cut into {parts} equal parts")
    largest = max(abs(high or 0), abs(low or 0))
    if largest >= 2**31 - 1 or size * (2 * largest) ** 2 >= 2**62 or largest * n >= 2**62:
        raise ValueError(f"components of up to {largest} whole units are too large for exact sums")
    return rows.where(F.size("v") == size).withColumn("v", F.col("v").cast("array<int>")), size


def _columns(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, width)


def _list(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel().astype(np.int32)))


def _squares(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return np.einsum("ij,ij->i", d, d)


def moved(history: np.ndarray, part: int) -> np.ndarray:
    """How far each entry of a part is now from where it was in each round, rounded up: (rounds, entries)."""
    now, then = history[-1, part], history[:, part]
    d = (then - now).astype(np.float64)
    return np.ceil(np.sqrt((d * d).sum(axis=2)) * (1 + 1e-9))


def assign(
    x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray, history: np.ndarray, part: int
) -> tuple[np.ndarray, int]:
    """The exact squared distance of each part vector to its nearest entry, and the number of distances computed.

    ``code``, ``bound`` and ``stamp`` are brought up to date in place.
    """
    book, now = history[-1, part], len(history) - 1
    n, entries = bound.shape
    rows = np.arange(n)
    best = _squares(x, book[code])
    bound[rows, code] = np.minimum(np.floor(np.sqrt(best) * (1 - 1e-9)), TOP)
    stamp[rows, code] = now
    low = bound - moved(history, part)[stamp, np.arange(entries)]
    # Squared distances are whole numbers; a bound that is not above the nearest so far decides nothing.
    near = low <= np.ceil(np.sqrt(best) * (1 + 1e-9))[:, None]
    near[rows, code] = False
    computed = n
    for e in range(entries):
        at = np.flatnonzero(near[:, e])
        if not len(at):
            continue
        d = _squares(x[at], book[e])
        computed += len(at)
        bound[at, e] = np.minimum(np.floor(np.sqrt(d) * (1 - 1e-9)), TOP)
        stamp[at, e] = now
        # Ties go to the lower index, whatever the assigned entry was.
        closer = (d < best[at]) | ((d == best[at]) & (e < code[at]))
        code[at[closer]] = e
        best[at[closer]] = d[closer]
    return best, computed


def _assign_rows(state: DataFrame, history: np.ndarray) -> DataFrame:
    """``state`` with code, bound and stamp of this round, and the row's error."""
    rounds, parts, entries, width = history.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                n = batch.num_rows
                v = _columns(batch, "v", parts * width).astype(np.int64)
                code = _columns(batch, "code", parts).astype(np.int64)
                bound = _columns(batch, "bound", parts * entries).astype(np.float64)
                stamp = _columns(batch, "stamp", parts * entries).astype(np.int64)
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    own = slice(p * entries, (p + 1) * entries)
                    c, b, s = code[:, p].copy(), bound[:, own].copy(), stamp[:, own].copy()
                    best, _ = assign(v[:, p * width : (p + 1) * width], c, b, s, history, p)
                    code[:, p], bound[:, own], stamp[:, own] = c, b, s
                    error += best
                arrays = [batch.column("id"), batch.column("label"), batch.column("v")]
                arrays += [_list(code), _list(bound), _list(stamp), pa.array(error)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "label", "v", "code", "bound", "stamp", "error"])

    return state.mapInArrow(work, StructType([*state.schema.fields, StructField("error", LongType())]))


def _sums(state: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(part, entry, n, position, total): how many parts an entry has, and the sum of their components."""
    _, parts, entries, width = shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            v = _columns(batch, "v", parts * width).astype(np.int64)
            code = _columns(batch, "code", parts)
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], v[:, p * width : (p + 1) * width])
        part, entry, position = (i.ravel() for i in np.indices((parts, entries, width)))
        columns = [part, entry, count[part, entry], position, total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "n", "position", "total"])

    schema = "part long, entry long, n long, position long, total long"
    found = state.select("v", "code").mapInArrow(work, schema)
    return found.groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _moved_book(book: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Every used entry at the floored mean of its parts."""
    new = book.copy()
    for r in sums.where("n > 0").collect():
        new[r["part"], r["entry"], r["position"]] = r["total"] // r["n"]
    return new


class _States:
    """The table of the current round; the one before is deleted once the next is written."""

    def __init__(self, first: DataFrame):
        self.spark, self.path = first.sparkSession, None
        self.write(first)

    def write(self, rows: DataFrame) -> None:
        path, old = new_folder(self.spark, "vector-codes"), self.path
        rows.write.parquet(path)
        self.path = path
        if old:
            gone = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def compress_vectors(
    vectors: DataFrame,
    names: tuple[str, str, str] = ("vec_id", "embedding", "label"),
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> VectorCodes:
    """Train the codebooks on all kept rows and encode these; ``names`` are the id, vector and label columns."""
    rows, size = _of_one_length(whole_vectors(vectors, scale, names), parts)
    width = size // parts
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    held = len(first)
    book = np.array(first, np.int64).reshape(held, parts, width).transpose(1, 0, 2)
    history = book[None]
    # Nothing is known yet: bounds of 0, measured in round 0.
    zeros = F.array_repeat(F.lit(0), parts * held)
    state = rows.select("id", "label", "v", F.array_repeat(F.lit(0), parts).alias("code"), zeros.alias("bound"), zeros.alias("stamp"))
    states = _States(state.withColumn("error", F.lit(0).cast("long")))
    if held:
        for _ in range(rounds):
            states.write(_assign_rows(states.read().drop("error"), history))
            book = _moved_book(history[-1], _sums(states.read(), history.shape))
            history = np.concatenate([history, book[None]])
        states.write(_assign_rows(states.read().drop("error"), history))
    return VectorCodes(states.read().select("id", "label", "code", "error"), history[-1])


def approximated(codes: VectorCodes, scale: int = 4096) -> DataFrame:
    """(id, vector): what the codes stand for, in the units of the input (middle of each unit)."""
    books = codes.books

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            code = _columns(batch, "code", parts)
            v = books[np.arange(parts), code].reshape(batch.num_rows, parts * width)
            flat = pa.array(((v + 0.5) / scale).ravel())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (parts * width))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, flat)], ["id", "vector"])

    return codes.rows.select("id", "code").mapInArrow(work, "id long, vector array<double>")
