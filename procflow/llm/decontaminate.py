"""Benchmark decontamination by a prefix-filtered set join.

A window is ``n`` consecutive words of a benchmark item; an item of fewer words is one window. A
document contains a window only if it contains the window's rarest word, so that one word is the
necessary prefix (containment of 1 needs a prefix of one token under any order; the corpus
frequency makes it the most selective). The words of the windows are counted in all documents once,
and each window is joined with the counts of its words to find its prefix.

A document looks at the places of prefix words only. A place is a candidate for the windows that have
this word at a certain position and a certain length; it is dropped where such a window would reach
beyond the document (positional and length bounds). The words there are then joined with the words
of the windows, which verifies the containment exactly; the join is salted by rows.

Tasks learn what to look at from three filters of 2**``FILTER_BITS`` bits (2 MB each): the words of
windows, the prefix words with position and length, the windows. A filter has the same size for any
benchmark and is built by an aggregation; it never misses, and what it lets through wrongly (more
of a benchmark of many millions of windows) the joins drop. Nothing else of the benchmark or of the
documents goes through the driver, and documents are read twice, whatever the benchmark's size.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.

Defined cases: null and empty texts have no words, neither hits nor windows; items without id are
left out, repeated items count once by id; rows without or with repeated doc_id are judged each on
its own; an empty benchmark or table gives no hits or no rows; other columns are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from procflow.llm.common import carried_text, stage, text_bytes
from procflow.llm.words import small_batches, with_texts

WINDOW = 10
#: A filter has 2 to this power bits.
FILTER_BITS = 24
#: Words counted by a task before it sends them on.
COUNTED = 1 << 18
#: Texts are cut into words so many bytes at a time: their words take about ten times as much.
WORD_PIECE = 1 << 20
#: Rows of one window are joined in so many parts.
SALTS = 16
FOUND = "n_words long, spans array<struct<first:int,end:int>>, items array<string>"

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, digits and a-z and all bytes above 0x7F to themselves, the rest to a blank.
WORD_BYTES = bytes(b if b >= 0x80 or b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def benchmark_windows(items: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id as text, window: its words joined by blanks), distinct."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - n + 1) if words else 0):
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.binary())], ["item_id", "window"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("text"))
    return rows.mapInArrow(cut, "item_id string, window binary").distinct()


class Filter:
    """A set of byte strings as bits of their hashes: has no false negatives, and always the same size."""

    seed = 42

    def __init__(self, bits: bytes):
        self.bits = bits

    @classmethod
    def of(cls, values: DataFrame, column: str) -> Filter:
        bit = F.pmod(F.xxhash64(F.col(column).cast("binary")), F.lit(1 << FILTER_BITS)) + 1
        maps = values.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("at"))
        maps = maps.groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits"))
        bits = bytearray(1 << FILTER_BITS >> 3)
        # 2**FILTER_BITS / 32,768 rows of 4 KB at most.
        for k, of_bucket in maps.collect():
            bits[(k - 1) * len(of_bucket) : k * len(of_bucket)] = of_bucket
        return cls(bytes(bits))

    def __contains__(self, value: bytes) -> bool:
        bit = xxhash.xxh64_intdigest(value, self.seed) & ((1 << FILTER_BITS) - 1)
        return bool(self.bits[bit >> 3] >> (bit & 7) & 1)

    def among(self, texts: list[list[bytes]]) -> set[bytes]:
        """The words of ``texts`` that are in the filter; each is looked up once."""
        words = list(set().union(*texts))
        bit = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(self.seed)), np.uint64, len(words))
        bit = (bit & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
        return set(compress(words, np.frombuffer(self.bits, np.uint8)[bit >> 3] >> (bit & 7) & 1))


def word_counts(texts: DataFrame, wanted: Filter) -> DataFrame:
    """(word, n): how often each word in the filter occurs in all of ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()

        def out() -> pa.RecordBatch:
            rows = [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(rows, ["word", "n"])

        for batch in small_batches(batches, 0, WORD_PIECE):
            texts = [words_of(t) for t in batch.column(0).to_pylist()]
            known = wanted.among(texts)
            for words in texts:
                found.update(filter(known.__contains__, words))
                if len(found) > COUNTED:
                    yield out()
        yield out()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, at, size) of the windows: their rarest word, its place, and their length; distinct."""
    words = F.transform(F.split(F.col("window").cast("string"), " "), lambda w: w.cast("binary"))
    places = windows.select("window", F.size(words).alias("size"), F.posexplode(words).alias("at", "word"))
    places = places.join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p")
    return places.groupBy("window", "size").agg(rarest).select("p.word", "p.at", "size").distinct()


def _shaped(word: Column | bytes, at: Column | int, size: Column | int):
    """A prefix word with its position and its window's length as one byte string."""
    if isinstance(word, bytes):
        return b"%b %d %d" % (word, at, size)
    return F.concat(word, F.lit(" ").cast("binary"), F.concat_ws(" ", at, size).cast("binary"))


def candidates(
    words: list[bytes], shapes_of: dict[bytes, list[tuple[int, int]]], windows: Filter
) -> list[tuple[bytes, int, int]]:
    """(words joined by blanks, first, end) of the places that a window may have."""
    out, n = [], len(words)
    if shapes_of.keys().isdisjoint(words):
        return out
    for i in [i for i, w in enumerate(words) if w in shapes_of]:
        for at, size in shapes_of[words[i]]:
            first, end = i - at, i - at + size
            if first >= 0 and end <= n and (found := b" ".join(words[first:end])) in windows:
                out.append((found, first, end))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _looked_up(docs: DataFrame, words: Filter, prefix: Filter, shapes: list[tuple[int, int]], windows: Filter) -> DataFrame:
    """(row, _r, n_words, places: candidates) of (row, _r, _bytes), or of (row, _r) if the rows hold the texts."""
    held = len(docs.columns) == 2
    places_type = pa.list_(pa.struct([("window", pa.binary()), ("first", pa.int32()), ("end", pa.int32())]))
    names = ["window", "first", "end"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = with_texts(batches, "text") if held else batches
        for batch in small_batches(batches, 2, WORD_PIECE):
            n_words, places = [], []
            texts = [words_of(t) for t in batch.column(2).to_pylist()]
            shapes_of = {w: [s for s in shapes if _shaped(w, *s) in prefix] for w in words.among(texts)}
            for of_text in texts:
                n_words.append(len(of_text))
                places.append([dict(zip(names, c, strict=True)) for c in candidates(of_text, shapes_of, windows)])
            new = [pa.array(n_words, pa.int64()), pa.array(places, places_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["row", "_r", "n_words", "places"])

    new = StructType.fromDDL("n_words long, places array<struct<window:binary,first:int,end:int>>")
    return docs.mapInArrow(look, StructType([*docs.schema.fields[:2], *new.fields]))


def _hits(looked_up: DataFrame, windows: DataFrame) -> DataFrame:
    """(_r, spans: merged, items) of the rows in which windows occur: places whose words are a window's."""
    held = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    places = looked_up.select("_r", F.explode("places").alias("p"))
    # Rows, not places: each window of a row is joined once, with all its places.
    places = places.groupBy("_r", "p.window").agg(F.collect_list(F.struct("p.first", "p.end")).alias("spans"))
    places = places.withColumn("salt", F.pmod(F.xxhash64("_r"), F.lit(SALTS)).cast("int"))
    found = places.join(held, ["window", "salt"]).groupBy("_r").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged([(s["first"], s["end"]) for s in of_row]) for of_row in batch.column(1).to_pylist()]
            spans = [[{"first": a, "end": b} for a, b in of_row] for of_row in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, batch.column(1).type), batch.column(2)], ["_r", "spans", "items"])

    return found.mapInArrow(merge, "_r long, " + FOUND.partition(", ")[2])


def find_benchmark(docs: DataFrame, items: DataFrame, n: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """(row: struct of ``carry``, by default all columns, n_words, spans, items) for every row of ``docs``."""
    windows = stage(benchmark_windows(items, n), "benchmark-windows")
    texts = docs.select(text_bytes().alias("_bytes"))
    of_windows = windows.select(F.explode(F.split(F.col("window").cast("string"), " ")).alias("word"))
    counts = stage(word_counts(texts, Filter.of(of_windows, "word")), "benchmark-word-counts")
    prefix = stage(prefixes(windows, counts), "benchmark-prefixes")
    # At most n * (n + 1) / 2 shapes.
    shapes = [tuple(s) for s in prefix.select("at", "size").distinct().collect()]
    shaped = prefix.select(_shaped(F.col("word"), F.col("at"), F.col("size")).alias("shaped"))
    carry = carry or docs.columns
    held = [] if carried_text(docs, carry) else [text_bytes().alias("_bytes")]
    rows = docs.select(F.struct(*carry).alias("row"), F.monotonically_increasing_id().alias("_r"), *held)
    found = _looked_up(rows, Filter.of(prefix, "word"), Filter.of(shaped, "shaped"), shapes, Filter.of(windows, "window"))
    found = stage(found, "benchmark-candidates")
    hits = stage(_hits(found, windows), "benchmark-hits")
    out = found.select("row", "_r", "n_words").join(hits, "_r", "left")
    none = {c: F.array().cast(hits.schema[c].dataType) for c in ("spans", "items")}
    return out.select("row", "n_words", *[F.coalesce(c, none[c]).alias(c) for c in none])
