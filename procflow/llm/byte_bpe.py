"""Byte-level BPE in Spark expressions: ranked merges folded over the bytes of words, and their undoing.

Splitting. A text is cut by the vocabulary's pattern; each match is a word. The pattern runs in Java's
matcher with Unicode white space, where it gives the same words as the tokenizer's own matcher.

Merging. A word that is a token of its own is that token. Any other is a row of single bytes; a fold
merges the neighbours of lowest rank, the leftmost first, until no two neighbours make a token. The
state of the fold is where the pieces begin and the rank of each pair, so a merge looks up two
ranks only. The ranks are one literal in the plan: an array of small maps, found by a hash of the
bytes, as a lookup in one large map would walk through all of it. Bytes are held as a text with one
character per byte.

Distinct words. A text is first cut where a word surely ends: at blanks that follow anything but white
space. The units between are counted over all documents; the frequent ones, as many as fit
``MOST_COMMON`` units of ``COMMON_BYTES`` bytes at most (so the table has a bound whatever the corpus),
are folded once each and become a second literal of the same form. All other words are folded where
they occur: most are unique to their document, and fetching their ids by a join would move every
document. No text is shuffled; the only shuffle is that of the counts, combined before it.

A fold's work grows with the square of the word's length, so words of more than ``LONG_WORD`` bytes
(a blob without blanks, a run of blanks) go through a heap in a Python worker, in n log n; the
worker gets these words alone.

Decoding concatenates the tokens' bytes: their hex digits are joined and read as binary, in time
linear in the text.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows and ids are
encoded row by row; an empty table gives no rows; a very long text is one row's work, linear in its
length; other columns are carried in ``row``, whatever their names. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.llm.common import power_of_two, stage

#: The frequent words kept with their ids in the plan: so many, of so many bytes at most.
MOST_COMMON, COMMON_BYTES = 1 << 18, 32
#: Words of more bytes are merged by a heap instead of a fold.
LONG_WORD = 512
#: Classes of word counts per doubling, from which the bound of the frequent words is chosen.
COUNT_CLASSES = 8
#: Before a blank that follows anything but white space. The pattern's words have a blank as their
#: first character or among white space only, so one always ends there.
BLANK_AFTER_WORD = r"(?= )(?<=\S)"
#: In a fold's numbers: stands for pairs that are no token, and the places in a word.
NO_RANK, PLACES = 1 << 30, 1 << 20
_BYTE = "ISO-8859-1"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _bucketed(entries: Iterable[tuple[str, object]], n: int) -> list[dict]:
    buckets: list[dict] = [{} for _ in range(n)]
    for key, value in entries:
        buckets[zlib.crc32(key.encode()) % n][key] = value
    return buckets


def map_literal(entries: dict[str, object], value_type: str) -> Column:
    """``entries`` as one literal: an array of maps, in which ``find`` looks a key up by its hash."""
    buckets = _bucketed(entries.items(), power_of_two(len(entries) / 4))
    text = json.dumps(buckets, separators=(",", ":"))
    return F.from_json(F.lit(text), f"array<map<string,{value_type}>>")


def find(maps: Column, buckets: int, key: Column) -> Column:
    """The value of ``key``, NULL if there is none."""
    return maps[F.pmod(F.crc32(key.cast("binary")), F.lit(buckets)).cast("int")][key]


@dataclass(frozen=True)
class ByteVocabulary:
    """The ranks of a vocabulary, which are its ids, and the pattern that splits text into words."""

    ranks: dict[bytes, int]
    pattern: str
    #: Places (of no width) at which a word of the pattern always ends.
    boundary: str = BLANK_AFTER_WORD

    @classmethod
    def of_file(cls, path: str, pattern: str) -> ByteVocabulary:
        """``path``: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    @property
    def buckets(self) -> int:
        return power_of_two(len(self.ranks) / 4)

    @property
    def rank_literal(self) -> Column:
        return map_literal({token.decode(_BYTE): rank for token, rank in self.ranks.items()}, "int")

    def units(self, text: Column) -> Column:
        """A text cut at the boundaries: runs of words; a missing text is one empty unit."""
        return F.split(F.coalesce(text, F.lit("")), f"(?U){self.boundary}")

    def words(self, unit: Column) -> Column:
        """The words of a unit, one after another."""
        return F.regexp_extract_all(unit, F.lit(f"(?U){self.pattern}"), F.lit(0))

    def rank(self, ranks: Column, token: Column) -> Column:
        return let(token, lambda t: find(ranks, self.buckets, t))

    def merged(self, ranks: Column, word: Column) -> Column:
        """Ids of one word (a string): its own rank, or those of its pieces after all merges."""
        spelled = F.decode(word.cast("binary"), _BYTE)

        def of(b: Column) -> Column:
            whole = self.rank(ranks, b)
            return let(whole, lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(self._folded(ranks, b)))

        return let(spelled, of)

    def _folded(self, ranks: Column, b: Column) -> Column:
        """The fold; ``b`` has two bytes at least.

        The state has one number per piece: the rank of the piece joined with the next one (``NO_RANK``
        if that is no token), times ``PLACES``, plus where the piece begins. Its minimum is the next
        pair to merge, the leftmost of equal ones.
        """
        n = F.char_length(b)

        def pair(begin: Column, end: Column) -> Column:
            rank = F.coalesce(self.rank(ranks, F.substr(b, begin, end - begin)), F.lit(NO_RANK))
            return rank.cast("long") * PLACES + begin

        def begin_of(state: Column, i: Column) -> Column:
            """Where piece ``i`` (from 0) begins; the end of the word after the last piece."""
            return F.coalesce((F.get(state, i) % PLACES).cast("int"), n + 1)

        def merge(state: Column, least: Column) -> Column:
            """The piece with the number ``least`` and the next one become one."""

            def renewed(value: Column, i: Column) -> Column:
                # Either the pair of the new piece and the one after it, or of the one before it and the new one.
                wider = pair((value % PLACES).cast("int"), begin_of(state, i + 3))
                last = F.lit(NO_RANK * PLACES) + value % PLACES
                merged = F.when(value == least, F.when(i + 2 < F.size(state), wider).otherwise(last))
                merged = merged.when(F.get(state, i + 1) == least, wider)
                return merged.when(F.get(state, i - 1) == least, F.lit(None)).otherwise(value)

            return F.filter(F.transform(state, renewed), lambda value: value.isNotNull())

        def step(state: Column, _: Column) -> Column:
            done = F.lit(NO_RANK * PLACES)
            return let(F.array_min(state), lambda least: F.when(least >= done, state).otherwise(merge(state, least)))

        def ids(state: Column) -> Column:
            def id_of(value: Column, i: Column) -> Column:
                begin = (value % PLACES).cast("int")
                return self.rank(ranks, F.substr(b, begin, begin_of(state, i + 1) - begin))

            return F.transform(state, id_of)

        last = F.lit(NO_RANK * PLACES) + n
        start = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, pair(i, i + 2)).otherwise(last))
        return F.aggregate(F.sequence(F.lit(2), n), start, step, ids)

    def token_bytes(self, ids: Column) -> Column:
        """The bytes that ``ids`` stand for; an id that the vocabulary lacks stands for none."""
        digits = [""] * self.n_ids
        for token, rank in self.ranks.items():
            digits[rank] = token.hex()
        return _from_hex(ids, digits)

    def id_bytes(self, ids: Column) -> Column:
        """``ids`` as little-endian unsigned 32-bit integers."""
        return _from_hex(ids, [i.to_bytes(4, "little").hex() for i in range(self.n_ids)])

    @property
    def n_ids(self) -> int:
        return max(self.ranks.values(), default=-1) + 1


def _from_hex(ids: Column, digits: list[str]) -> Column:
    """The bytes whose hex digits are those of each id, one after another."""
    table = F.split(F.lit(",".join(digits)), ",")
    return let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def merge_long(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """What ``ByteVocabulary.merged`` gives for the bytes of a long word, by a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(begin: int) -> None:
        if begin >= 0 and after[begin] < n:
            end = after[after[begin]]
            rank = ranks.get(word[begin:end])
            if rank is not None:
                heapq.heappush(heap, (rank, begin, end))

    for begin in range(n - 1):
        offer(begin)
    alive = [True] * n
    while heap:
        _, begin, end = heapq.heappop(heap)
        # A pair counts only if both of its pieces are still as they were.
        if not alive[begin] or after[begin] >= n or after[after[begin]] != end:
            continue
        gone = after[begin]
        alive[gone], after[begin] = False, end
        if end < n:
            before[end] = begin
        offer(begin)
        offer(before[begin])
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def unit_counts(docs: DataFrame, vocabulary: ByteVocabulary) -> DataFrame:
    """(unit, n, class): every distinct unit, how often it occurs, and the size class of that number."""
    units = docs.select(F.explode(vocabulary.units(F.col("text"))).alias("unit"))
    counts = units.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("class", F.floor(F.log2("n") * COUNT_CLASSES).cast("int"))


def common_units(docs: DataFrame, vocabulary: ByteVocabulary, most: int = MOST_COMMON) -> dict[str, list[int]]:
    """The ids of the most frequent units, as many whole classes of counts as hold ``most`` units at most.

    The distinct units are folded by Spark; what is collected has ``most`` rows of bounded width.
    """
    counts = unit_counts(docs, vocabulary).where((F.octet_length("unit") <= COMMON_BYTES) & (F.col("n") > 1))
    counts = stage(counts, "unit-counts")
    # At most COUNT_CLASSES rows for each doubling of the largest count.
    sizes = counts.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = None, 0
    for size_class, n in sorted(map(tuple, sizes), reverse=True):
        if held + n > most:
            break
        least, held = size_class, held + n
    if least is None:
        return {}
    ids = let(
        vocabulary.rank_literal,
        lambda ranks: F.flatten(F.transform(vocabulary.words(F.col("unit")), lambda w: vocabulary.merged(ranks, w))),
    )
    chosen = counts.where(F.col("class") >= least).select("unit", ids.alias("ids"))
    return {r["unit"]: r["ids"] for r in chosen.collect()}


def _long_ids(ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<array<int>>")
    def merge(words: pd.Series) -> pd.Series:
        return words.map(lambda some: [merge_long(ranks, w.encode()) for w in some])

    return merge


def encode_documents(docs: DataFrame, vocabulary: ByteVocabulary) -> DataFrame:
    """(row, ids) for every row of ``docs``; ``row`` holds all its columns."""
    known = common_units(docs, vocabulary)
    split = docs.select(F.struct("*").alias("row"), vocabulary.units(F.col("text")).alias("units"))
    # Equal long words of a text are merged once; most texts have none.
    long_units = F.filter("units", lambda u: F.octet_length(u) > LONG_WORD)
    long_words = F.flatten(F.transform(long_units, vocabulary.words))
    long_words = F.array_distinct(F.filter(long_words, lambda w: F.octet_length(w) > LONG_WORD))
    split = split.withColumn("long_words", long_words)
    split = split.withColumn("long_ids", _long_ids(vocabulary.ranks)(F.col("long_words")))
    buckets = power_of_two(len(known) / 4)

    def of_word(ranks: Column, common: Column, word: Column) -> Column:
        of_long = F.get("long_ids", (F.array_position("long_words", word) - 1).cast("int"))
        rest = F.when(F.octet_length(word) > LONG_WORD, of_long).otherwise(vocabulary.merged(ranks, word))
        return F.coalesce(find(common, buckets, word), rest)

    def of_unit(ranks: Column, common: Column, unit: Column) -> Column:
        one_by_one = F.transform(vocabulary.words(unit), lambda w: of_word(ranks, common, w))
        return F.coalesce(find(common, buckets, unit), F.flatten(one_by_one))

    ids = let(
        vocabulary.rank_literal,
        lambda ranks: let(
            map_literal(known, "array<int>"),
            lambda common: F.flatten(F.transform("units", lambda u: of_unit(ranks, common, u))),
        ),
    )
    return split.select("row", ids.alias("ids"))
