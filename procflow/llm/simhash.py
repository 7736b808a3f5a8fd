"""SimHash fingerprints of 128 bits and their search within a Hamming radius.

The terms of a text are its runs of ``TERM_WORDS`` words (A-Z lowered; a shorter text is one
term), weighted by 1 + ln(occurrences). Each term's hash votes on the sign of every bit with its
weight. Two texts' likeness is the share of equal bits.

``within_radius`` finds all pairs of different fingerprints that differ in at most ``radius`` bits.
The bits are cut into ``blocks`` blocks; two such fingerprints agree on at least ``blocks -
radius`` whole blocks, so for every choice of that many blocks there is a table keyed by them (a
permutation that puts these blocks first), and equal keys of one table are compared bit by bit.
Equal fingerprints are one row before the search.

``near_classes`` searches wide radii, where whole blocks rarely agree. Equal fingerprints are one
class. The bits are cut into ``blocks`` blocks; two fingerprints within the radius differ in at
most ``radius // blocks`` bits of one block at least, so a table per block, probed with the block
of the query and all its changes of so many bits, misses nothing; what it finds is compared on all
bits. Classes are cut into chunks and the asked ones into parts; each pair of the two is one task's
work. So the probes of a query, and the work, grow with the number of chunks.

Defined cases: a null or empty text, or one of white space, has no terms and the fingerprint of
zeros; rows without doc_id come last, rows that share one lie in the order of their texts; the
only document is its own neighbour; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.llm.common import NO_ID, id_or_last, stage, text_bytes
from procflow.llm.words import K2, WordHashes, mix, small_batches, window_hashes

BITS = 128
TERM_WORDS = 3
#: Classes of a chunk, asked classes of a part, and fingerprints of a row in which they travel.
CHUNK, PART, PACK = 1 << 20, 1 << 15, 1 << 13
#: Keys that a table is probed with at once, and candidates that are compared at once.
PROBES = 1 << 18
#: Terms whose votes are counted at once.
TERMS_AT_ONCE = 1 << 14


def fingerprint(text: bytes, hashes: WordHashes) -> bytes:
    h = hashes.of(text.lower().split())
    if not len(h):
        return bytes(BITS // 8)
    terms, counts = np.unique(window_hashes(h, min(TERM_WORDS, len(h))), return_counts=True)
    weights = (1 + np.log(counts)).astype(np.float32)
    votes = np.zeros(BITS)
    for low in range(0, len(terms), TERMS_AT_ONCE):
        t, w = terms[low : low + TERMS_AT_ONCE], weights[low : low + TERMS_AT_ONCE]
        both = np.stack([t, mix(t ^ K2)], axis=1).astype("<u8")
        votes += w @ np.unpackbits(both.view(np.uint8), axis=1).astype(np.float32)
    return np.packbits(votes > weights.sum(dtype=np.float64) / 2).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of ``text``, and it with its second half replaced by the start of ``following``."""
    s = text.decode("utf-8", "replace")
    n = len(s) // 2
    return len(s), (s[: len(s) - n] + following.decode("utf-8", "replace")[:n]).encode()


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judged(doc_id: int | None, text: bytes, mark: bytes, other: bytes, other_mark: bytes, hashes: WordHashes) -> dict:
    n_chars, changed = edited(text, other)
    new = fingerprint(changed, hashes)
    return {
        "doc_id": doc_id,
        "n_chars": n_chars,
        "edited_sha256": hashlib.sha256(changed).hexdigest(),
        "fingerprint": mark.hex(),
        "edited_fingerprint": new.hex(),
        "near_edited": likeness(mark, new),
        "near_next": likeness(mark, other_mark),
    }


def fingerprints_with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text and of its edited text, with the next document by descending doc_id.

    Texts are range-partitioned by doc_id, so the next document is the row before in the same
    partition. The first row of a partition needs the last one of the partition before (for the
    smallest of all: the largest): these two rows per partition are staged with their texts and
    joined by the partitions' order.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, before = WordHashes(), TaskContext.get().partitionId(), None
        schema = pa.schema([(c, t) for c, t in zip(names, types, strict=True)])
        empty = dict.fromkeys(names)
        for batch in small_batches(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = fingerprint(text, hashes)
                if before is None:
                    rows.append({**empty, "kind": 1, "part": part, "doc_id": doc_id, "text": text})
                else:
                    rows.append({**empty, "kind": 0, "part": part, **_judged(doc_id, text, mark, *before, hashes)})
                before = (text, mark)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{**empty, "kind": 2, "part": part, "text": before[0]}], schema)

    names = [f.split()[0] for f in FIELDS.split(", ")] + ["kind", "part", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = rows.repartitionByRange(id_or_last()).sortWithinPartitions(id_or_last(), "text")
    found = stage(rows.mapInArrow(scan, f"{FIELDS}, kind int, part int, text binary"), "fingerprints")

    # Two rows per partition: the order of the partitions is a table of their numbers only.
    firsts = found.where("kind = 1").select("part", "doc_id", "text")
    order = firsts.select("part")
    in_order = Window.orderBy("part")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("part").over(in_order), F.max("part").over(whole))
    order = order.select("part", before.alias("before"))
    lasts = found.where("kind = 2").select(F.col("part").alias("before"), F.col("text").alias("other"))
    pairs = firsts.join(order, "part").join(lasts, "before").select("doc_id", "text", "other")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        schema = pa.schema(list(zip(names[:7], types[:7], strict=True)))
        for batch in small_batches(batches, 1):
            rows = []
            for r in batch.to_pylist():
                a, b = (fingerprint(r[c], hashes) for c in ("text", "other"))
                rows.append(_judged(r["doc_id"], r["text"], a, r["other"], b, hashes))
            yield pa.RecordBatch.from_pylist(rows, schema)

    inner = found.where("kind = 0").select(*names[:7])
    return inner.unionAll(pairs.mapInArrow(finish, FIELDS))


def _halves(mark: Column) -> list[Column]:
    """A fingerprint's hex text as numbers of 32 bits."""
    return [F.conv(F.substring(mark, i, 8), 16, 10).cast("long") for i in range(1, BITS // 4, 8)]


def hamming(a: Column, b: Column) -> Column:
    different = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_halves(a), _halves(b), strict=True)]
    return sum(different[1:], different[0])


def within_radius(marks: DataFrame, radius: int = 3, blocks: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """(query, fingerprint, distance): all pairs of different fingerprints at most ``radius`` apart.

    ``marks`` and ``queries`` have a column ``fingerprint``; without ``queries`` each pair of
    ``marks`` is returned once, the smaller text first.
    """
    if not radius < blocks <= BITS // 4 or (BITS // 4) % blocks:
        raise ValueError("blocks must divide the hex digits and exceed the radius")
    size = BITS // 4 // blocks

    def tables(df: DataFrame, name: str) -> DataFrame:
        mark = F.col("fingerprint")
        keys = [
            F.struct(F.lit(i).alias("t"), F.concat(*[F.substring(mark, b * size + 1, size) for b in chosen]).alias("k"))
            for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
        one = df.select("fingerprint").where("fingerprint is not null").distinct()
        return one.select(mark.alias(name), F.explode(F.array(*keys)).alias("key"))

    left = tables(marks if queries is None else queries, "query")
    right = tables(marks, "fingerprint")
    pairs = left.join(right, "key")
    pairs = pairs.where("query < fingerprint" if queries is None else "query <> fingerprint")
    pairs = pairs.withColumn("distance", hamming(F.col("query"), F.col("fingerprint")))
    return pairs.where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def _changes(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits of which at most ``most`` are set."""
    masks = [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]
    return np.array(masks, np.uint64)


def near_pairs(queries: np.ndarray, marks: np.ndarray, radius: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``queries``, place in ``marks``, distance) of all at most ``radius`` apart; rows of two 64-bit numbers."""
    cuts = [round(k * 64 / (blocks // 2)) for k in range(blocks // 2 + 1)]
    found = []
    for half in (0, 1):
        for low, high in zip(cuts, cuts[1:], strict=False):
            block = lambda x: (x[:, half] >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)  # noqa: B023, E731
            key = block(marks)
            order = np.argsort(key, kind="stable")
            bounds = np.searchsorted(key[order], np.arange((1 << (high - low)) + 1, dtype=np.uint64))
            changes, asked = _changes(high - low, radius // blocks), block(queries)
            for at in range(0, len(queries), step := max(1, PROBES // len(changes))):
                probes = (asked[at : at + step, None] ^ changes).astype(np.int64).ravel()
                first = bounds[probes]
                size = bounds[probes + 1] - first
                some = np.flatnonzero(size)
                first, size, query = first[some], size[some], at + some // len(changes)
                ends = np.cumsum(size)
                # A probe may meet a large bucket: candidates are taken in runs of bounded length.
                for a in range(0, total := int(ends[-1]) if len(ends) else 0, PROBES):
                    place = np.arange(a, min(a + PROBES, total))
                    probe = np.searchsorted(ends, place, side="right")
                    m = order[first[probe] + place - (ends[probe] - size[probe])]
                    q = query[probe]
                    distance = np.bitwise_count(queries[q] ^ marks[m]).sum(axis=1, dtype=np.int64)
                    near = distance <= radius
                    found.append(np.stack([q[near], m[near], distance[near]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    # A pair that several tables find counts once.
    q, m, distance = np.concatenate(found, axis=1)
    _, once = np.unique(q * len(marks) + m, return_index=True)
    return q[once], m[once], distance[once]


PARTNERS = "array<struct<distance: int, doc_id: bigint, n_docs: bigint, fingerprint: string>>"


def near_classes(rows: DataFrame, asked: Column, radius: int, blocks: int) -> DataFrame:
    """(query, n_within, n_partners, partners) per fingerprint of the ``asked`` rows of (doc_id, fingerprint).

    ``partners``: every class of equal fingerprints in the radius, its own included, nearest first:
    distance, smallest doc_id, number of rows, fingerprint. ``n_within``: the classes but its own;
    ``n_partners``: the rows of all of them but one, the asking row.
    """
    if blocks % 2 or not 6 <= blocks <= BITS // 4:
        raise ValueError("blocks must be an even number of 6 to 32: tables have a place per value of a block")
    classes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.max(asked).alias("asked"))
    classes = stage(classes, "fingerprint-classes")
    n, n_asked = classes.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    chunks, parts = max(1, -(-n // CHUNK)), max(1, -(-n_asked // PART))

    def packed(df: DataFrame, size: int, groups: int, name: str) -> DataFrame:
        packs = max(groups, -(-size // PACK))

        def pack(table: pa.Table) -> pa.Table:
            marks = bytes.fromhex("".join(table.column("fingerprint").to_pylist()))
            ids, sizes = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("doc_id", "n_docs"))
            return pa.table({"pack": table.column("pack")[:1], "marks": pa.array([marks], pa.binary()), "ids": pa.array([ids], pa.binary()), "sizes": pa.array([sizes], pa.binary())})

        df = df.select(F.pmod(F.xxhash64("fingerprint"), F.lit(packs)).alias("pack"), "fingerprint", id_or_last().alias("doc_id"), "n_docs")
        df = df.groupBy("pack").applyInArrow(pack, "pack long, marks binary, ids binary, sizes binary")
        return stage(df.withColumn(name, F.pmod("pack", F.lit(groups))).drop("pack"), f"fingerprint-{name}s")

    def search(table: pa.Table) -> pa.Table:
        of = lambda c, kind, rows: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
        whole, some = (table.filter(pc.equal(table.column("asks"), x)) for x in (False, True))
        marks, queries = (of("marks", "<u8", x).reshape(-1, 2) for x in (whole, some))
        ids, sizes = of("ids", "<i8", whole), of("sizes", "<i8", whole)
        q, m, distance = near_pairs(queries, marks, radius, blocks)
        first = np.unique(q, return_index=True)[1]
        bounds = np.append(first, len(q)).astype(np.int32)
        texts = lambda x: pa.array([r.tobytes().hex() for r in x], pa.string())
        partners = pa.StructArray.from_arrays(
            [pa.array(distance.astype(np.int32)), pa.array(ids[m], mask=ids[m] == NO_ID), pa.array(sizes[m]), texts(marks[m])],
            ["distance", "doc_id", "n_docs", "fingerprint"],
        )
        sums = lambda x: pa.array(np.add.reduceat(x, first) if len(first) else x[:0], pa.int64())
        columns = {"query": texts(queries[q[first]]), "n_within": sums((distance > 0).astype(np.int64)), "n_rows": sums(sizes[m])}
        return pa.table({**columns, "partners": pa.ListArray.from_arrays(pa.array(bounds), partners)})

    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    marks = packed(classes, n, chunks, "chunk").select("chunk", each(parts).alias("part"), "marks", "ids", "sizes", F.lit(False).alias("asks"))
    queries = packed(classes.where("asked"), n_asked, parts, "part").select(each(chunks).alias("chunk"), "part", "marks", "ids", "sizes", F.lit(True).alias("asks"))
    found = marks.unionByName(queries).groupBy("chunk", "part").applyInArrow(search, f"query string, n_within long, n_rows long, partners {PARTNERS}")
    found = stage(found, "near-fingerprints").groupBy("query").agg(
        F.sum("n_within").alias("n_within"), F.sum("n_rows").alias("n_rows"), F.flatten(F.collect_list("partners")).alias("partners")
    )
    return found.select("query", "n_within", (F.col("n_rows") - 1).alias("n_partners"), F.array_sort("partners").alias("partners"))


def partner_ids(rows: DataFrame) -> DataFrame:
    """(doc_id, partner_id, distance): the classes in ``partners`` of (doc_id, fingerprint, partners), row by row.

    One row per row of another doc_id in a class; rows without doc_id are not told apart.
    """
    one = rows.where("partners is not null").select("doc_id", F.explode("partners").alias("near"))
    members = rows.select(F.col("doc_id").alias("partner_id"), F.col("fingerprint").alias("mark"))
    pairs = one.join(members, F.col("near.fingerprint") == F.col("mark"))
    return pairs.where("not (doc_id <=> partner_id)").select("doc_id", "partner_id", "near.distance")
