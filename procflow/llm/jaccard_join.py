"""N-gram Jaccard join: an exact similarity join in the metric space of shingle sets.

Two documents are linked when the Jaccard similarity of their sets of ``WORDS``-word shingles is at
least ``percent`` / 100; the Jaccard distance, 1 minus it, is a metric. The result is the connected
component of every document, so links inside a component that is known already need no check.

1. *Far documents.* A set's shingles that no other set has cannot be shared. With more than (100 -
   percent)% of them a document is farther than the threshold from every other one and leaves.
   Shingles are compared in shards of the hash space: per block of documents each distinct shingle
   is sent once (4 bytes of hash, as the step from the one before, and 2 of place; both compressed),
   and per block the counts come back.
2. *Copies.* Equal sets become one node.
3. *Pivots and Voronoi regions.* Two linked sets share a shingle among the (100 - percent)% + 1
   that come first in each, in one order of all shingles: by the number of sets that hold them,
   as far as a table of the most frequent ones (of bounded size) tells, then by hash. So a common
   line makes no region of sets that have enough other shingles. The sets that hold such a shingle
   are in the region of a pivot, the one of them with the highest (random) priority; sets on the
   boundary of several regions are replicated to them. A set's home is the pivot with which it
   shares the most. Its distance to the home is computed, and within the threshold the two are
   linked.
4. *Regions, exactly.* Regions whose sets all belong to one component by now are finished. The
   others are joined set by set: a small one in one task; a large one is cut once more, into
   classes of set sizes, rings of equal distance to the pivot, and runs of these as cells. Linked
   sets differ in size by the threshold at most, and by the triangle inequality so do their
   distances to the pivot; cells are replicated only to those inside both windows, and sets of the
   pivot's component are not compared with each other. Two cells are joined by products of their
   0/1 matrices, which give all intersections; of the links found, those that connect components
   are returned.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; shingles are compared by 64-bit hashes.

Defined cases: a null or empty text has no shingles, links with nothing and is its own component;
fewer words than ``WORDS`` make one shingle; rows without doc_id are one document after all others;
rows that share a doc_id are one document, which links where any of them does; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procflow.llm.common import NO_ID, id_or_last, keep_ids, power_of_two, stage, text_bytes
from procflow.llm.components import components
from procflow.llm.words import WordHashes, shingle_set, small_batches

WORDS = 5
PERCENT = 80
#: Shingles of a block of documents and, on average, of a shard of the hash space.
BLOCK_SHINGLES = 1_500_000
SHARD_SHINGLES = 2_000_000
BLOCK_DOCS = 60_000
SHARED = 65_535
#: Sets and shingles of a cell that one task joins (two cells at a time), and rings of distance 0 to 1.
CELL_SETS = 500
CELL_SHINGLES = 1_000_000
RINGS = 50
#: Parts of a cell that the weights of its sets are counted in.
CELL_PARTS = 1_000_000
#: Frequent shingles that a worker knows (16 bytes each), and the least number of sets that hold one.
FREQUENT = 1 << 19
LEAST_SETS = 4
#: Numbers of a 0/1 matrix at once.
MATRIX = 4_000_000

PROFILE = np.dtype([("d", "<i8"), ("n", "<i8"), ("shared", "<i8"), ("key", "S16"), ("last", "u1")])


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as bytes: the first byte of each, then the second and so on, each compressed alone."""
    codec = pa.Codec("zstd", compression_level=1)
    planes = np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T)
    parts = [codec.compress(plane, asbytes=True) for plane in planes]
    return np.array([len(values), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    """The numbers of ``packed``."""
    codec, width = pa.Codec("zstd"), np.dtype(kind).itemsize
    count, *sizes = np.frombuffer(data, "<u4", 1 + width).tolist()
    at, planes = 4 * (1 + width), []
    for size in sizes:
        planes.append(np.frombuffer(codec.decompress(data[at : at + size], count), "u1"))
        at += size
    return np.stack(planes, axis=1).reshape(-1).view(kind)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set; none for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def _blocks(docs: DataFrame, bits: int) -> DataFrame:
    """Per block: a row per shard with its distinct shingles, and a head row with its documents."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("places", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 24
        sets, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(sets)
            place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(flat, kind="stable")
            flat, place = flat[order], place[order]
            same = flat[1:] == flat[:-1]
            first, again = np.ones(len(flat), bool), np.zeros(len(flat), bool)
            first[1:] = ~same
            again[1:] |= same
            again[:-1] |= same
            shared = np.bincount(place[again], minlength=len(sets))
            head = np.zeros(len(sets), PROFILE)
            head["d"], head["n"], head["shared"] = ids, [len(s) for s in sets], shared
            keys = [set_key(s) for s in sets]
            # Fixed-width bytes lose trailing zeros; the last byte is kept apart.
            head["key"], head["last"] = [k[:15] + b"\x01" if k else b"" for k in keys], [k[15] if k else 0 for k in keys]
            place[again] = SHARED
            flat, place = flat[first], place[first].astype("<u2")
            cuts = np.searchsorted(flat, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
            cuts = np.append(cuts, len(flat))
            tokens = ((flat << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
            rows = [(-1 - number, number, head.tobytes(), b"")]
            # Sorted, so the steps from one hash to the next take fewer bytes than the hashes.
            steps = [np.diff(tokens[a:b], prepend=tokens.dtype.type(0)) for a, b in zip(cuts, cuts[1:], strict=False)]
            rows += [(k, number, packed(step), packed(place[cuts[k] : cuts[k + 1]])) for k, step in enumerate(steps) if len(step)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in small_batches(batches, 1):
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sets.append(shingle_set(hashes.of(text.lower().split()), WORDS))
                ids.append(d)
                size += len(sets[-1])
                if size >= BLOCK_SHINGLES or len(sets) >= BLOCK_DOCS:
                    yield close()
                    sets, ids, size, number = [], [], 0, number + 1
        if sets:
            yield close()

    return docs.select("_d", "_bytes").mapInArrow(build, "part long, block long, tokens binary, places binary")


def _shared_between_blocks(table: pa.Table) -> pa.Table:
    """For one shard: per block, how many of each document's shingles other blocks have, too."""
    blocks, tokens = table.column("block").to_pylist(), table.column("tokens").to_pylist()
    if table.column("part")[0].as_py() < 0:
        return pa.table({"block": pa.array(blocks, pa.int64()), "head": pa.array(tokens, pa.binary()), "counts": pa.nulls(len(blocks), pa.binary())})
    tokens = [np.cumsum(unpacked(t, "<u4"), dtype="<u4") for t in tokens]
    values = np.concatenate(tokens)
    places = np.concatenate([unpacked(p, "<u2") for p in table.column("places").to_pylist()])
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    again = np.zeros(len(values), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again &= places != SHARED
    ends = np.cumsum([len(t) for t in tokens])[:-1]
    parts = zip(np.split(places, ends), np.split(again, ends), strict=True)
    counts = [np.bincount(place[found]).astype("<u4").tobytes() for place, found in parts]
    return pa.table({"block": pa.array(blocks, pa.int64()), "head": pa.nulls(len(blocks), pa.binary()), "counts": pa.array(counts, pa.binary())})


def _profiles_of_block(table: pa.Table) -> pa.Table:
    head = next(h for h in table.column("head").to_pylist() if h is not None)
    head = np.frombuffer(head, PROFILE).copy()
    for counts in pc.drop_null(table.column("counts")).to_pylist():
        part = np.frombuffer(counts, "<u4")
        head["shared"][: len(part)] += part
    keys = [bytes(k[:15]) + bytes([last]) if k else b"" for k, last in zip(head["key"].tolist(), head["last"].tolist(), strict=True)]
    return pa.table({"_d": head["d"], "n": head["n"], "shared": head["shared"], "key": pa.array(keys, pa.binary())})


def profiles(docs: DataFrame, shingles: float) -> DataFrame:
    """(_d, n, shared, key) per row of (_d, _bytes): set size, how many of its shingles other rows have."""
    bits = power_of_two(shingles / SHARD_SHINGLES).bit_length() - 1
    parts = _blocks(docs, min(bits, 31)).groupBy("part").applyInArrow(_shared_between_blocks, "block long, head binary, counts binary")
    return parts.groupBy("block").applyInArrow(_profiles_of_block, "_d long, n long, shared long, key binary")


def _near(rows: DataFrame, percent: int) -> DataFrame:
    """Rows that may be linked: at most (100 - percent)% of the set is theirs alone."""
    return rows.where((F.col("n") > 0) & (F.lit(100) * (F.col("n") - F.col("shared")) <= F.lit(100 - percent) * F.col("n")))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(_d, n, shingles: sorted 64-bit hashes as bytes)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, 1):
            sets = [shingle_set(hashes.of(t.lower().split()), WORDS) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["_d", "n", "shingles"])

    return docs.select("_d", "_bytes").mapInArrow(build, "_d long, n long, shingles binary")


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT`` of the shingles that the most sets hold, sorted, and how many sets hold each.

    All shingles are counted. Those of ``LEAST_SETS`` sets or more are taken by classes of doubled
    counts, the largest first, as long as a class fits.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            held = [np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()]
            t, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["t", "n"])

    counts = sets.mapInArrow(cut, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    counts = stage(counts.where(F.col("n") >= LEAST_SETS), "frequent-shingles")
    kind = F.floor(F.log2("n")).cast("int").alias("kind")
    least, room = None, FREQUENT
    for row in counts.groupBy(kind).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("kind")).collect():
        room -= row["n"]
        if room < 0:
            break
        least = row["kind"]
    found = counts.where(F.lit(False) if least is None else kind >= least).toArrow()
    t, n = (found.column(c).to_numpy().astype(np.int64) for c in ("t", "n"))
    order = np.argsort(t)
    return t[order], n[order]


def prefixes(sets: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, x, n): the shingles of each set of which linked sets must share one, rarer ones first.

    What ``frequent`` does not hold counts as rarer than all that it holds. Any numbers make one
    order of all shingles, so the result of the join does not depend on them.
    """
    known, uses = frequent

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            n = batch.column(1).to_numpy()
            flat = np.concatenate([np.frombuffer(s, np.int64) for s in batch.column(2).to_pylist()])
            owner = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, uses[at], 0)
            # Stable: shingles of one rank stay in the order of their hashes.
            flat = flat[np.lexsort((rank, owner))]
            length = n - (n * percent + 99) // 100 + 1
            first = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(length, n)
            columns = [flat[first], np.repeat(batch.column(0).to_numpy(), length), np.repeat(n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "x", "n"])

    return sets.mapInArrow(cut, "t long, x long, n long")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, common, n_x, n_y) for (x, y); the sets are joined to the pairs, not the pairs to each other."""
    left = sets.select(F.col("_d").alias("x"), F.col("n").alias("n_x"), F.col("shingles").alias("a"))
    right = sets.select(F.col("_d").alias("y"), F.col("n").alias("n_y"), F.col("shingles").alias("b"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "n_x", "n_y", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4):
            common = [
                len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ]
            arrays = [*(batch.column(i) for i in range(4)), pa.array(common, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["x", "y", "n_x", "n_y", "common"])

    return both.mapInArrow(compare, "x long, y long, n_x long, n_y long, common long")


def _union() -> Column:
    return F.col("n_x") + F.col("n_y") - F.col("common")


def _linked(percent: int) -> Column:
    return F.lit(100) * F.col("common") >= F.lit(percent) * _union()


def _home_links(members: DataFrame, pivots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): sets within the threshold of their home, the pivot with which they share the most."""
    shared = members.join(pivots, "t").where("x <> p").groupBy("x", "p").agg(F.count(F.lit(1)).alias("shared"))
    home = shared.groupBy("x").agg(F.max(F.struct("shared", F.negative("p").alias("p")))["p"].alias("p"))
    found = distances(home.select("x", F.negative("p").alias("y")), sets)
    return stage(found.where(_linked(percent)).select("x", "y"), "home-links")


def _open_regions(members: DataFrame, pivots: DataFrame, links: DataFrame) -> DataFrame:
    """(p, x, n, c): the regions whose shingles join several components ``c``."""
    known = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")))
    known = known.select(F.col("node").alias("x"), F.col("component").alias("c"))
    rows = members.join(pivots, "t").join(known, "x", "left").withColumn("c", F.coalesce("c", "x"))
    rows = stage(rows, "regions")
    several = rows.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    several = stage(several.where("low < high").select("t"), "open-shingles")
    return stage(rows.join(several, "t", "left_semi").select("p", "x", "n", "c").distinct(), "open-regions")


CELL = ["p", "core", "size", "cell"]


def _cells(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(p, x, n, c, ring, core, size, cell): regions cut into cells that one task can join.

    A small region is one cell. A large one is cut into the sets of the pivot's component (``core``)
    and the others, these into classes of set sizes, and each class, in the order of the distances
    to the pivot, into as many cells as its sets and shingles need.
    """
    size = regions.groupBy("p").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    large = size.where((F.col("sets") > CELL_SETS) | (F.col("shingles") > CELL_SHINGLES)).select("p")
    large = stage(large, "large-regions")
    zero = F.lit(0)
    small = regions.join(large, "p", "left_anti")
    small = small.withColumns({"ring": zero, "core": F.lit(False), "size": zero, "cell": zero})
    inside = regions.join(large, "p", "left_semi")
    to_pivot = distances(inside.where("x <> p").select("x", F.col("p").alias("y")), sets)
    apart = F.lit(RINGS) * (_union() - F.col("common")) / _union()
    to_pivot = to_pivot.select("x", F.col("y").alias("p"), F.floor(apart).cast("int").alias("ring"))
    of_pivot = inside.where("x = p").select("p", F.col("c").alias("c_p"))
    inside = inside.join(to_pivot, ["x", "p"], "left").join(of_pivot, "p")
    kind = F.floor(F.log(F.col("n")) / math.log(100 / percent)).cast("int") if 0 < percent < 100 else zero
    inside = inside.withColumns({"ring": F.coalesce("ring", zero), "core": F.col("c") == F.col("c_p"), "size": kind})
    inside = stage(inside, "rings")
    weight = F.greatest(F.count(F.lit(1)) / CELL_SETS, F.sum("n") / CELL_SHINGLES) * CELL_PARTS
    need = inside.groupBy("p", "core", "size", "ring").agg(F.ceil(weight).alias("need"))
    # One row per ring: a window has 51 rows at most.
    before = Window.partitionBy("p", "core", "size").orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    need = need.withColumn("before", F.coalesce(F.sum("need").over(before), F.lit(0)))
    place = F.col("before") + F.pmod(F.xxhash64("x"), F.col("need"))
    inside = inside.join(need, ["p", "core", "size", "ring"]).withColumn("cell", F.floor(place / CELL_PARTS).cast("int"))
    columns = [*CELL, "x", "n", "c", "ring"]
    return stage(small.select(*columns).unionByName(inside.select(*columns)), "cells")


def _cell_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """(*CELL, pair): the pairs of cells that each cell takes part in.

    The distances of two linked sets to one pivot differ by the threshold at most, and so do their
    sizes, so only cells that near are paired. Cells of the pivot's component are not paired with
    each other.
    """
    ends = [f(c).alias(f"{name}_{c}") for c in ("ring", "n") for name, f in (("low", F.min), ("high", F.max))]
    one = stage(cells.groupBy(*CELL).agg(*ends), "cell-list")
    other = one.select("p", *[F.col(c).alias(f"{c}_b") for c in one.columns if c != "p"])
    reach = (100 - percent) * RINGS // 100 + 1
    near = (F.col("low_ring_b") <= F.col("high_ring") + reach) & (F.col("low_ring") <= F.col("high_ring_b") + reach)
    for a, b in (("", "_b"), ("_b", "")):
        near &= F.lit(100) * F.col(f"high_n{a}") >= F.lit(percent) * F.col(f"low_n{b}")
    here, there = (F.struct(*[F.col(f"{c}{end}").alias(c) for c in CELL[1:]]) for end in ("", "_b"))
    pairs = one.join(other, "p").where(near & (here <= there) & ~(F.col("core") & F.col("core_b")))
    pair = F.xxhash64("p", here, there).alias("pair")
    second = pairs.select("p", *[F.col(f"{c}_b").alias(c) for c in CELL[1:]], pair)
    return pairs.select(*CELL, pair).unionAll(second).distinct()


def _joined_cells(percent: int):
    """The exact join of the sets of two cells: links that connect their components."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending")])
        x, c = table.column("x").to_numpy(), table.column("c").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, token, uses = np.unique(flat, return_inverse=True, return_counts=True)
        # Only shingles of several sets count; they are numbered anew.
        some = uses[token] > 1
        number = np.cumsum(uses > 1) - 1
        token, owner = number[token[some]], owner[some]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = max(1, MATRIX // max(1, len(sets)))
        for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            a, b = np.searchsorted(token, [low, low + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], token[a:b] - low] = 1
            common += part @ part.T
        near = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        near &= c[:, None] != c[None, :]
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.get(i, i) != i:
                i = root[i]
            return i

        links = []
        for i, j in np.argwhere(np.triu(near)).tolist():
            u, v = find(int(c[i])), find(int(c[j]))
            if u != v:
                root[max(u, v)] = min(u, v)
                links.append((x[i], x[j]))
        left, right = zip(*links, strict=True) if links else ((), ())
        return pa.table({"x": pa.array(left, pa.int64()), "y": pa.array(right, pa.int64())})

    return join


def link_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(x, y): links that connect every component of the similarity graph of ``sets``."""
    members = stage(prefixes(sets, percent, frequent_shingles(sets)), "region-members")
    pivots = members.groupBy("t").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("x"), "x"))["x"].alias("p"))
    pivots = stage(pivots.where("size > 1").select("t", "p"), "pivots")
    links = _home_links(members, pivots, sets, percent)
    regions = _open_regions(members, pivots, links)
    cells = _cells(regions, sets, percent)
    keyed = cells.join(_cell_pairs(cells, percent), CELL).select("pair", "x", "c")
    # A set's shingles travel once per pair of cells that it takes part in.
    held = keyed.distinct().join(sets.select(F.col("_d").alias("x"), "shingles"), "x")
    rest = held.groupBy("pair").applyInArrow(_joined_cells(percent), "x long, y long")
    return links.unionAll(stage(rest, "region-links"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    texts = docs.select(id_or_last().alias("_d"), text_bytes().alias("_bytes"))
    size = texts.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    rows = stage(profiles(texts, size / 6), "profiles")
    near = _near(rows, percent)
    nodes = stage(near.groupBy("key").agg(F.min("_d").alias("node"), F.first("n").alias("n")), "set-classes")
    alone = profiles(keep_ids(texts, nodes.withColumnRenamed("node", "_d"), "_d"), nodes.agg(F.sum("n")).first()[0] or 0)
    alone = stage(_near(alone, percent).join(nodes.select("key"), "key", "left_semi").select("_d", "n"), "near-sets")
    sets = stage(shingle_sets(keep_ids(texts, alone, "_d")).where("n > 0"), "shingle-sets")
    links = link_sets(sets, percent)
    # Copies are linked through their class; rows of one doc_id through that id.
    same = near.join(nodes, "key").where("_d <> node").select(F.col("_d").alias("x"), F.col("node").alias("y")).distinct()
    known = components(links.unionAll(same).select(F.col("x").alias("u"), F.col("y").alias("v")))
    known = stage(known, "components").select(F.col("node").alias("_d"), "component")
    out = rows.join(known, "_d", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "_d")).otherwise(F.col("_d"))
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("_d")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"))
