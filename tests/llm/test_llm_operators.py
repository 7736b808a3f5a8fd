"""Operators against their plain versions, on hand-made and random tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from conftest import TESTDATA  # noqa: E402

import corpus_pipeline  # noqa: E402
from procflow.llm import common, decontaminate, jaccard_join, lattice, packing, quality, simhash, substring_dedup  # noqa: E402
from procflow.llm.common import keep_ids, new_folder, table  # noqa: E402
from procflow.llm.components import components  # noqa: E402
from procflow.llm.jaccard_join import jaccard_components  # noqa: E402
from procflow.llm.line_dedup import LineRuns, dedup_lines  # noqa: E402
from procflow.llm.queries import PACK_END, QUERIES  # noqa: E402
from procflow.llm.sharding import shard_documents, write_shards  # noqa: E402
from procflow.llm.substring_dedup import remove_repeats  # noqa: E402
from procflow.llm.token_files import read_tokens, token_checksums, write_tokens  # noqa: E402
from procflow.llm.tokens import WordTokens, encoder_path  # noqa: E402
from procflow.llm.words import pieces, with_texts  # noqa: E402

SCHEMA = "doc_id long, text string, row string, key int, `_d` string, lines string, spans int, n long"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy():
    """Nulls, empty and long texts, copies, near copies, repeated rows and ids, ties."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    passage = sentence(rng, 60)
    edited = base.split()
    edited[7], edited[90] = "changed", "Again"
    long = "\n".join(sentence(rng, 30) for _ in range(800))
    rows = [(7, base), (3, " ".join(edited)), (12, base), (12, base), (5, None), (6, ""), (8, " \n\t "), (9, "one two")]
    rows += [(10, "One  two"), (11, f"{sentence(rng, 30)} {passage} {sentence(rng, 20)}"), (2, f"{passage} {sentence(rng, 90)}")]
    rows += [(20, long), (21, long + " more"), (None, base.upper()), (None, "A line without id\nshared line here"), (22, "Shared Line Here \n short\nx")]
    rows += [(23, "\tshared line here\r\nshared line here"), (24, "Élan vital été\nelan vital ete"), (25, "ÉLAN vital été"), (12, "another text of id twelve")]
    rows += [(30 + i, sentence(rng, 40)) for i in range(20)]
    return rows


def frame(spark, rows):
    full = [(d, t, "row", 1, "x", None, 2, 3) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Line dedup


def line_rows(df):
    return tuples(df, "row.doc_id", F.size("lines"), F.size("gone"), F.sha2("kept", 256))


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, batches):
    rows = messy()
    assert order(line_rows(dedup_lines(frame(spark, rows), batches))) == order(plain.line_dedup(rows))


def test_line_dedup_of_nothing(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_compacted_and_reopened(spark):
    rows = [(i, f"line number {i % 7} of all\nonly in document {i}") for i in range(60)]
    folder, found = new_folder(spark, "runs"), []
    runs = LineRuns(spark, folder, fanout=2, buckets=3)
    for low in range(0, 60, 12):
        found += line_rows(runs.add(frame(spark, rows[low : low + 12])))
        runs = LineRuns.reopen(spark, folder, fanout=2)
        assert all(len(level) < 2 for level in runs.levels)
    assert order(found) == order(plain.line_dedup(rows))
    held = [r["key"] for run in runs.runs() for r in runs.run(run).collect()]
    assert len(held) == len(set(map(bytes, held))) == 7 + 60


def test_a_batch_that_broke_off_drops_nothing_later(spark, monkeypatch):
    folder = new_folder(spark, "runs")
    LineRuns(spark, folder, buckets=2).add(frame(spark, [(1, "a line of the first batch")]))

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(LineRuns, "_commit", lost)
        with pytest.raises(RuntimeError):
            LineRuns.reopen(spark, folder).ingest(frame(spark, [(5, "a line of the lost batch")]))
    runs = LineRuns.reopen(spark, folder)
    runs.add(frame(spark, [(8, "something unrelated here")]))
    out = runs.add(frame(spark, [(10, "a line of the lost batch")])).collect()
    assert [(r["gone"], r["kept"]) for r in out] == [([], "a line of the lost batch")]


def test_folders_of_one_ending_are_apart(spark):
    end = "x" * 60
    a, b = (LineRuns(spark, f"{new_folder(spark, name)}/{end}", buckets=2) for name in "ab")
    a.add(frame(spark, [(1, "a line of corpus a")]))
    b.add(frame(spark, [(1, "a line of corpus b")]))
    assert [r.run(r.runs()[0]).count() for r in (a, b)] == [1, 1]
    assert [r["gone"] for r in b.add(frame(spark, [(2, "a line of corpus a")])).collect()] == [[]]


def test_a_batch_reads_runs_without_shuffling_them(spark):
    runs = LineRuns(spark, new_folder(spark, "runs"), buckets=8)
    runs.add(frame(spark, [(1, "some long line\nand another one")]))
    fresh = frame(spark, [(2, "some long line")]).select(F.unhex(F.md5("text")).alias("key")).groupBy("key").count()
    plan = fresh.join(runs.run(runs.runs()[0]).select("key").hint("merge"), "key", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = text[: text.index("Bucketed: true")] if "Bucketed: true" in text else text
    assert "SortMergeJoin" in text and scan.count("Exchange hashpartitioning") == 1


# Sharding


def test_sharding(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(7, "y" * 40)] * 60 + [(None, None), (600, "z" * 5000)]
    made = shard_documents(frame(spark, rows), 300)
    out = made.rows.collect()
    assert order([(r["key"], r["n_bytes"]) for r in out]) == order([(d, len(t or "")) for d, t in rows])
    size, count = {}, {}
    for r in out:
        assert len(r["shard"]) == r["depth"]
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
        count[r["shard"]] = count.get(r["shard"], 0) + 1
    assert all(size[s] <= 300 or count[s] == 1 for s in size)
    names = sorted(size)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))
    # A bucket splits only if it has to: with its sibling it would exceed the limit.
    for s in names:
        parent = [t for t in names if s and t.startswith(s[:-1])]
        assert not s or sum(size[t] for t in parent) > 300
    assert {(r["shard"], r["n_bytes"], r["n_rows"]) for r in made.shards.collect()} == {(s, size[s], count[s]) for s in names}


def test_directory_points_every_prefix_to_its_shard(spark):
    made = shard_documents(frame(spark, [(i, "x" * 20) for i in range(100)]), 300)
    slots = {r["slot"]: r["shard"] for r in made.directory().collect()}
    deepest = max(len(s) for s in slots)
    assert len(slots) == 2**deepest and all(k.startswith(v) and len(k) == deepest for k, v in slots.items())


def test_sharding_of_little(spark):
    assert shard_documents(frame(spark, []), 10).rows.count() == 0
    assert [r["shard"] for r in shard_documents(frame(spark, [(1, "abc")]), 10).rows.collect()] == [""]


def test_shards_read_back_from_their_files(spark):
    """All rows and columns, one file a shard, no file over the limit but for a single row."""
    rows = messy() + [(7, "y" * 40)] * 60 + [(None, "z" * 90)] * 80 + [(None, None)] * 3
    docs = frame(spark, rows).withColumn("Shard", F.lit("taken")).withColumn("doc", F.lit(1)).withColumn("bits", F.lit("b"))
    made = write_shards(docs, 2000)
    held = made.read()
    assert made.column == "_shard" and held.columns == [*docs.columns, "_shard"]
    assert order(tuples(held, *docs.columns)) == order(tuples(docs, *docs.columns))
    size = {}
    for shard, text, file in held.select("_shard", "text", F.input_file_name()).collect():
        n, total, files = size.get(shard, (0, 0, set()))
        size[shard] = (n + 1, total + len((text or "").encode()), files | {file})
    assert len(size) > 4
    assert all(len(files) == 1 and (total <= 2000 or n == 1) for n, total, files in size.values())
    listed = {r["shard"]: (r["n_rows"], r["n_bytes"]) for r in made.sharding().shards.collect()}
    assert listed == {s: (n, total) for s, (n, total, _) in size.items()}
    one = max(size)
    assert made.read(one).count() == size[one][0]


def test_shard_files_of_little(spark):
    empty = write_shards(frame(spark, []), 10)
    assert empty.read().count() == 0 and empty.sharding().directory().count() == 0
    (row,) = write_shards(frame(spark, [(None, None)]), 10).read().collect()
    assert (row["doc_id"], row["text"], row["shard"]) == (None, None, "")


# N-gram Jaccard join


def test_jaccard_join(spark):
    rows = messy()
    found = tuples(jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert order(found) == order(plain.jaccard(rows))


@pytest.mark.parametrize(("seed", "cell"), [(1, 500), (2, 500), (3, 4), (4, 2)])
def test_jaccard_join_of_edited_copies(spark, monkeypatch, seed, cell):
    """Chains of copies, some just inside and some just outside the threshold; also with tiny cells."""
    monkeypatch.setattr(jaccard_join, "CELL_SETS", cell)
    rng = random.Random(seed)
    rows = []
    for _ in range(6):
        text = sentence(rng, rng.randrange(6, 60)).split()
        for _ in range(25):
            text = list(text if rng.random() < 0.5 or not rows else rng.choice(rows)[1].split())
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"n{rng.randrange(9)}"
            rows.append((len(rows), " ".join(text)))
    found = tuples(jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert order(found) == order(plain.jaccard(rows))


@pytest.mark.parametrize(("percent", "frequent", "cell"), [(80, 16, 3), (80, 0, 3), (50, 16, 4), (60, 1 << 19, 2)])
def test_jaccard_join_of_sizes_and_common_lines(spark, monkeypatch, percent, frequent, cell):
    """Copies cut to many lengths below a line that all hold; tiny cells and few known frequent shingles."""
    monkeypatch.setattr(jaccard_join, "CELL_SETS", cell)
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    rng = random.Random(percent + cell)
    line, rows = sentence(rng, 30), []
    for _ in range(4):
        text = sentence(rng, 60).split()
        for _ in range(20):
            kept = list(text[: rng.randrange(12, 60)])
            for _ in range(rng.randrange(2)):
                kept[rng.randrange(len(kept))] = f"n{rng.randrange(5)}"
            rows.append((len(rows), f"{line}\n{' '.join(kept)}"))
    found = tuples(jaccard_components(frame(spark, rows), percent), "doc_id", "n_shingles", "component_id")
    assert order(found) == order(plain.jaccard(rows, percent))


def test_common_line_makes_no_region(spark, monkeypatch):
    """Sets with enough other shingles are in no region of a line that all of them hold."""
    staged = {}

    def kept(df, name, base=jaccard_join.stage):
        staged[name] = base(df, name)
        return staged[name]

    monkeypatch.setattr(jaccard_join, "stage", kept)
    rng = random.Random(5)
    line = sentence(rng, 30)
    texts = [f"{line} " + " ".join(f"d{i}w{j}" for j in range(30)) for i in range(60)]
    texts += [t + " more" for t in texts[:3]]
    docs = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_d long, _bytes binary")
    links = jaccard_join.link_sets(jaccard_join.shingle_sets(docs))
    assert sorted(sorted(r) for r in links.distinct().collect()) == [[0, 60], [1, 61], [2, 62]]
    assert staged["pivots"].join(staged["region-members"], "t").select("x").distinct().count() == 6
    assert staged["open-regions"].count() == 0


def test_cells_pair_with_like_sizes_only(spark, monkeypatch):
    """Sets of a large region travel to cells of sizes in reach, not to all cells of their ring."""
    monkeypatch.setattr(jaccard_join, "CELL_SETS", 10)
    own = lambda x, n: [9, *range(1000 * x, 1000 * x + n - 1)]
    rows = [(x, own(x, 8 << x % 5)) for x in range(1, 201)]
    sets = [(x, len(s), np.sort(np.array(s, np.uint64)).tobytes()) for x, s in rows]
    sets = spark.createDataFrame(sets, "_d long, n long, shingles binary")
    regions = sets.selectExpr("1L as p", "_d as x", "n", "_d as c")
    cells = jaccard_join._cells(regions, sets, 80)
    pairs = jaccard_join._cell_pairs(cells, 80)
    assert cells.select("x").distinct().count() == cells.count() == 200
    held = cells.join(pairs, jaccard_join.CELL)
    # Five sizes, each twice the one before, of 40 sets: about five cells for each set, of 21 in all.
    assert held.count() <= 200 * 7
    spread = held.groupBy("pair").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    assert spread.where("low < high").count() == 0


def test_packed_numbers():
    for kind, values in (("<u4", [0, 0, 7, 2**32 - 1]), ("<u2", [65_535, 0, 300]), ("<u4", [5]), ("<u2", [])):
        assert jaccard_join.unpacked(jaccard_join.packed(np.array(values, kind)), kind).tolist() == values


def test_staged_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(common.FREE_SHUFFLES, None)
    assert common.stage(spark.range(1000).groupBy(F.col("id") % 7).count(), "sevenths").count() == 7
    end = time.monotonic() + 20
    while len(shuffles() - before) > 1 and time.monotonic() < end:  # the count above may leave its own
        time.sleep(0.2)
    assert len({name.split("_")[1] for name in shuffles() - before}) <= 1
    assert spark.conf.get(common.FREE_SHUFFLES, None) == setting


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert tuples(jaccard_components(frame(spark, [(4, None)])), "*") == [(4, 0, 4)]


def test_pipeline_keeps_one_row_of_each_component(spark):
    """Rows are judged one by one: shared or missing doc_ids neither join nor save them."""
    rng = random.Random(12)
    five, nine, other, copied, twice = (sentence(rng, 60) for _ in range(5))
    rows = [(5, five), (9, nine), (None, five), (None, nine), (None, other), (None, copied), (None, copied), (12, twice), (12, twice)]
    rows += [(30, sentence(rng, 60)), (30, five), (40, None), (None, "")]
    kept = tuples(corpus_pipeline.near_duplicates(spark, frame(spark, rows), ""), "doc_id", "text")
    assert order(kept) == order([(5, five), (9, nine), (None, other), (None, copied), (12, twice), rows[9], (40, None), (None, "")])
    kept = tuples(corpus_pipeline.near_duplicates(spark, frame(spark, messy()), ""), "doc_id", "text")
    # Numbered rows: each component of the plain join keeps exactly one.
    numbered = sorted(messy(), key=lambda r: (r[0] is None, r[0] or 0))
    groups = plain.jaccard([(i, t) for i, (_, t) in enumerate(numbered)])
    assert len(kept) == len({c for _, _, c in groups}) and (None, "A line without id\nshared line here") in kept
    assert sorted(str(d) for d, _ in kept) == sorted(str(numbered[c][0]) for c in {c for _, _, c in groups})


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)] + [(500, i) for i in range(501, 530)]
    found = dict(tuples(components(spark.createDataFrame(links, "u long, v long")), "node", "component"))
    assert found == {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)} | {i: 500 for i in range(500, 530)}


def test_staged_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda s: str(tmp_path))
    assert common.stage(spark.range(5), "five").count() == 5 and list(tmp_path.rglob("part-*"))
    common.remove_staged(spark)
    assert not list(tmp_path.rglob("part-*"))


def test_keep_ids_by_either_way(spark):
    df, ids = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([(3,), (5,), (3,)], "k long")
    assert sorted(tuples(keep_ids(df, ids, "k"), "k")) == sorted(tuples(keep_ids(df, ids, "k", most=0), "k")) == [(3,), (5,)]


# SimHash


def test_fingerprints(spark):
    rows = [(d, t) for d, t in messy() if d is not None and d != 12]
    found = {r["doc_id"]: r for r in simhash.fingerprints_with_neighbours(frame(spark, rows)).collect()}
    ids, text = sorted(d for d, _ in rows), {d: t or "" for d, t in rows}
    assert sorted(found) == ids
    for i, d in enumerate(ids):
        t, other, r = text[d], text[ids[i - 1]], found[d]
        n = len(t) // 2
        changed = t[: len(t) - n] + other[:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        near = 1 - (int(r["fingerprint"], 16) ^ int(found[ids[i - 1]]["fingerprint"], 16)).bit_count() / 128
        assert r["near_next"] == near and 0 <= r["near_edited"] <= 1
    assert found[5]["fingerprint"] == found[6]["fingerprint"] == found[8]["fingerprint"] == "0" * 32


def test_fingerprints_of_little(spark):
    assert simhash.fingerprints_with_neighbours(frame(spark, [])).count() == 0
    one = simhash.fingerprints_with_neighbours(frame(spark, [(1, "just one text here")])).collect()
    assert [(r["doc_id"], r["near_next"]) for r in one] == [(1, 1.0)]
    twins = simhash.fingerprints_with_neighbours(frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x")])).collect()
    assert sorted((r["doc_id"] or 0) for r in twins) == [0, 1, 1]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 8), (2, 4), (5, 8)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    rng = random.Random(radius)
    marks = []
    for _ in range(12):
        m = rng.getrandbits(128)
        marks += [m] + [m ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 8))) for _ in range(6)]
    texts = [f"{m:032x}" for m in marks]
    df = spark.createDataFrame([(t,) for t in texts + texts[:5] + [None]], "fingerprint string")
    wanted = {(a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a, b in itertools.combinations(sorted(set(texts)), 2)}
    wanted = {x for x in wanted if x[2] <= radius}
    found = tuples(simhash.within_radius(df, radius, blocks), "query", "fingerprint", "distance")
    assert wanted and sorted(found) == sorted(wanted)
    asked = simhash.within_radius(df, radius, blocks, df.where(F.col("fingerprint") == texts[0]))
    assert {r["fingerprint"] for r in asked.collect()} == {b if a == texts[0] else a for a, b, _ in wanted if texts[0] in (a, b)}


@pytest.mark.parametrize(("radius", "blocks", "chunk"), [(23, 6, 1 << 20), (23, 6, 16), (20, 8, 16), (2, 8, 16)])
def test_near_classes_hold_all_rows_within_the_radius(spark, monkeypatch, radius, blocks, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "PART", 8)
    rng = random.Random(radius)
    marks = []
    for _ in range(12):
        m = rng.getrandbits(128)
        marks += [m, m] + [m ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(1, 30))) for _ in range(6)]
    rows = [(i, f"{m:032x}") for i, m in enumerate(marks)] + [(None, f"{marks[0]:032x}")]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    found = simhash.near_classes(df, F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)), radius, blocks)
    found = df.join(found, F.col("query") == F.col("fingerprint"))
    near = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    asked = {m for d, m in rows if d is not None and d % 4 == 0}
    wanted = {(d, e, near(a, b)) for d, a in rows for e, b in rows if a in asked and d != e and near(a, b) <= radius}
    assert {tuple(r) for r in simhash.partner_ids(df.join(found.select("query", "partners").distinct(), F.col("query") == F.col("fingerprint"), "left").drop("query")).collect()} == wanted
    for r in found.collect():
        inside = [b for _, b in rows if near(r["fingerprint"], b) <= radius]
        assert (r["n_within"], r["n_partners"]) == (len(set(inside)) - 1, len(inside) - 1)
        assert [p["distance"] for p in r["partners"]] == sorted(near(r["fingerprint"], b) for b in set(inside))
        assert all(p["n_docs"] == inside.count(p["fingerprint"]) for p in r["partners"])


def test_near_copies_are_partners(spark, tmp_path):
    """An exact copy, and one with a changed word in 200 (Jaccard similarity over 0.8), are found by doc_id."""
    rng = random.Random(8)
    base = sentence(rng, 200).split()
    edited = [*base[:90], "changed", *base[91:]]
    rows = [(20, " ".join(base)), (21, " ".join(edited)), (22, " ".join(base)), (23, sentence(rng, 200))]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op6_simhash"](spark, str(tmp_path))
    assert [(r["n_within"], r["n_partners"]) for r in out.where("doc_id = 20").collect()] == [(1, 2)]
    found = dict(tuples(simhash.partner_ids(out), "partner_id", "distance"))
    assert set(found) == {21, 22} and found[22] == 0 < found[21]


# Benchmark decontamination

ITEMS = [(1, "The quick, brown fox jumps over the lazy dog and then some"), (2, "short item"), (3, None), (None, "no id of item")]
ITEMS += [(4, "short item"), (5, "..."), (6, "naïve Café 42")]


@pytest.mark.parametrize("bits", [24, 16])
def test_decontamination(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    rows = messy() + [(70, "QUICK brown fox jumps over the lazy dog; and then some. short"), (71, "a Short item here short-item"), (72, "naïve café 42")]
    rows += [(73, "quick brown fox jumps over the lazy dog and"), (74, "the " * 50 + "quick brown fox jumps over the lazy dog and then")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.find_benchmark(frame(spark, rows), items)
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    found = tuples(out, "row.doc_id", "n_words", n_hit, F.size("items"), digest, F.size("spans") > 0)
    assert order(found) == order(plain.decontaminate(rows, ITEMS))


def test_filters_hold_what_they_were_built_of(spark):
    values = [b"", b"a", "é ß".encode(), b"x" * 300, *(f"w{i}".encode() for i in range(3000))]
    held = decontaminate.Filter.of(spark.createDataFrame([(bytearray(v),) for v in values], "v binary"), "v")
    assert all(v in held for v in values) and sum(f"other {i}".encode() in held for i in range(3000)) < 30


def test_prefix_of_a_window_is_its_rarest_word(spark):
    windows = decontaminate.benchmark_windows(spark.createDataFrame([(1, "the rare the common"), (2, "common new common")], "item_id long, text string"))
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in ((b"the", 9), (b"rare", 2), (b"common", 5))], "word binary, n long")
    assert sorted(tuples(decontaminate.prefixes(windows, counts), F.col("word").cast("string"), "at", "size")) == [("new", 1, 3), ("rare", 1, 4)]


def test_decontamination_of_random_texts(spark, monkeypatch):
    """Few words, so that windows overlap and their rarest words are frequent; filters that let most through."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 15)
    monkeypatch.setattr(decontaminate, "COUNTED", 2)
    rng = random.Random(21)
    items = [(i, sentence(rng, rng.randrange(1, 9), 3)) for i in range(12)] + [(1, "w0 w1 w2 w0")]
    rows = [(i % 30, sentence(rng, rng.randrange(0, 40), 4)) for i in range(40)]
    out = decontaminate.find_benchmark(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 4)
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["first"])
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    found = tuples(out, "row.doc_id", "n_words", n_hit, F.size("items"), digest, F.size("spans") > 0)
    assert order(found) == order(plain.decontaminate(rows, items, 4))


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in decontaminate.find_benchmark(frame(spark, [(1, "a b")]), none).collect()] == [[]]
    assert decontaminate.find_benchmark(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# Substring dedup


def test_substring_dedup(spark):
    rows = messy()
    found = tuples(remove_repeats(frame(spark, rows)), "row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert order(found) == order(plain.substring_dedup(rows))


@pytest.mark.parametrize(("window", "start", "seed"), [(4, 13, 1), (7, 1, 2), (10, 2, 3), (23, 3, 4)])
def test_substring_dedup_with_many_repeats(spark, window, start, seed):
    rng = random.Random(seed)
    parts = [sentence(rng, rng.randrange(3, 15), 3) for _ in range(8)]
    rows = [(i, "  ".join(rng.choices(parts, k=rng.randrange(1, 6)))) for i in range(60)]
    out = remove_repeats(frame(spark, rows), window, start=start)
    assert order(tuples(out, "row.doc_id", "n_words", "n_removed", "kept_sha256")) == order(plain.substring_dedup(rows, window))
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in out.collect())


def test_levels_of_substring_dedup(spark, monkeypatch):
    """Lengths double up to a window; each level reads the rows that the one before left, and the loop ends without any."""
    assert [substring_dedup.levels(w) for w in (1, 13, 50, 200)] == [[1], [7], [13, 25], [13, 25, 50, 100]]
    assert substring_dedup.levels(50, 3) == [2, 4, 7, 13, 25]
    rng, seen, plain_anchors = random.Random(9), [], substring_dedup.anchors
    monkeypatch.setattr(substring_dedup, "anchors", lambda rows, size, *a: seen.append((size, rows.count())) or plain_anchors(rows, size, *a))
    long, short = sentence(rng, 60), sentence(rng, 20)
    rows = [(1, f"{sentence(rng, 9)} {long}"), (2, f"{sentence(rng, 7)} {long}"), (3, f"{short} {sentence(rng, 60)}"), (4, f"{sentence(rng, 70)} {short}"), (5, sentence(rng, 90))]
    out = tuples(remove_repeats(frame(spark, rows)), "row.doc_id", "n_words", "n_removed", "kept_sha256")
    assert order(out) == order(plain.substring_dedup(rows)) and seen[0] == (13, 5) and seen[1][0] == 25 and 2 <= seen[1][1] <= 4
    seen.clear()
    assert remove_repeats(frame(spark, rows[4:])).count() == 1 and seen == [(13, 1)]


def test_substring_dedup_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


# Tokens

TEXTS = st.text(st.sampled_from(list("abcDEF 12\t\n.!'é́ ß中<|>Σς")) | st.characters(exclude_categories=["Cs"]), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return WordTokens(encoder_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_of_words_are_the_ids_of_texts(texts):
    words = test_ids_of_words_are_the_ids_of_texts.__dict__.setdefault("words", WordTokens(encoder_path()))
    ids, counts = words.encode([t.encode() for t in texts])
    whole = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in whole for i in w] and counts.tolist() == [len(w) for w in whole]


def test_ids_of_slices(encoder):
    texts = pa.array([t.encode() for t in ("Ünd so", "Weiter ÜÄ", "bis ZUM", "", "Ende é")], pa.binary())
    for a, b in ((0, 5), (1, 4), (2, 5), (3, 3)):
        whole = [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts[a:b].to_pylist()]
        ids, counts = encoder.encode(texts[a:b])
        assert ids.tolist() == [i for w in whole for i in w] and counts.tolist() == [len(w) for w in whole]


def test_special_names_in_texts(encoder):
    text = "a <|endoftext|> b<|startoftext|>c"
    assert encoder.encode([text.encode()])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_cover_all_texts():
    found = list(pieces(np.array([50, 1, 15, 10, 0]), 20))
    assert [i for p in found for i in range(p.start, p.stop)] == [0, 1, 2, 3, 4] and len(found) == 3
    assert not list(pieces(np.empty(0, int)))


def test_end_ids(encoder):
    for texts in ([], [b""], [b"a b", b"", b"c"], [b"", b"<|end x"]):
        ids, counts = encoder.encode(texts, 7)
        wanted = [[*encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids, 7] for t in texts]
        assert ids.tolist() == [i for w in wanted for i in w] and counts.tolist() == [len(w) for w in wanted]


def test_forgotten_words_are_learned_again(encoder):
    few = WordTokens(encoder_path(), most=4)
    for _ in range(3):
        for text in (b"a bc def ghij kl", b"mno pq a a r", b"s tu v w xyz"):
            assert few.encode([text])[0].tolist() == encoder.encode([text])[0].tolist()


def test_token_files(spark, encoder):
    rows = messy()
    folder = new_folder(spark, "tokens")
    write_tokens(frame(spark, rows), folder, encoder_path(), 1)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    start, wanted = 0, []
    for d, t in ordered:
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        wanted.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = tuples(token_checksums(read_tokens(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(found, key=lambda r: r[1]) == wanted
    some = tuples(token_checksums(read_tokens(spark, folder, 9, 12)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(some, key=lambda r: r[1]) == [w for w in wanted if w[0] is not None and 9 <= w[0] <= 12]
    plan = read_tokens(spark, folder, 9, 12).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan and "GreaterThanOrEqual(doc_id,9)" in plan


def test_token_files_of_nothing(spark):
    folder = new_folder(spark, "tokens")
    write_tokens(frame(spark, []), folder, encoder_path(), 1)
    assert read_tokens(spark, folder).count() == 0


# Packing


def check_packing(rows, texts, tiers=packing.TIERS):
    """Every id lies in one piece, sequences have no gaps, and all but the last lengths are tiers."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    covered = 0
    for (_, n), runs in by_doc.items():
        covered += sum(length for _, length in runs)
        assert max(a + b for a, b in runs) == n
    assert covered == sum(texts)
    for runs in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(runs):
            assert offset == at and length > 0
            at += length
        assert at & (at - 1) == 0 and at <= tiers[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packer(lengths):
    packer = packing.Packer(0, (8, 16, 32, 64), 128, False)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype=np.uint32))
        if i % 7 == 6:
            packer.pack()
    packer.close()
    rows = [dict(zip(packing.FIELDS, r, strict=True)) for r in packer.rows]
    check_packing(rows, lengths, (8, 16, 32, 64))
    for i, n in enumerate(lengths):
        mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        at = 0
        for start, length, crc in mine:
            assert start == at and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes())
            at += length
        assert at == n
    # Steps hold one tier and at most one budget of tokens.
    steps = {}
    for r in rows:
        steps.setdefault(r["step"], []).append(r)
    assert all(len({r["tier"] for r in s}) == 1 and sum(r["length"] for r in s) <= 128 + 64 for s in steps.values())


def test_packing(spark, encoder):
    rows = messy()
    out = packing.pack_documents(frame(spark, rows), encoder_path(), PACK_END)
    lengths = [len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    found = out.collect()
    assert sum(r["length"] for r in found) == sum(lengths)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in found)
    long = sorted((r["start"], r["ids"]) for r in found if r["doc_id"] == 20)
    ids = encoder.tokenizer.encode(dict(rows)[20], add_special_tokens=False).ids
    assert [i for _, part in long for i in part] == ids + [PACK_END]
    assert packing.pack_documents(frame(spark, []), encoder_path(), PACK_END).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack_documents(frame(spark, rows), encoder_path(), PACK_END, tiers=(100, 200))


# Language model


def test_lattice_sums_all_segmentations():
    weight = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "ab": 0.2, "b": 0.15, "▁ab": 0.05}
    byte = [math.log(0.2 / 256)] * 256
    made = lattice.Lattice({p: math.log(x) for p, x in weight.items()}, byte)

    def total(text):
        if not text:
            return 1.0
        ways = [(1, math.prod([0.2 / 256] * len(text[0].encode())))] + [(len(p), x) for p, x in weight.items() if text.startswith(p)]
        return sum(x * total(text[n:]) for n, x in ways)

    for word in ("a", "ab", "abab", "b", "é", "ba" * 4):
        assert math.isclose(made.log_probability(word), math.log(total("▁" + word)), rel_tol=1e-9)
    assert made.log_probability("a" * 5000) < -1000


def test_word_probabilities_sum_to_one():
    """Over counted words, the end, and the mass of the lattice."""
    counts = {b"a": 5, b"b": 1, b"c": 1, b"d": 2, b"": 3}
    byte = [math.log(1 / 256)] * 256
    made = lattice.Model(lattice.Lattice({}, byte), 12, 5, 3, 2, 1)
    spelled = {w: math.exp(made.lattice.log_probability(w.decode())) for w in counts if w}
    total = sum(10 ** made.log10(w, c) for w, c in counts.items())
    assert math.isclose(total - made.free * sum(spelled.values()) + made.free, 1)


def test_lattice_scores(spark):
    rows = messy()
    out = lattice.lattice_scores(frame(spark, rows), lattice.piece_path(), frequent=20).collect()
    train = [w for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in [*plain.words(plain.low(t)), None]]
    counts = {w: train.count(w) for w in set(train)}
    n, types, wanted = len(train), len(counts), []
    for d, t in rows:
        w = [*plain.words(plain.low(t)), None]
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + types + 1)) for x in w)
        wanted.append((d, len(w), sum(x in counts for x in w), n, round(base, 6)))
    assert order((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == order(wanted)
    assert all(r["score"] < 0 for r in out)
    # The number of frequent words changes how counts travel, not the scores.
    again = lattice.lattice_scores(frame(spark, rows), lattice.piece_path(), frequent=100_000).collect()
    assert order((r["doc_id"], round(r["score"], 6)) for r in out) == order((r["doc_id"], round(r["score"], 6)) for r in again)


def test_lattice_scores_of_little(spark):
    assert lattice.lattice_scores(frame(spark, []), lattice.piece_path()).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = lattice.lattice_scores(frame(spark, [(held, "some words")]), lattice.piece_path()).collect()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] < -3


# Quality classifier


def test_descriptions_do_not_depend_on_the_batch():
    texts = [(t or "").encode() for _, t in messy()]
    together, counts = quality.describe(texts)
    alone = [quality.describe([t]) for t in texts]
    assert counts.tolist() == [int(c[0]) for _, c in alone]
    assert np.allclose(together, np.concatenate([x for x, _ in alone]))
    assert all(c == max(1, -(-len(t.split()) // quality.PASSAGE_WORDS)) for t, c in zip(texts, counts, strict=True))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    counts, y = np.array([2, 1, 3]), np.array([1.0, 0.0, 1.0])
    x, weight = rng.normal(size=(6, quality.FEATURES)), np.array([1.0, 2.0, 0.5])
    shape = {"E": (quality.FEATURES, 4), "e": (4,), "V": (4, 4), "U": (4, 4), "w": (4,), "c": (4,), "b": (1,)}
    made = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), {k: rng.normal(0, 0.4, s) for k, s in shape.items()})

    def loss():
        p = made.forward(x, counts)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    slopes = made.gradients(x, counts, y, weight)
    for k, w in made.weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        assert math.isclose(slopes[k][at], (up - loss()) / 2e-5, rel_tol=1e-3, abs_tol=1e-6)
        w[at] += 1e-5


def test_held_out_accuracy(spark):
    folder = str(TESTDATA / "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = quality.score_texts(docs, quality.fit(docs, labels), ["doc_id"]).select("row.doc_id", "score")
    rows = scored.join(labels, "doc_id").where(quality.held_out(4)).collect()
    right = sum((r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in rows)
    assert len(rows) > 50 and right >= 0.95 * len(rows)


def test_quality_without_labels_and_with_odd_rows(spark):
    docs = frame(spark, messy())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_texts(docs, quality.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (9, 1, None), (None, 1, 0), (8, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_texts(docs, quality.fit(docs, odd))
    assert out.count() == len(messy()) and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.score_texts(frame(spark, []), quality.fit(docs, odd)).count() == 0


def test_a_carried_text_reaches_the_worker_once(spark):
    texts = ["A b c.", None, "", "é x\ny", "a b c d e f g h i j k"]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    model = quality.fit(docs, spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, quality int"))
    assert model is not None
    items = spark.createDataFrame([("i", texts[4])], "item_id string, text string")
    for judge, columns in (
        (lambda d, c: quality.score_texts(d, model, c), ["score"]),
        (lambda d, c: decontaminate.find_benchmark(d, items, carry=c), ["n_words", "spans", "items"]),
    ):
        alone, whole = judge(docs, ["doc_id"]), judge(docs, None)
        plan = quality.score_texts(docs, model)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "_bytes" not in plan
        assert sorted(alone.select("row.doc_id", *columns).collect()) == sorted(whole.select("row.doc_id", *columns).collect())
        assert sorted(whole.select("row.doc_id", "row.text").collect(), key=lambda r: r[0]) == list(enumerate(texts))


def test_texts_of_sliced_rows():
    rows = pa.array([{"text": t, "n": 1} for t in ("a", None, "c", "d")])
    batch = pa.RecordBatch.from_arrays([rows], ["row"]).slice(1, 2)
    assert next(with_texts(iter([batch]), "text")).column("_bytes").to_pylist() == [b"", b"c"]
