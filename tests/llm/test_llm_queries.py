"""The registered queries: DuckDB where SQL can express them, else plain versions, on whole tables."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain  # noqa: E402
from oracle_check import differences, duckdb_tables  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from procflow.llm.oracle import ORACLE  # noqa: E402
from procflow.llm.queries import NEAR_BITS, QUERIES, documents  # noqa: E402


@pytest.fixture(scope="module")
def con(checked):
    return duckdb_tables(checked)


@pytest.fixture(scope="module")
def rows(con):
    return con.execute("select doc_id, text from documents").fetchall()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_matches_duckdb(spark, checked, con, name):
    assert differences(QUERIES[name](spark, checked), con, ORACLE[name]) is None


def found(spark, folder, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def test_jaccard_join(spark, checked, rows):
    assert found(spark, checked, "op5_jaccard_join", "doc_id", "n_shingles", "component_id") == sorted(plain.jaccard(rows))


def test_substring_dedup(spark, checked, rows):
    wanted = sorted(plain.substring_dedup(rows))
    assert found(spark, checked, "op9_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == wanted


def test_decontaminate(spark, checked, con, rows):
    items = con.execute("select item_id, text from benchmark").fetchall()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert found(spark, checked, "op7_decontaminate", *names) == sorted(plain.decontaminate(rows, items))


@pytest.mark.parametrize("name", ["op2_quality", "op4_lattice_lm", "op6_simhash", "op8_token_files"])
def test_one_row_per_document(spark, checked, rows, name):
    assert [d for (d,) in found(spark, checked, name, "doc_id")] == sorted(d for d, _ in rows)


def test_search_within_the_radius(spark, checked):
    marks = {d: m for d, m in found(spark, checked, "op6_simhash", "doc_id", "fingerprint")}
    asked = dict(tuple(r) for r in QUERIES["op6_simhash"](spark, checked).select("doc_id", "n_within").collect())
    others = [int(m, 16) for m in set(marks.values())]
    for d, n in asked.items():
        mine = int(marks[d], 16)
        assert n == (None if d % 20 else sum(0 < (mine ^ m).bit_count() <= NEAR_BITS for m in others))


def test_packing_holds_all_ids(spark, checked):
    out = QUERIES["op10_packing"](spark, checked).collect()
    by_doc, by_sequence = {}, Counter()
    for r in out:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]] += r["length"]
    for (_, n), runs in by_doc.items():
        assert sum(length for _, length in runs) == n and len({a for a, _ in runs}) == len(runs)
    assert all(n <= 4096 and n & (n - 1) == 0 for n in by_sequence.values())


def test_pipeline(spark, small):
    """Each stage does to what it gets what its operator says; the plain versions judge the same."""
    docs = documents(spark, small).sparkSession.read.parquet(f"{small}/documents.parquet")
    kept = [docs]
    for name, work in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.stage(work(spark, kept[-1], small), name.replace(' ', '-')).inputFiles()[0].rsplit('/', 1)[0]}"
        kept.append(spark.read.parquet(path))
        if name != "packing":
            assert kept[-1].columns == docs.columns and [f.dataType for f in kept[-1].schema] == [f.dataType for f in docs.schema]
    texts = [{r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:-1]]
    quality = {r["doc_id"]: r["predicted"] for r in QUERIES["op2_quality"](spark, small).collect()}
    assert set(texts[1]) == {d for d, p in quality.items() if p} and len(texts[1]) < len(texts[0])
    judged = plain.line_dedup(list(texts[1].items()))
    held = {d: plain.sha(t.encode()) for d, t in texts[2].items()}
    assert held.items() <= {d: digest for d, _, _, digest in judged}.items()
    # What went lost lines, and had nothing else; nothing empty is left but what was empty before.
    lost_lines = {d for d, _, dropped, _ in judged if dropped}
    assert set(texts[1]) - set(texts[2]) <= lost_lines
    assert all(texts[2][d].strip() for d in set(texts[2]) & lost_lines)
    untouched = set(texts[1]) - lost_lines
    assert untouched <= set(texts[2])
    assert set(texts[3]) == {d for d, _, c in plain.jaccard(list(texts[2].items())) if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts[4]) == {r[0] for r in plain.decontaminate(list(texts[3].items()), items) if not r[-1]}
    packed = {}
    for r in kept[-1].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
        assert r["doc_tokens"] >= packed[r["doc_id"]]
    assert set(packed) == set(texts[4])


def test_pipeline_writes_the_ids_of_the_sequences(spark, small):
    """The packed pieces hold the ids themselves: with their places, those of the whole documents."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    out = corpus_pipeline.packing(spark, docs, small).collect()
    assert out and all(len(r["ids"]) == r["length"] for r in out)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in out)


def test_pipeline_query(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def test_whole_copies_do_not_reach_the_sequences(spark):
    """Copies lose all lines to the first of them and go; empty documents of the input stay."""
    body = "first line of the text\nand a second one of it"
    rows = [(1, body), (2, body), (3, f" {body.upper()}\n\n"), (4, "a line of its own"), (5, ""), (6, None), (7, f"{body}\nshort")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert out == {1: body, 4: "a line of its own", 5: "", 6: "", 7: "short"}


@pytest.mark.parametrize("name", ["documents", "benchmark"])
def test_pipeline_over_empty_tables(spark, small, tmp_path, name):
    for table in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{small}/{table}.parquet")
        (df.limit(0) if table == name else df).write.parquet(f"{tmp_path}/{table}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for work in ("line dedup", "n-gram Jaccard join", "benchmark decontamination"):
        docs = stages[work](spark, docs, str(tmp_path))
    assert (docs.count() == 0) == (name == "documents")
