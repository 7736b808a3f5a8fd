"""What keeps the work of a large log in proportion: small tasks, slim shuffles, no sort before folders."""

from __future__ import annotations

import pytest
from conftest import Log, rows
from pyspark.sql import functions as F
from test_sources import flat, tiny_log

import procflow.plans.model as model_module
import procflow.sources.flat_log as flat_log_module
import procflow.sources.star as star_module
from procflow.plans.case_state import CaseState
from procflow.plans.model import build_model
from procflow.sources import staging
from procflow.sources.flat_log import check_log
from procflow.sources.star import build_star

READ = "spark.sql.files.maxPartitionBytes"


def spied_stage(monkeypatch, module):
    """What ``module`` stages from now on: (name, text of the optimized and executed plan)."""
    staged, original = [], staging.stage

    def spy(df, name, *more):
        execution = df._jdf.queryExecution()
        staged.append((name, execution.optimizedPlan().toString() + execution.executedPlan().toString()))
        return original(df, name, *more)

    monkeypatch.setattr(module, "stage", spy)
    return staged


@pytest.mark.parametrize("held, expected", [("128MB", 16 << 20), ("1m", 1 << 20), ("4194304b", 4 << 20)])
def test_staged_tables_are_written_in_small_tasks(spark, held, expected):
    before = spark.conf.get(READ)
    spark.conf.set(READ, held)
    try:
        with staging.small_tasks(spark):
            assert int(spark.conf.get(READ)) == expected
        assert spark.conf.get(READ) == held
    finally:
        spark.conf.set(READ, before)


def test_staging_splits_a_large_file(spark, tmp_path, monkeypatch):
    """A task reads about TASK_BYTES, so a file of many row groups is written as many files."""
    path = str(tmp_path / "numbers")
    spark.range(3_000_000).select(F.xxhash64("id").alias("h")).coalesce(1).write.option("parquet.block.size", 1 << 20).parquet(path)
    monkeypatch.setattr(staging, "TASK_BYTES", 1 << 20)
    staged = staging.stage(spark.read.parquet(path), "numbers")
    assert len(staged.inputFiles()) >= 16 and staged.count() == 3_000_000


def test_days_do_not_travel(spark, monkeypatch):
    staged = spied_stage(monkeypatch, model_module)
    build_model(Log(spark).case("A", PO="2018-07-01", CI="2018-07-09").star())
    text = dict(staged)["cases"].split("== Physical")[0]
    assert "GR_day" in text and "GR_day" not in text.partition("RepartitionByExpression")[2].partition("AdaptiveSparkPlan")[0]


def test_a_bucket_is_merged_and_written_by_several_tasks(spark):
    log, late = Log(spark), Log(spark)
    for i in range(400):
        log.case(f"c{i}", PO="2018-07-01")
        late.case(f"c{i * 2}", PO="2018-06-01", GR="2018-08-01")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        state = CaseState.create(spark, staging.new_folder(spark, "state"), buckets=1).add(log.star())
        state = state.add(late.star())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(state.cases().inputFiles()) > 1
    found = {r["Case_ID"]: (r["PO_ts"].month, r["GR_ts"] and r["GR_ts"].month) for r in state.milestones().collect()}
    assert len(found) == 600 == state.milestones().count()
    assert found["c1"] == (7, None) and found["c2"] == (6, 8) and found["c798"] == (6, 8)


def test_a_checked_log_is_written_without_a_sort(spark, tmp_path, monkeypatch):
    held, original = [], staging.small_tasks

    def spy(session, writers=0):
        held.append(writers)
        return original(session, writers)

    monkeypatch.setattr(flat_log_module, "small_tasks", spy, raising=False)
    log = spark.createDataFrame(
        [("A", "Pay", "01-07-2018 10:00"), (None, "Pay", "x"), ("A", None, "x"), ("A", "Pay", None), ("A", "Pay", "x")],
        "case_id string, activity string, timestamp string",
    )
    checked = check_log(log.coalesce(1), str(tmp_path / "checked"), "dd-MM-yyyy HH:mm")
    # As many folders as writers: one task needs no sort for all reasons.
    assert held == [5] and sorted(r["rows"] for r in checked.counts().collect()) == [1] * 5


def test_only_distinct_spellings_are_compared_by_collation(spark, monkeypatch):
    staged = spied_stage(monkeypatch, star_module)
    po = "Create Purchase Order Item"
    log = tiny_log(spark).unionAll(
        flat(
            spark,
            ("D", po.upper(), "2018-07-01", "VEE ", "COM", "g", "PUMPS", "direct"),
            ("E", f"{po} ", "2018-07-01", None, None, None, None, None),
            (None, "Pay", "2018-07-01", "Wee", None, None, None, None),
        )
    )
    star = build_star(log, collation="UTF8_LCASE_RTRIM")
    events = dict(staged)["fact-events"]
    assert "UTF8_LCASE_RTRIM" not in events and "collate" not in events.lower()
    assert star.fact_events.count() == log.count()
    keys = {(r["case_id"]): (r["vendor_key"], r["company_key"], r["spend_area_key"]) for r in star.fact_cases.collect()}
    assert len(keys) == 5 and keys["A"] == keys["D"] and keys["E"] == keys["C"] == (None, None, None)
    assert star.fact_events.where("activity_key is null").count() == 0
    assert sorted(r[0] for r in rows(star.dim_vendor.select("vendor"))) == ["VEE ", "Wee"]
