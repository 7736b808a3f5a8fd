from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from procflow.constants import Step
from procflow.operators.milestones import (
    analysis_start,
    as_of_date,
    core_milestones,
    milestones,
)
from procflow.sources.order_lines import order_line_star


def test_first_order_and_last_of_the_rest(log):
    log.case(
        "A",
        PO=["2018-03-02", "2018-03-01"],
        GR=["2018-03-05", "2018-03-07"],
        IR=["2018-03-09", "2018-03-08"],
        CI=["2018-03-11", "2018-03-10"],
    )
    star = log.star()
    (row,) = rows(milestones(star.fact_events, star.dim_activity))
    assert row == ("A", ts("2018-03-01"), ts("2018-03-07"), ts("2018-03-09"), ts("2018-03-11"))


def test_cases_without_order_are_left_out_unless_wanted(log):
    log.case("A", PO="2018-03-01").case("B", GR="2018-03-01")
    star = log.star()
    assert [r[0] for r in rows(milestones(star.fact_events, star.dim_activity))] == ["A"]
    every = milestones(star.fact_events, star.dim_activity, required=())
    assert sorted(r[0] for r in rows(every)) == ["A", "B"]
    complete = milestones(star.fact_events, star.dim_activity, required=("PO", "CI"))
    assert rows(complete) == []


def test_other_activities_and_events_without_case_do_not_count(log):
    log.case("A", PO="2018-03-01")
    log.events += [("A", 9, ts("2017-01-01")), (None, 1, ts("2016-01-01"))]
    star = log.star()
    assert rows(milestones(star.fact_events, star.dim_activity)) == [
        ("A", ts("2018-03-01"), None, None, None)
    ]
    assert rows(core_milestones(star.fact_events, star.dim_activity)) == [
        ("A", 1, ts("2018-03-01"))
    ]


def test_own_steps(log):
    log.case("A", PO=["2018-03-01", "2018-03-04"], CI=["2018-03-05", "2018-03-09"])
    star = log.star()
    steps = (
        Step("Last_Order", "Create Purchase Order Item", "last"),
        Step("First_Clear", "Clear Invoice", "first"),
    )
    out = milestones(star.fact_events, star.dim_activity, steps, required=())
    assert out.columns == ["Case_ID", "Last_Order_ts", "First_Clear_ts"]
    assert rows(out) == [("A", ts("2018-03-04"), ts("2018-03-05"))]


@pytest.mark.parametrize(
    "collation, found", [(None, False), ("UTF8_LCASE", True), ("UTF8_LCASE_RTRIM", True)]
)
def test_activity_names_match_exactly_unless_collated(log, collation, found):
    log.case("A", PO="2018-03-01")
    star = log.star()
    dim = star.dim_activity.withColumn("activity", F.upper("activity"))
    out = milestones(star.fact_events, dim, collation=collation)
    assert out.count() == (1 if found else 0)
    core = core_milestones(star.fact_events, star.dim_activity)
    (as_of,) = rows(as_of_date(core, dim, collation=collation))
    assert as_of == (ts("2018-03-01") if found else None,)


def test_as_of_date_and_start(spark, log):
    log.case("A", PO=["2019-09-30 09:00", "2019-10-05"]).case("B", PO="2019-01-01")
    log.case("C", CI="2020-01-01")
    star = log.star()
    core = core_milestones(star.fact_events, star.dim_activity)
    as_of = as_of_date(core, star.dim_activity)
    assert rows(as_of) == [(ts("2019-09-30 09:00"),)]
    start = spark.range(1).select(analysis_start(as_of.scalar(), 7))
    assert rows(start) == [(date(2019, 2, 1),)]


def test_long_and_wide_form_agree(spark, small):
    star = order_line_star(spark, small)
    wide = milestones(star.fact_events, star.dim_activity, required=())
    long = core_milestones(star.fact_events, star.dim_activity)
    names = {"PO_ts": 1, "GR_ts": 2, "IR_ts": 3, "CI_ts": 4}
    melted = wide.unpivot(["Case_ID"], list(names), "step", "t").filter("t IS NOT NULL")
    key = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("step"))
    a = melted.select("Case_ID", key.alias("k"), "t")
    b = long.select("case_id", "activity_key", "milestone_ts")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_input_order_and_partitioning_do_not_matter(spark, log):
    rng = random.Random(3)
    for i in range(40):
        times = [f"2018-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}" for _ in range(4)]
        log.case(f"C{i}", PO=times[:2], GR=times[1:3], CI=times[3])
    star = log.star()
    want = sorted(rows(milestones(star.fact_events, star.dim_activity)))
    rng.shuffle(log.events)
    shuffled = log.star().fact_events.repartition(7)
    assert sorted(rows(milestones(shuffled, star.dim_activity))) == want


def test_hot_case_is_combined_before_the_shuffle(spark, log):
    """A case with most events gives the right times and leaves the map tasks as one row each."""
    star = log.case("H", PO="2018-01-01").star()
    base = F.lit("2018-01-01 00:00:00").cast("timestamp_ntz")
    events = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("H"))
        .otherwise(F.concat(F.lit("C"), F.col("id") % 49))
        .alias("case_id"),
        (F.col("id") % 4 + 1).cast("int").alias("activity_key"),
        (base + F.make_dt_interval(mins=(F.col("id") % 5000).cast("int"))).alias("timestamp"),
    )
    out = {r["Case_ID"]: r for r in milestones(events, star.dim_activity).collect()}
    assert len(out) == 50
    hot = [i for i in range(200_000) if i % 3 == 0]
    first = min(i % 5000 for i in hot if i % 4 == 0)
    last = max(i % 5000 for i in hot if i % 4 == 3)
    minutes = lambda t: int((t - ts("2018-01-01")).total_seconds() // 60)
    assert (minutes(out["H"]["PO_ts"]), minutes(out["H"]["CI_ts"])) == (first, last)


def test_collated_spellings_keep_one_row_per_activity(spark, log):
    log.case("A", PO="2018-07-01", CI=["2018-07-09", "2018-07-12"])
    star = log.star()
    other = spark.createDataFrame([("A", 7, ts("2018-07-10"))], star.fact_events.schema)
    names = spark.createDataFrame([(1, "create purchase order item "), (4, "Clear Invoice"), (7, "CLEAR INVOICE ")], star.dim_activity.schema)
    out = core_milestones(star.fact_events.unionByName(other), names, collation="UTF8_LCASE_RTRIM")
    assert sorted(rows(out)) == [("A", 1, ts("2018-07-01")), ("A", 4, ts("2018-07-12")), ("A", 7, ts("2018-07-10"))]


def test_events_without_a_case_mark_nothing(spark, log):
    log.case(None, PO="2018-07-01").case("A", PO="2018-07-02")
    star = log.star()
    assert [r["Case_ID"] for r in milestones(star.fact_events, star.dim_activity).collect()] == ["A"]
