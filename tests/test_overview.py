from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from procflow.constants import CLOSED, OPEN, Params
from procflow.operators import overview as ov


def as_of_day():
    return F.lit("2019-01-31 12:00:00").cast("timestamp_ntz")


def first_day():
    return F.lit("2018-06-01").cast("date")


def spans(spark, *data):
    return spark.createDataFrame(
        [(c, ts(a), ts(b)) for c, a, b in data],
        "Case_ID STRING, Start_Time TIMESTAMP_NTZ, End_Time TIMESTAMP_NTZ",
    )


def classified(spark, *data):
    """Cases given as (type, days)."""
    df = spark.createDataFrame(
        [(f"C{i}", ts("2018-07-01"), ts("2018-07-01"), d, k) for i, (k, d) in enumerate(data)],
        "Case_ID STRING, Start_Time TIMESTAMP_NTZ, End_Time TIMESTAMP_NTZ, Duration_Days INT, "
        "Duration_Type STRING",
    )
    return ov.case_classification(df, first_day())


def test_closed_and_open_durations(spark):
    df = spans(
        spark,
        ("closed", "2018-12-01 23:59", "2018-12-02 00:01"),
        ("open", "2019-01-01", None),
        ("after", "2019-01-01", "2019-03-01"),
        ("negative", "2019-01-10", "2019-01-05"),
    )
    out = {r[0]: r[3:5] for r in rows(ov.case_overview(df, as_of_day()))}
    assert out == {
        "closed": (1, CLOSED),
        "open": (30, OPEN),
        "after": (59, CLOSED),
        "negative": (-5, CLOSED),
    }


def test_snapshot_reopens_cases_ended_later(spark):
    df = spans(spark, ("after", "2019-01-01", "2019-03-01"), ("same", "2019-01-01", "2019-01-31 12:00"))
    out = {r[0]: r[2:5] for r in rows(ov.case_overview(df, as_of_day(), snapshot=True))}
    assert out == {"after": (None, 30, OPEN), "same": (ts("2019-01-31 12:00"), 30, CLOSED)}


def test_classification_window_is_inclusive(spark):
    over = ov.case_overview(
        spans(spark, ("in", "2018-06-01", None), ("out", "2018-05-31 23:59", None)), as_of_day()
    )
    assert [r[0] for r in rows(ov.case_classification(over, first_day()))] == ["in"]


def test_distribution(spark):
    df = classified(
        spark, (CLOSED, 10), (CLOSED, 75), (CLOSED, 76), (OPEN, 200), (OPEN, 100), (OPEN, -4)
    )
    assert rows(ov.sla_distribution(df)) == [
        (CLOSED, "75", "Acceptable", 2, Decimal("66.67")),
        (CLOSED, "90", "Watchlist", 1, Decimal("33.33")),
        (OPEN, "75", "Acceptable", 1, Decimal("33.33")),
        (OPEN, "120", "At Risk", 1, Decimal("33.33")),
        (OPEN, ">150", "Critical", 1, Decimal("33.33")),
    ]


def test_monthly_trend_covers_all_history_in_order(spark):
    over = ov.case_overview(
        spans(
            spark,
            ("a", "2017-02-01", "2017-02-11"),
            ("b", "2018-11-01", "2019-03-01"),
            ("c", "2018-11-02", "2018-11-03"),
            ("d", "2018-11-02", "2019-01-25"),
            ("e", "2018-11-02", None),
        ),
        as_of_day(),
    )
    assert rows(ov.sla_trend(over, CLOSED)) == [
        ("2018-11", CLOSED, "Acceptable", 1, Decimal("33.33")),
        ("2018-11", CLOSED, "Watchlist", 1, Decimal("33.33")),
        ("2018-11", CLOSED, "Overdue", 1, Decimal("33.33")),
        ("2017-02", CLOSED, "Acceptable", 1, Decimal("100.00")),
    ]
    assert rows(ov.sla_trend(over, OPEN)) == [("2018-11", OPEN, "Watchlist", 1, Decimal("100.00"))]


def test_weekly_trend_excludes_the_cutoff_itself(spark):
    as_of = F.lit("2019-05-31 10:00:00").cast("timestamp_ntz")
    over = ov.case_overview(
        spans(
            spark,
            ("at", "2019-02-28 10:00", None),
            ("just", "2019-02-28 10:01", None),
            ("end", "2019-05-31 10:00", None),
        ),
        as_of,
    )
    out = rows(ov.sla_trend(over, OPEN, "iso_week", ov.trend_cutoff(as_of)))
    assert [(r[0], r[3]) for r in out] == [("2019-22", 1), ("2019-09", 1)]


def test_weekly_trend_year_option(spark):
    over = ov.case_overview(spans(spark, ("a", "2018-12-31", None)), as_of_day())
    label = lambda p: rows(ov.sla_trend(over, OPEN, "iso_week", params=p))[0][0]
    assert label(Params()) == "2018-01"
    assert label(Params(iso_year=True)) == "2019-01"


def test_backlog(spark):
    df = classified(
        spark, (OPEN, 90), (OPEN, 91), (OPEN, 94), (OPEN, 121), (OPEN, 500), (OPEN, 1), (CLOSED, 300)
    )
    assert rows(ov.backlog_total(df)) == [(6,)]
    assert rows(ov.backlog_aged_share(df)) == [(OPEN, 4, Decimal("66.67"))]
    assert rows(ov.backlog_aged_overview(df)) == [
        (OPEN, "120", "At Risk", 2, 92, Decimal("33.33")),
        (OPEN, "150", "Aged", 1, 121, Decimal("16.67")),
        (OPEN, ">150", "Critical", 1, 500, Decimal("16.67")),
    ]


def test_backlog_without_open_cases(spark):
    df = classified(spark, (CLOSED, 300))
    assert rows(ov.backlog_total(df)) == [(0,)]
    assert rows(ov.backlog_aged_share(df)) == []
    assert rows(ov.backlog_aged_overview(df)) == []


def test_duration_percentiles_mix_open_and_closed(spark):
    df = classified(spark, (CLOSED, 10), (OPEN, 20), (OPEN, 75), (CLOSED, 76))
    low, high = rows(ov.sla_duration_percentiles(df))
    assert low == ("Lead Time <= 75 days", 20.0, 64.0)
    assert high == ("Lead Time > 75 days", 76.0, 76.0)


def test_duration_percentiles_leave_out_empty_side(spark):
    df = classified(spark, (CLOSED, 10))
    assert rows(ov.sla_duration_percentiles(df)) == [("Lead Time <= 75 days", 10.0, 10.0)]


def test_ratios_of_a_group_add_up(spark):
    df = classified(spark, *[(CLOSED, d) for d in (1, 80, 100, 130, 151, 152, 153)])
    total = sum(r[4] for r in rows(ov.sla_distribution(df)))
    assert abs(total - 100) <= Decimal("0.03")


def test_other_edges_come_with_their_labels(spark):
    over = ov.case_overview(spans(spark, ("a", "2019-01-16", None)), as_of_day())
    with pytest.raises(ValueError):
        ov.case_classification(over, first_day(), (10, 20))
    (row,) = rows(ov.case_classification(over, first_day(), (10, 20), ("low", "mid", "high")))
    assert row[4:] == ("20", "mid")


def test_counted_overview_gives_the_rows_of_the_cases(spark):
    """Every report over the counted table equals the one over the cases, on the day of the cut too."""
    df = spans(
        spark,
        ("A", "2018-10-31 11:59", "2018-11-30"),
        ("B", "2018-10-31 12:00", "2018-11-30"),
        ("C", "2018-10-31 12:01", "2018-11-30"),
        ("D", "2018-10-31 23:00", "2018-11-30"),
        ("E", "2018-07-01", None),
        ("F", "2018-07-01 05:00", None),
        ("G", "2018-05-31", "2019-01-31"),
        ("H", "2018-08-03", None),
        ("I", "2018-12-31", "2018-12-30"),
        ("J", "2019-01-30", None),
    )
    cut = F.lit("2018-10-31 12:00:00").cast("timestamp_ntz")
    plain = ov.case_overview(df, as_of_day())
    few = ov.counted_overview(plain, cut)
    assert few.count() < plain.count()
    for kind in (CLOSED, OPEN):
        for period, since in (("month", None), ("iso_week", cut)):
            want = rows(ov.sla_trend(plain, kind, period, since))
            assert want and rows(ov.sla_trend(few, kind, period, since)) == want
    (after,) = [r for r in rows(ov.sla_trend(few, CLOSED, "month", cut)) if r[0] == "2018-10"]
    assert after[3] == 2
    whole, counts = (ov.case_classification(d, first_day()) for d in (plain, few))
    for report in (
        ov.sla_distribution,
        ov.backlog_total,
        ov.backlog_aged_share,
        ov.backlog_aged_overview,
        ov.sla_duration_percentiles,
    ):
        assert rows(report(counts)) == rows(report(whole))


def test_counted_overview_without_cases(spark):
    cut = F.lit("2018-10-31").cast("timestamp_ntz")
    few = ov.counted_overview(ov.case_overview(spans(spark, ("A", None, None)).limit(0), as_of_day()), cut)
    counts = ov.case_classification(few, first_day())
    assert rows(ov.backlog_total(counts)) == [(0,)]
    assert rows(ov.sla_distribution(counts)) == rows(ov.backlog_aged_overview(counts)) == []
