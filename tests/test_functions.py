from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import column, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procflow.functions.classify import (
    delay_flag,
    duration_bucket,
    position,
    risk_status,
    trend_status,
)
from procflow.functions.dates import (
    day_span,
    first_of_month,
    months_before,
    period_label,
)
from procflow.functions.numeric import day_share, ratio, to_int, to_percent
from procflow.functions.ordered import By, dense_ranks, ranged_sum, row_numbers, running_sum
from procflow.functions.percentiles import histogram, percentiles, selected_percentiles

FEW = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def one(spark, expr, **values):
    """Value of an expression over one row of timestamps (str) or numbers."""
    cols = {
        k: F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else F.lit(v)
        for k, v in values.items()
    }
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()])
    return row.select(expr.alias("x")).first()["x"]


def test_bucket_edges(spark):
    days = [-1, 0, 75, 76, 90, 91, 120, 121, 150, 151]
    df = spark.createDataFrame([(d,) for d in days], "d INT").select(
        "d", duration_bucket(F.col("d")).alias("b"), risk_status(F.col("d")).alias("r")
    )
    assert column(df.orderBy("d"), "b") == [
        "75", "75", "75", "90", "90", "120", "120", "150", "150", ">150",
    ]
    assert column(df.orderBy("d"), "r") == [
        *["Acceptable"] * 3, *["Watchlist"] * 2, *["At Risk"] * 2, *["Aged"] * 2, "Critical",
    ]


def test_bucket_needs_matching_labels(spark):
    with pytest.raises(ValueError):
        risk_status(F.lit(1), (10, 20))


def test_trend_status_and_flag(spark):
    df = spark.createDataFrame([(75,), (76,), (90,), (91,), (-3,)], "d INT")
    got = rows(df.select(trend_status(F.col("d")), delay_flag(F.col("d"))))
    assert got == [
        ("Acceptable", 0),
        ("Watchlist", 1),
        ("Watchlist", 1),
        ("Overdue", 1),
        ("Acceptable", 0),
    ]


def test_position_with_shared_place(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "v STRING")
    got = column(df.select(position(F.col("v"), [("a", 1), ("b", 2), ("c", 2)]).alias("p")), "p")
    assert got == [1, 2, 2, None]


def test_day_span_counts_midnights(spark):
    span = day_span(F.col("a"), F.col("b"))
    assert one(spark, span, a="2018-03-01 23:59", b="2018-03-02 00:01") == 1
    assert one(spark, span, a="2018-03-01 00:01", b="2018-03-01 23:59") == 0
    assert one(spark, span, a="2018-03-05 00:00", b="2018-03-02 23:59") == -3


def test_first_of_month_clips(spark):
    assert one(spark, first_of_month(F.col("a"), 7), a="2019-09-30 08:00") == date(2019, 2, 1)
    assert one(spark, first_of_month(F.col("a"), 7), a="2019-01-31 23:59") == date(2018, 6, 1)


def test_months_before_keeps_time(spark):
    cut = months_before(F.col("a"), 3)
    assert one(spark, cut, a="2019-05-31 10:00") == datetime(2019, 2, 28, 10)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_window_start_ignores_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        inside = F.col("a").cast("date") >= first_of_month(F.col("b"), 7)
        assert one(spark, inside, a="2018-04-01 00:00", b="2018-11-05 02:00") is True
        assert one(spark, inside, a="2018-03-31 23:59", b="2018-11-05 02:00") is False
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_period_labels(spark):
    day = F.col("a")
    assert one(spark, period_label(day), a="2018-03-09") == "2018-03"
    week = period_label(day, "iso_week")
    assert one(spark, week, a="2018-12-31") == "2018-01"
    assert one(spark, week, a="2021-01-01") == "2021-53"
    iso = period_label(day, "iso_week", iso_year=True)
    assert one(spark, iso, a="2018-12-31") == "2019-01"
    assert one(spark, iso, a="2021-01-01") == "2020-53"
    with pytest.raises(ValueError):
        period_label(day, "quarter")


def test_ratio_rounds_half_up(spark):
    r = ratio(F.col("a"), F.col("b"))
    assert one(spark, r, a=29, b=20000) == Decimal("0.15")
    assert one(spark, r, a=1, b=3) == Decimal("33.33")
    assert one(spark, r, a=2, b=3) == Decimal("66.67")
    assert one(spark, r, a=5, b=0) is None


def test_share_and_conversions(spark):
    share = day_share(F.col("a"), F.col("b"), 4)
    assert one(spark, share, a=1, b=7) == Decimal("14.2857")
    assert one(spark, share, a=0, b=0) is None
    assert one(spark, to_int(F.col("a")), a=2.9999999999999) == 3
    assert one(spark, to_int(F.col("a")), a=2.9) == 2
    assert one(spark, to_int(F.col("a")), a=-2.9) == -2
    assert one(spark, to_percent(F.col("a")), a=0.145) == Decimal("0.15")
    assert one(spark, to_percent(F.col("a")), a=12.345) == Decimal("12.35")


def test_percentile_ignores_null(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4, None)], "g STRING, v INT")
    out = percentiles(histogram(df, "g", "v"), ["g"], "v", {"m": 0.5, "p": 0.9})
    g, m, p, n = out.first()
    assert (g, m, n) == ("g", 2.5, 5)
    assert p == pytest.approx(3.7)


def test_percentile_of_nothing_gives_no_row(spark):
    df = spark.createDataFrame([], "g STRING, v INT")
    assert rows(percentiles(histogram(df, "g", "v"), ["g"], "v", {"m": 0.5})) == []


def _interpolated(values, p):
    values = sorted(values)
    pos = p * (len(values) - 1)
    low = int(pos)
    high = min(low + 1, len(values) - 1)
    return values[low] + (pos - low) * (values[high] - values[low])


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-20, 20)), min_size=1, max_size=60))
def test_percentiles_match_sorting(spark, data):
    df = spark.createDataFrame(data, "g INT, v INT").repartition(3)
    out = percentiles(histogram(df, "g", "v"), ["g"], "v", {"m": 0.5, "p": 0.9})
    groups: dict[int, list[int]] = {}
    for g, v in data:
        groups.setdefault(g, []).append(v)
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["m"] == pytest.approx(_interpolated(values, 0.5))
        assert got[g]["p"] == pytest.approx(_interpolated(values, 0.9))


ORDERED = st.lists(
    st.tuples(
        st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 4), st.integers(0, 9)
    ),
    min_size=1,
    max_size=50,
)


def _descending(key):
    return (key is None, -(key or 0))


@FEW
@given(ORDERED)
def test_dense_ranks_match_sorting(spark, data):
    df = spark.createDataFrame(data, "a INT, b INT, v INT").repartition(3)
    got = dense_ranks(df, [By("a", True)], [By("b")], "rank")
    order = sorted({(a, b) for a, b, _ in data}, key=lambda k: (_descending(k[0]), k[1]))
    place = {k: i for i, k in enumerate(order, 1)}
    want = Counter((a, b, v, place[a, b]) for a, b, v in data)
    assert Counter(rows(got)) == want


@FEW
@given(ORDERED)
def test_running_sum_matches_loop(spark, data):
    data = [(a, i, v) for i, (a, _, v) in enumerate(data)]
    df = spark.createDataFrame(data, "a INT, b INT, v INT").repartition(3)
    got = running_sum(df, "v", [By("a", True)], [By("b")], "total")
    want, total = [], 0
    for a, b, v in sorted(data, key=lambda r: (_descending(r[0]), r[1])):
        total += v
        want.append((a, b, v, total))
    assert sorted(rows(got), key=lambda r: r[3:] + r[1:2]) == sorted(
        want, key=lambda r: r[3:] + r[1:2]
    )


def test_row_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("g"), F.col("id"))
    numbered = [
        sorted(rows(row_numbers(df.repartition(n), [By("g")], [By("id", True)], "n")))
        for n in (1, 5)
    ]
    assert numbered[0] == numbered[1]
    assert sorted(r[2] for r in numbered[0]) == list(range(1, 501))


@FEW
@given(ORDERED)
def test_ranged_sum_matches_loop(spark, data):
    data = [(a, i, v) for i, (a, _, v) in enumerate(data)]
    df = spark.createDataFrame(data, "a INT, b INT, v INT").repartition(3)
    for groups in ([], ["a"]):
        order = [By("b", True)] if groups else [By("a", True), By("b")]
        got = ranged_sum(df, "v", order, "total", groups)
        want, total = [], {}
        for a, b, v in sorted(data, key=(lambda r: -r[1]) if groups else lambda r: (_descending(r[0]), r[1])):
            total[a if groups else 0] = total.get(a if groups else 0, 0) + v
            want.append((a, b, v, total[a if groups else 0]))
        assert sorted(rows(got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_ranges_are_even_for_ties_and_a_far_key(spark):
    """40,000 rows that tie on the first key, one of them far away: every range has its share."""
    far = F.when(F.col("id") == 0, F.lit(10**15)).otherwise(F.col("id"))
    df = spark.range(40_000).select(F.lit(1).alias("tie"), far.alias("key"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranged_sum(df, "v", [By("tie"), By("key")], "place")
        largest = out.select("place").agg(F.max("place"), F.countDistinct("place")).first()
        scan = out._jdf.queryExecution().analyzed().collectLeaves().apply(0).toString()
        assert tuple(largest) == (40_000, 40_000) and "_range" in scan
        files = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
        sizes = [r["count"] for r in files.groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8


@FEW
@given(
    st.lists(
        st.tuples(
            st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.integers(-20, 20)), st.integers(1, 4)
        ),
        max_size=60,
    )
)
def test_selected_percentiles_are_those_of_one_buffer(spark, data):
    df = spark.createDataFrame(data, "g INT, v INT, _n INT").repartition(3)
    named = {"low": 0.0, "m": 0.5, "p": 0.9, "high": 1.0}
    got = {r["g"]: tuple(r) for r in selected_percentiles(df, ["g"], "v", named).collect()}
    want = {r["g"]: tuple(r) for r in percentiles(df, ["g"], "v", named).collect()}
    assert got == want
