from __future__ import annotations

import os
import shutil

import pytest
from conftest import rows, ts
from pyspark.sql import functions as F

from procflow import (
    Params,
    Segment,
    VENDOR,
    build_model,
    build_star,
    load_star,
    read_log,
    read_output,
    reports,
    save_star,
)
from procflow.constants import CLOSED, OPEN
from procflow.plans import reports as rp
from procflow import write_outputs
from procflow.plans.model import case_table
from procflow.plans.order_line_model import order_line_model
from procflow.plans.reports import REPORTS
from procflow.sources import staging
from procflow.sources.order_lines import order_line_log, order_line_star
from procflow.sources.flat_log import BAD_TIME, KEPT, NO_ACTIVITY, NO_CASE, NO_TIME, check_log
from procflow.sources.sinks import publish_outputs, published
from procflow.sources.schema import event_log_schema
from procflow.sources.star import Star, case_attributes, surrogate_keys


def flat(spark, *data):
    return spark.createDataFrame(
        [(c, a, ts(t), *rest) for c, a, t, *rest in data], event_log_schema()
    )


def tiny_log(spark):
    po, ci = "Create Purchase Order Item", "Clear Invoice"
    return flat(
        spark,
        ("A", po, "2018-07-01", "Vee", "Com", "g", "Pumps", "Direct"),
        ("A", ci, "2018-07-09", "Vee", "Com", "g", "Pumps", "Direct"),
        ("A", ci, "2018-07-09", "Vee", "Com", "g", "Pumps", "Direct"),
        ("B", po, "2018-07-02", None, "Com", "g", "Pumps", None),
        ("C", po, "2018-07-03", None, None, None, None, None),
    )


def test_star_from_log(spark):
    star = build_star(tiny_log(spark))
    activity = dict(r[::-1] for r in rows(star.dim_activity))
    assert sorted(activity.values()) == [1, 2]
    assert rows(star.dim_vendor) == [(1, "Vee")]
    areas = {r[1:]: r[0] for r in rows(star.dim_spend_area)}
    assert set(areas) == {("Pumps", "Direct"), ("Pumps", None)}
    assert star.fact_events.count() == 5
    cases = {r[0]: r[1:] for r in rows(star.fact_cases)}
    assert cases == {
        "A": (1, 1, areas["Pumps", "Direct"]),
        "B": (1, None, areas["Pumps", None]),
        "C": (None, None, None),
    }
    assert sorted(rows(star.fact_case_milestones_core)) == sorted(
        (c, activity[a], ts(t))
        for c, a, t in (
            ("A", "Create Purchase Order Item", "2018-07-01"),
            ("A", "Clear Invoice", "2018-07-09"),
            ("B", "Create Purchase Order Item", "2018-07-02"),
            ("C", "Create Purchase Order Item", "2018-07-03"),
        )
    )


def test_several_attribute_values_smallest_wins(spark):
    df = flat(
        spark,
        ("A", "x", "2018-07-01", "b", "c", "g", "Zinc", "a"),
        ("A", "x", "2018-07-01", "a", None, "g", "Pumps", "z"),
        ("A", "x", "2018-07-01", None, None, "g", None, None),
    )
    out = case_attributes(
        df, "case_id", [["vendor"], ["company"], ["sub_spend_area", "spend_classification"]]
    )
    assert rows(out) == [("A", "a", "c", "Pumps", "z")]


def test_case_facts_are_aggregated_by_hash(spark):
    df = flat(
        spark,
        ("A", "x", "2018-07-01", None, "c", "g", None, "z"),
        ("A", "x", "2018-07-01", "v10", None, "g", "Pumps", "a"),
        ("A", "x", "2018-07-01", "v9", "C", "g", None, None),
        ("B", "x", "2018-07-01", None, None, "g", None, None),
        (None, "x", "2018-07-01", "v0", "a", "g", "Air", "a"),
    )
    star = build_star(df)
    assert "SortAggregate" not in star.fact_cases._jdf.queryExecution().executedPlan().toString()
    named = star.fact_cases
    for dim in (star.dim_vendor, star.dim_company, star.dim_spend_area):
        named = named.join(dim, dim.columns[0], "left")
    # NULL is smaller than a text, but a row of NULLs only names nothing.
    texts = ["case_id", "vendor", "company", "sub_spend_area_text", "spend_classification_text"]
    assert sorted(rows(named.select(*texts))) == [("A", "v10", "C", None, "z"), ("B", None, None, None, None)]


def test_surrogate_keys_are_stable(spark):
    names = spark.range(3000).select(F.concat(F.lit("VENDOR_"), "id").alias("v"))
    one = dict(rows(surrogate_keys(names, ["v"], "k").select("v", "k")))
    other = dict(rows(surrogate_keys(names.repartition(5).orderBy(F.rand(1)), ["v"], "k").select("v", "k")))
    assert one == other
    assert sorted(one.values()) == list(range(1, 3001))


def test_star_round_trip_gives_the_same_reports(spark, small, tmp_path):
    star = build_star(order_line_log(spark, small))
    save_star(star, str(tmp_path / "star"))
    loaded = load_star(spark, str(tmp_path / "star"))
    assert set(loaded.tables()) == set(star.tables())
    own = reports(build_model(loaded))
    base = reports(order_line_model(spark, small))
    # The keys of the two stars differ, so compare what does not show a key.
    for name in ("sla_distribution", "sla_weekly_closed", "primary_issue_share", "contribution_all"):
        assert rows(own[name]) == rows(base[name]), name
    assert own["vendor_ranking"].drop("Vendor_key").exceptAll(
        base["vendor_ranking"].drop("Vendor_key")
    ).isEmpty()


def test_core_milestones_decide_the_end_in_the_sla_view(spark, log):
    """The SLA view ends a case by the milestone table, the stage view by the events."""
    log.case("A", PO="2018-07-01", CI="2018-07-09").case("B", PO="2018-07-01")
    core = [("A", 1, ts("2018-07-01")), ("A", 4, ts("2018-07-11")), ("B", 1, ts("2018-12-01"))]
    m = build_model(log.star(core))
    assert rows(m.as_of_row) == [(ts("2018-12-01"),)]
    over = {r["Case_ID"]: r["Duration_Days"] for r in m.overview.collect()}
    assert over == {"A": 10, "B": 153}
    assert {r["Case_ID"]: r["Lead_Time"] for r in m.stage_base.collect()} == {"A": 8, "B": None}


def test_model_without_core_table_agrees_with_it(spark, small):
    star = order_line_star(spark, small)
    with_core = Star(
        star.fact_events,
        star.fact_cases,
        star.dim_activity,
        star.dim_spend_area,
        build_core(star),
    )
    a, b = case_table(star), case_table(with_core).select(*case_table(star).columns)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def build_core(star):
    from procflow.operators.milestones import core_milestones

    return core_milestones(star.fact_events, star.dim_activity)


def test_empty_log_gives_empty_reports(spark, log):
    m = build_model(log.star())
    for name, df in reports(m).items():
        got = rows(df)
        if name == "backlog_total":
            assert got == [(0,)]
        elif name == "stage_quality_check":
            assert got == [(0, 0, None)]
        else:
            assert got == [], name


def test_parameters_reach_the_reports(spark, small):
    base = order_line_model(spark, small)
    params = Params(target_days=60, top_vendors=2, min_cases=5, bucket_edges=(60, 90, 120, 150))
    own = type(base)(base.cases, base.as_of_row, base.dim_spend_area, params)
    assert "Stage_LT_Within_60" in REPORTS["stage_duration_within"](own).columns
    assert {r["Distribution_Buckets"] for r in REPORTS["sla_distribution"](own).collect()} >= {"60"}
    assert REPORTS["vendor_bottleneck"](own).select("Vendor_key").distinct().count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_sink_round_trip(spark, small, tmp_path, fmt):
    m = order_line_model(spark, small)
    results = {n: REPORTS[n](m) for n in ("sla_distribution", "vendor_ranking")}
    paths = write_outputs(results, str(tmp_path), fmt, single_file=results)
    assert set(paths) == set(results)
    for name, df in results.items():
        back = read_output(spark, paths[name], df, fmt)
        assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
        assert len([f for f in os.listdir(paths[name]) if f.startswith("part-")]) == 1


def test_sink_rejects_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        write_outputs({}, str(tmp_path), "xlsx")


def test_staged_table_lies_in_the_shared_folder(spark):
    df = staging.stage(spark.range(10), "ten")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(f.split("://")[-1].startswith(folder) for f in df.inputFiles())
    assert df.count() == 10


class Cluster:
    """What ``shared_folder`` asks of a session, here of one on a cluster without the setting."""

    class sparkContext:
        master, applicationId = "spark://somewhere:7077", "app"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_staging_needs_a_shared_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_folder(Cluster)


def test_staged_tables_can_be_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(staging, "shared_folder", lambda s: str(tmp_path))
    monkeypatch.setattr(staging, "_staged", {})
    staging.stage(spark.range(3), "x")
    assert list(tmp_path.rglob("part-*"))
    staging.remove_staged(spark)
    assert not list(tmp_path.rglob("part-*"))


def test_case_shuffle_takes_the_given_reducers(spark, small):
    star = order_line_star(spark, small)
    with staging.reducers(spark, 37):
        text = case_table(star)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case_id" in text and ", 37)" in text
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    assert build_model(star, partitions=5).cases.count() == order_line_model(spark, small).cases.count()


def test_star_builder_scans_the_log_three_times(spark, small):
    reads = []
    log = order_line_log(spark, small)
    original = staging.stage

    def counted(df, name):
        reads.append((name, df._jdf.queryExecution().executedPlan().toString().count("lineitem")))
        return original(df, name)

    import procflow.sources.star as module

    module.stage, kept = counted, module.stage
    try:
        star = build_star(log)
    finally:
        module.stage = kept
    assert sum(n > 0 for _, n in reads) == 3 and sum(n for _, n in reads) == 3
    for df in star.tables().values():
        assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()


def test_order_line_cases_are_unique(spark, small):
    cases = order_line_star(spark, small).fact_cases
    assert cases.count() == cases.select("case_id").distinct().count()


@pytest.mark.parametrize("core", [True, False])
def test_load_what_was_saved(spark, log, tmp_path, core):
    log.case("A", PO="2018-07-01", CI="2018-07-09")
    log.areas = [(1, "Pumps", "Direct")]
    star = log.star([("A", 1, ts("2018-07-01"))] if core else None)
    save_star(star, str(tmp_path))
    loaded = load_star(spark, str(tmp_path))
    assert set(loaded.tables()) == set(star.tables()) and (loaded.fact_case_milestones_core is not None) == core
    assert rows(build_model(loaded).cases.select("Case_ID")) == [("A",)]
    some = load_star(spark, str(tmp_path), tables=["dim_spend_area"])
    assert rows(some.dim_spend_area) == [(1, "Pumps", "Direct")] and some.dim_vendor is None


def test_flat_log_from_csv(spark, tmp_path):
    lines = ["Case;Step;When;Supplier;Plant", "A;Create Purchase Order Item;01-07-2018 10:00;V1;North"]
    lines += ["A;Clear Invoice;09-07-2018 23:59;V1;North", "B;Create Purchase Order Item;02-07-2018 08:30;;South"]
    lines += ["B;Clear Invoice;not a time;;South", "C;Clear Invoice;;V2;"]
    (tmp_path / "log.csv").write_text("\n".join(lines))
    names = {"case_id": "Case", "activity": "Step", "timestamp": "When", "vendor": "Supplier"}
    log = read_log(spark, str(tmp_path / "log.csv"), "csv", names, "dd-MM-yyyy HH:mm", {"sep": ";"})
    assert dict(log.dtypes)["timestamp"] == "timestamp_ntz"
    star = build_star(log, attributes={"vendor_key": {"vendor": "vendor"}, "plant_key": {"Plant": "plant"}})
    assert star.dim_spend_area is None and star.dim_vendor.count() == 2
    save_star(star, str(tmp_path / "star"))
    plant = Segment("plant_key", "Plant_key", "Plant_Rank")
    m = build_model(load_star(spark, str(tmp_path / "star")), Params(min_cases=1), segments=(VENDOR, plant))
    assert {(r["Case_ID"], r["Lead_Time"]) for r in m.stage_base.collect()} == {("A", 8), ("B", None)}
    assert [r["Total_cases"] for r in rp.segment_ranking(m, plant).collect()] == [1]
    with pytest.raises(ValueError, match="timestamp"):
        read_log(spark, str(tmp_path / "log.csv"), "csv", {"case_id": "Case", "activity": "Step"}, options={"sep": ";"})


def test_flat_log_round_trip_of_other_formats(spark, small, tmp_path):
    log = order_line_log(spark, small)
    log.write.parquet(str(tmp_path / "parquet"))
    log.write.option("header", True).csv(str(tmp_path / "csv"))
    for fmt in ("parquet", "csv"):
        back = read_log(spark, str(tmp_path / fmt), fmt).select(*log.columns)
        assert back.exceptAll(log).isEmpty() and log.exceptAll(back).isEmpty()


def test_snapshot_holds_in_every_view(spark, log):
    log.case("A", PO="2018-07-01", GR="2018-07-02", IR="2018-07-03", CI="2019-05-01")
    log.case("B", PO="2019-01-01", GR="2019-01-02", IR="2019-01-03", CI="2019-01-01")
    star = log.star()
    whole, seen = (build_model(star, Params(min_cases=1, snapshot=s)) for s in (False, True))
    assert {r["Case_ID"]: r["Duration_Type"] for r in seen.overview.collect()} == {"A": OPEN, "B": CLOSED}
    assert rows(REPORTS["backlog_total"](seen)) == [(1,)] and rows(REPORTS["backlog_total"](whole)) == [(0,)]
    assert sorted(r["Case_ID"] for r in whole.delay_base.collect()) == ["A", "B"]
    assert [r["Case_ID"] for r in seen.delay_base.collect()] == ["B"]
    issues = {r["Case_ID"]: r["Primary_Issue"] for r in seen.stage_flags.collect()}
    assert issues["A"] == "Missing_CI"


def test_model_is_built_once_until_the_input_changes(spark, small, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    shutil.copyfile(f"{small}/lineitem.parquet", folder / "lineitem.parquet")
    first = order_line_model(spark, str(folder))
    assert order_line_model(spark, str(folder)) is first
    lines = spark.read.parquet(f"{small}/lineitem.parquet").limit(100)
    lines.coalesce(1).write.parquet(str(tmp_path / "part"))
    part = next(f for f in os.listdir(tmp_path / "part") if f.startswith("part-"))
    shutil.copyfile(tmp_path / "part" / part, folder / "lineitem.parquet")
    second = order_line_model(spark, str(folder))
    assert second is not first
    assert second.cases.count() < first.cases.count()


def test_keys_survive_growth(spark):
    """Members of the first star keep their keys; those of later logs are numbered after them."""
    first = build_star(tiny_log(spark))
    more = tiny_log(spark).unionAll(
        flat(
            spark,
            ("D", "Change Price", "2018-07-01", "Aaa", "Com", "g", "Pumps", "Direct"),
            ("E", "Change Price", "2018-07-01", "Zzz", "New", "g", "Valves", None),
        )
    )
    grown = build_star(more, known=first.dimensions())
    for name in ("dim_activity", "dim_vendor", "dim_company", "dim_spend_area"):
        old, new = ({r[1:]: r[0] for r in rows(s.tables()[name])} for s in (first, grown))
        assert old.items() <= new.items() and len(new) > len(old)
        assert sorted(new.values()) == list(range(1, len(new) + 1))
    again = build_star(more, known=grown.dimensions())
    assert sorted(rows(again.dim_vendor)) == sorted(rows(grown.dim_vendor))
    assert sorted(rows(again.fact_cases), key=str) == sorted(rows(grown.fact_cases), key=str)


def test_spellings_of_a_member_are_one(spark):
    po = "Create Purchase Order Item"
    log = flat(
        spark,
        ("A", po, "2018-07-01", "Vee", "Com", "g", "Pumps", None),
        ("B", po.upper(), "2018-07-02", "VEE ", "com", "g", "PUMPS", None),
        ("C", f"{po} ", "2018-07-03", "Wee", None, "g", "pumps ", "Direct"),
    )
    star = build_star(log, collation="UTF8_LCASE_RTRIM")
    assert [star.tables()[n].count() for n in ("dim_activity", "dim_vendor", "dim_company", "dim_spend_area")] == [1, 2, 1, 2]
    cases = {r["case_id"]: r for r in star.fact_cases.collect()}
    assert cases["A"][1:] == cases["B"][1:] and cases["A"]["vendor_key"] != cases["C"]["vendor_key"]
    assert sorted(r[0] for r in rows(star.dim_vendor.select("vendor"))) == ["VEE ", "Wee"]
    known = build_star(log, known=star.dimensions(), collation="UTF8_LCASE_RTRIM")
    assert sorted(rows(known.dim_vendor)) == sorted(rows(star.dim_vendor))


def test_a_failed_run_leaves_the_published_set(spark, tmp_path):
    folder = str(tmp_path / "reports")
    with pytest.raises(ValueError, match="nothing"):
        published(spark, folder)
    old = {"a": spark.range(3), "b": spark.range(2)}
    publish_outputs(old, folder, "csv", single_file=["a"])
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish_outputs({"a": spark.range(9), "b": broken}, folder)
    found = {n: read_output(spark, path, old[n], fmt).count() for n, (path, fmt) in published(spark, folder).items()}
    assert found == {"a": 3, "b": 2}
    publish_outputs({"c": spark.range(4)}, folder)
    assert {n: fmt for n, (_, fmt) in published(spark, folder).items()} == {"c": "parquet"}


def test_rows_of_a_log_are_kept_or_rejected_with_a_reason(spark, tmp_path):
    data = [
        ("A", "Pay", "01-07-2018 10:00", "x"),
        (None, "Pay", "nothing", "x"),
        (" ", None, None, "x"),
        ("B", None, "01-07-2018 10:00", "x"),
        ("B", "Pay", None, None),
        ("C", "Pay", "31-02-2018 10:00", "x"),
        ("C", "Pay", "25-03-2018 02:30", "x"),
    ]
    raw = spark.createDataFrame(data, "case_id string, activity string, timestamp string, vendor string")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        checked = check_log(raw, str(tmp_path / "checked"), "dd-MM-yyyy HH:mm")
        kept = sorted(rows(checked.kept))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # The second time does not exist in that zone; a time without zone is kept as it is.
    assert kept == [("A", "Pay", ts("2018-07-01 10:00"), "x"), ("C", "Pay", ts("2018-03-25 02:30"), "x")]
    assert {tuple(r) for r in checked.counts().collect()} == {
        (KEPT, 2), (NO_CASE, 2), (NO_ACTIVITY, 1), (NO_TIME, 1), (BAD_TIME, 1)
    }
    bad = checked.rejected.filter(F.col("reason") == BAD_TIME).collect()
    assert [(r["case_id"], r["timestamp"]) for r in bad] == [("C", "31-02-2018 10:00")]


def test_checking_an_empty_log_or_one_with_real_times(spark, tmp_path):
    schema = "case_id string, activity string, timestamp timestamp_ntz"
    empty = check_log(spark.createDataFrame([], schema), str(tmp_path / "empty"))
    assert empty.counts().count() == 0
    some = spark.createDataFrame([("A", "Pay", ts("2018-07-01")), ("A", "Pay", None)], schema)
    checked = check_log(some, str(tmp_path / "some"))
    assert rows(checked.kept) == [("A", "Pay", ts("2018-07-01"))]
    assert [r["reason"] for r in checked.rejected.collect()] == [NO_TIME]
