"""Shape of the physical plans: what is read, shuffled, broadcast and sorted."""

from __future__ import annotations

import contextlib
import io
import re
from dataclasses import replace

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from procflow.operators.milestones import core_milestones, milestones
from procflow.plans.model import START_MONTH, build_model, case_table
from procflow.plans.order_line_model import order_line_model
from procflow.plans.registry import QUERIES
from procflow.plans.reports import REPORTS
from procflow.sources.order_lines import order_line_star
from procflow.sources.star import load_star, save_star

#: The reports over counted tables: all of the SLA, backlog and bottleneck sections.
COUNTED = list(REPORTS)[:17]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def reads(text: str, file: str) -> int:
    """Scans of ``file`` in a formatted plan."""
    return len(re.findall(rf"Location: InMemoryFileIndex.*{file}", text))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_cross_join(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_milestones_scan_once_and_shuffle_once(spark, small):
    star = order_line_star(spark, small)
    for build in (milestones, core_milestones):
        text = plan(build(star.fact_events, star.dim_activity))
        assert reads(text, "lineitem") == 1
        assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
        assert "partial_min" in text


def test_scan_reads_the_key_columns_only(spark, small):
    text = plan(case_table(order_line_star(spark, small)))
    schemas = re.findall(r"ReadSchema: struct<(.*)>", text)
    assert schemas
    for s in schemas:
        assert {c.split(":")[0] for c in s.split(",")} <= {
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
        }


def test_case_table_needs_one_shuffle_and_no_sort(spark, small, tmp_path):
    star = order_line_star(spark, small)
    core = core_milestones(star.fact_events, star.dim_activity)
    save_star(replace(star, fact_case_milestones_core=core), str(tmp_path))
    saved = load_star(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(case_table(saved))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    assert "Sort" not in text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_do_not_read_case_ids(spark, small, name):
    text = plan(REPORTS[name](order_line_model(spark, small)))
    assert reads(text, "lineitem") == 0
    for s in re.findall(r"ReadSchema: struct<(.*)>", text):
        assert "Case_ID" not in s


@pytest.mark.parametrize("name", ["classification", "stage_base", "delay_base"])
def test_window_start_reaches_the_scan(spark, small, name):
    text = plan(getattr(order_line_model(spark, small), name))
    assert re.search(r"PushedFilters: \[.*IsNotNull\(PO_day\)", text)
    assert re.search(r"DataFilters: .*PO_day#\d+ >= (Reused)?Subquery|PO_day#\d+ >= Subquery", text)


def rows_read(df, metric: str = "numOutputRows") -> dict[str, int]:
    """Rows each Parquet scan handed on, or another of its metrics, from the executed plan."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        found, todo = {}, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if "Scan parquet" in node.nodeName():
                count = node.metrics().get(metric).get().value()
                found[node.toString().split("\n")[0]] = count
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
    return found


def test_scan_skips_what_lies_before_the_window(spark):
    """The staged files are sorted by start, so the window start cuts off whole pages."""
    m = order_line_model(spark, str(TESTDATA / "sf0.1"))
    total = m.cases.count()
    for df in (m.classification.select("Duration_Days"), m.stage_base.select("Lead_Time")):
        read = [n for scan, n in rows_read(df).items() if "PO_day" in scan]
        assert read and max(read) < 0.8 * total


def test_window_opens_the_files_of_its_months_only(spark):
    """The case table lies in folders by month; files before the window are not in the scan at all."""
    m = order_line_model(spark, str(TESTDATA / "sf0.1"))
    files = spark.read.parquet(*m.cases.inputFiles()).select(F.input_file_name().alias("f"))
    month = F.regexp_extract("f", START_MONTH + "=([0-9-]+)", 1)
    within = {r["f"] for r in files.distinct().filter(month.try_cast("date") >= m.start).collect()}
    assert 0 < len(within) < len(m.cases.inputFiles())
    for df in (m.classification.select("Duration_Days"), m.stage_base.select("Lead_Time"), m.delay_base):
        opened = [n for scan, n in rows_read(df, "numFiles").items() if "PO_day" in scan]
        assert opened == [len(within)]


def test_a_day_with_most_cases_is_split_over_files(spark, log):
    for i in range(60):
        log.case(f"C{i}", PO="2018-07-01" if i % 3 else "2018-05-01", CI="2018-07-09")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        split = build_model(log.star(), partitions=6)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert split.cases.count() == 60
    assert split.cases.filter("PO_day = '2018-07-01'").select(F.input_file_name()).distinct().count() > 1


@pytest.mark.parametrize("name", COUNTED)
def test_counted_reports_scan_no_cases(spark, small, name):
    """17 reports read the counted tables, whatever the number of cases."""
    files = REPORTS[name](order_line_model(spark, small)).inputFiles()
    assert files and not [f for f in files if "/cases-" in f or "lineitem" in f]


def final_lines(plan: str) -> list[str]:
    """Lines of an adaptive plan without the initial plans, those of subqueries included."""
    kept, skip = [], None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :|+-*"))
        if skip is not None and depth >= skip:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return kept


@pytest.mark.parametrize("name", ["vendor_ranking", "spend_area_ranking", "company_ranking"])
def test_ranking_scans_the_cases_once(spark, small, name):
    """All uses of the segment counts, the total included, read the same shuffle of one scan."""
    df = REPORTS[name](order_line_model(spark, small)).select("*")
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    lines = final_lines(execution.executedPlan().toString())
    scans = [line for line in lines if "FileScan parquet" in line and "PO_day" in line]
    reused = sum("ReusedExchange" in line for line in lines)
    assert reused and len(scans) == 1


@pytest.mark.parametrize("name", ["sla_distribution", "sla_monthly_open", "primary_issue_share"])
def test_small_reports_sort_without_a_range_shuffle(spark, small, name):
    text = plan(REPORTS[name](order_line_model(spark, small)))
    assert "rangepartitioning" not in text


def test_drill_down_broadcasts_only_the_top_segments(spark, small):
    text = plan(REPORTS["vendor_stage_duration"](order_line_model(spark, small)))
    assert "TakeOrderedAndProject" in text
    assert "SortMergeJoin" not in text


def test_building_a_model_from_a_core_table_needs_no_collect(spark, log):
    log.case("A", PO="2018-07-01", CI="2018-07-09")
    m = build_model(log.star())
    assert m.as_of_row.columns == ["As_of_Date"]


@pytest.mark.parametrize("name", ["vendor_pareto", "vendor_bottleneck"])
def test_ranged_reports_read_the_ranges_alone(spark, small, name):
    """The ranked or counted rows are written once with their ranges; the sums scan neither cases nor counts again."""
    df = REPORTS[name](order_line_model(spark, small))
    text = plan(df)
    assert "_range" in text and "PO_day" not in text and "rangepartitioning(_range" not in text
