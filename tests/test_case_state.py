"""The state of a growing log: batches in any order give what one build gives, and touch only their buckets."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from conftest import Log, rows

from procflow.constants import P2P_STEPS
from procflow.operators.milestones import core_milestones
from procflow.plans.case_state import CaseState
from procflow.plans.model import build_model, case_table
from procflow.plans.reports import sla_distribution
from procflow.sources.staging import new_folder


def random_log(spark, n=60, seed=3):
    rng, log = random.Random(seed), Log(spark)
    for i in range(n):
        steps = {}
        for step in P2P_STEPS:
            times = [str(datetime(2018, 6, 1) + timedelta(hours=rng.randrange(3000))) for _ in range(rng.randrange(3))]
            if times:
                steps[step.name] = times
        log.case(rng.choice([f"c{i}", f"c{i % 7}"]), rng.choice([None, 1, 2]), rng.choice([1, 2]), 1, **steps)
    log.events.append((None, 1, datetime(2018, 6, 1)))
    log.cases.append((None, 1, 1, 1))
    return log


def batches_of(spark, log, n):
    out = []
    for i in range(n):
        part = Log(spark)
        part.events, part.cases = log.events[i::n], log.cases[i::n]
        out.append(part.star())
    return out


def ordered(df):
    return sorted(rows(df), key=str)


@pytest.mark.parametrize("turn", [1, -1])
def test_batches_give_what_one_build_gives(spark, turn):
    log = random_log(spark)
    state = CaseState.create(spark, new_folder(spark, "state"), buckets=5)
    parts = batches_of(spark, log, 3)[::turn]
    for part in [*parts, parts[0]]:
        state = state.add(part)
    whole = case_table(log.star())
    assert ordered(state.cases().select(*whole.columns)) == ordered(whole)
    assert ordered(sla_distribution(state.model())) == ordered(sla_distribution(build_model(log.star())))


def test_closings_of_core_tables_are_kept(spark):
    log = random_log(spark)
    star = log.star()
    star = replace(star, fact_case_milestones_core=core_milestones(star.fact_events, star.dim_activity))
    state = CaseState.create(spark, new_folder(spark, "state"), buckets=3)
    bare = replace(star, fact_case_milestones_core=None)
    state = state.add(star).add(bare)
    whole = case_table(star)
    assert ordered(state.cases().select(*whole.columns)) == ordered(whole)


def test_a_batch_rewrites_its_own_buckets_only(spark):
    log = Log(spark)
    for i in range(40):
        log.case(f"c{i}", PO="2018-07-01")
    first = CaseState.create(spark, new_folder(spark, "state"), buckets=8).add(log.star())
    one = Log(spark).case("c3", GR="2018-08-01")
    second = first.add(one.star())
    changed = set(second.places) - set(first.places)
    assert len(first.places) == 8 and len(changed) == 1
    (bucket, place), = changed
    files = spark.read.parquet(f"{second.folder}/{place}")
    assert files.select("bucket").distinct().count() == 1 and 0 < files.count() < 40
    found = {r["Case_ID"]: r for r in second.milestones().collect()}
    assert len(found) == 40 and found["c3"]["GR_ts"] == datetime(2018, 8, 1) and found["c3"]["PO_ts"] == datetime(2018, 7, 1)
    # Who opened the first version still reads it.
    assert [r["GR_ts"] for r in first.milestones().filter("Case_ID = 'c3'").collect()] == [None]


def test_a_run_that_breaks_off_leaves_no_trace(spark, monkeypatch):
    log = Log(spark).case("a", PO="2018-07-01")
    folder = new_folder(spark, "state")
    CaseState.create(spark, folder, buckets=2).add(log.star())

    def broken(self, mode="append"):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(CaseState, "_commit", broken)
        with pytest.raises(RuntimeError):
            CaseState.reopen(spark, folder).add(Log(spark).case("lost", PO="2018-07-02").star())
    again = CaseState.reopen(spark, folder)
    assert [r["Case_ID"] for r in again.milestones().collect()] == ["a"]
    grown = again.add(Log(spark).case("b", PO="2018-07-03").star())
    assert sorted(r["Case_ID"] for r in grown.milestones().collect()) == ["a", "b"]
    assert sorted(r["Case_ID"] for r in CaseState.reopen(spark, folder).milestones().collect()) == ["a", "b"]


def test_nothing_to_add(spark):
    folder = new_folder(spark, "state")
    state = CaseState.create(spark, folder, buckets=2)
    assert state.add(Log(spark).star()) == state
    with pytest.raises(ValueError, match="no batch"):
        state.milestones()
    with pytest.raises(Exception, match="exists"):
        CaseState.create(spark, folder)
