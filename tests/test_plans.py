"""Physical-plan properties the scale design relies on."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnlens.operators import panels as P
from learnlens.operators.features import learner_course
from learnlens.session import broadcast_if_small, planned_bytes
from learnlens.sources.testdata import training_tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounded_broadcast_check(spark):
    small, big = spark.range(10), spark.range(1000)
    assert planned_bytes(small) == 80 and planned_bytes(big) == 8000
    joined_small = spark.range(5000).join(broadcast_if_small(small, 1000), "id")
    joined_big = spark.range(5000).join(broadcast_if_small(big, 1000), "id")
    assert "BroadcastExchange" in plan(joined_small)
    assert "BroadcastExchange" not in plan(joined_big)  # left to shuffle join / AQE at run time


def test_wide_table_joins(spark):
    lc = learner_course(training_tables(spark, SF))
    p = plan(lc)
    # the course catalogue is broadcast (checked); learners and scores are shuffle joins
    assert p.count("BroadcastExchange") >= 1
    assert "SortMergeJoin" in p


def test_top1_is_window_group_limit(spark):
    lc = learner_course(training_tables(spark, SF))
    p = plan(P.top_risk_per_learner(lc))
    assert "WindowGroupLimit" in p


def test_risk_list_is_top_k(spark):
    lc = learner_course(training_tables(spark, SF))
    assert "TakeOrderedAndProject" in plan(P.risk_list(lc))


def test_format_usage_aggregates_before_join(spark):
    t = training_tables(spark, SF)
    p = plan(P.format_usage(t.events, t.resources))
    join_at = p.index("SortMergeJoin") if "SortMergeJoin" in p else p.index("BroadcastHashJoin")
    # an aggregate by resource_id feeds the join (printed below it)
    assert "HashAggregate(keys=[resource_id" in p[join_at:]


def test_scan_pushdown_and_pruning(spark):
    t = training_tables(spark, SF)
    df = t.events.where(F.col("device") == "R").select("student_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_returnflag:string>" in p


def test_views_and_scopes_never_scan_the_wide_table(spark):
    """Stored results serve every filter state; scope_first ranks the champions."""
    from learnlens.plans.dashboard import build_dashboard, filtered_view, scoped

    dash = build_dashboard(training_tables(spark, SF), how="table")
    try:
        results = {
            **dash.panels,
            **filtered_view(dash, category="ASIA", tag="TAG_3", risk=38, keyword="building"),
            **{f"teacher_{k}": v for k, v in scoped(dash, "teacher", ["TAG_1"]).items()},
            **{f"org_{k}": v for k, v in scoped(dash, "organization_manager", organization="BUILDING").items()},
            **{f"first_{k}": v for k, v in scoped(dash, "teacher", ["TAG_1"], scope_first=True).items()},
            **{f"org_first_{k}": v for k, v in scoped(dash, "organization_manager", organization="BUILDING", scope_first=True).items()},
        }
        for name, df in results.items():
            files = df.inputFiles()
            assert not any("/learner_course-" in f or "/root/testdata/" in f for f in files), name
    finally:
        dash.close()


def test_cap_is_only_that_of_the_served_list(spark):
    from dataclasses import replace

    from learnlens.params import DEFAULTS
    from learnlens.plans.dashboard import build_dashboard, filtered_view, scoped

    t = training_tables(spark, SF)
    dash = build_dashboard(t, replace(DEFAULTS, risk_table_limit=3))
    learners = t.scores.select("student_id").distinct().count()
    assert dash.panels["learner_risk"].count() == 3
    assert filtered_view(dash, risk=0)["risks"].count() == learners
    assert filtered_view(dash, risk=0)["cards"].first().risk_count == learners
    assert scoped(dash, "organization_manager", organization="BUILDING")["learner_risk"].count() > 3
    dash.close()


def test_closed_dashboard_leaves_no_tables(spark, tmp_path):
    import os

    from learnlens.plans.dashboard import build_dashboard
    from learnlens.session import remove_scratch, shared_root

    root = shared_root(spark).removeprefix("file:") + "/learnlens"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    dash = build_dashboard(training_tables(spark, SF))
    assert len(set(os.listdir(root)) - before) >= 8
    dash.close()
    assert set(os.listdir(root)) == before
    import pytest

    with pytest.raises(ValueError):
        remove_scratch(spark, str(tmp_path))


def test_declaring_the_wide_table_starts_no_job(spark):
    """Apart from reading Parquet footers, which happens once when the tables are opened."""
    t = training_tables(spark, SF)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("declare", "declare")
    learner_course(t)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(tracker.getJobIdsForGroup("declare")) == []


def test_quality_report_scans_each_table_twice_at_most(spark, tmp_path):
    import re

    from learnlens.operators.quality import quality_report
    from learnlens.sources.readers import load_tables

    base = str(tmp_path / "tables")
    for name, df in training_tables(spark, SF).as_dict().items():
        df.write.parquet(f"{base}/{name}.parquet")
    report = quality_report(load_tables(spark, "parquet", base))
    report.collect()
    text = plan(report).split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet.*events\.parquet", text)) <= 2


def test_overview_without_expansion(spark):
    lc = learner_course(training_tables(spark, SF))
    assert "Expand" in plan(P.overview(lc)) and "Expand" not in plan(P.overview(lc, courses=False))
    whole = P.overview(lc).first()
    assert P.with_course_count(P.overview(lc, courses=False), P.course_effect(lc)).first() == whole


def test_shared_folder_must_be_named_off_local_mode(monkeypatch):
    import pytest

    from learnlens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Connect:
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_root(Connect())
