"""Semantics that must be exact: nulls, thresholds, ties, weeks, empty input."""

from __future__ import annotations

import datetime as dt

from conftest import make_tables, micro_rows
from pyspark.sql import functions as F

from learnlens.functions.expressions import keyword_match, score_level, week_label, week_start
from learnlens.operators import panels as P
from learnlens.operators.features import learner_course
from learnlens.plans.dashboard import build_dashboard, scoped


def _with_scores(spark, scores, events=None):
    rows = micro_rows()
    rows["scores"] = scores
    if events is not None:
        rows["events"] = events
    return make_tables(spark, rows)


def test_levels_at_thresholds(spark):
    df = spark.createDataFrame([(85.0,), (84.99,), (70.0,), (69.99,), (60.0,), (59.99,), (None,)], "s double")
    got = [r[0] for r in df.select(score_level("s")).collect()]
    assert got == ["优秀", "达标", "达标", "待巩固", "待巩固", "高风险", "高风险"]


def test_null_final_score(spark):
    t = _with_scores(spark, [("S1", "C1", None, None, None, None), ("S2", "C1", 1.0, 70.0, 1.0, 1.0)])
    lc = learner_course(t)
    r = lc.where("student_id = 'S1'").collect()[0]
    assert r.score_level == "高风险"
    assert r.risk_score == 0.0  # greatest skips the null
    ov = P.overview(lc).collect()[0]
    assert ov.avg_score == 70.0  # null skipped in the average
    assert ov.pass_rate == 50.0  # null is not a pass
    tw = P.tag_weakness(lc).collect()[0]
    assert tw.weak_rate == 0.0  # null is not weak


def test_sort_after_rounding_and_tie_break(spark):
    # C1 and C2 average 70.001 and 69.999: equal once rounded, so course_id decides.
    scores = [("S1", "C2", 0.0, 69.999, 0.0, 0.0), ("S2", "C1", 0.0, 70.001, 0.0, 0.0)]
    lc = learner_course(_with_scores(spark, scores, events=[]))
    got = [r.course_id for r in P.ordered(P.course_effect(lc), "course_effect").collect()]
    assert got == ["C1", "C2"]


def test_top1_uses_raw_risk(spark):
    # S1: C1 risk 50.004, C2 risk 50.001: both round to 50.0; raw picks C1.
    scores = [("S1", "C1", 0.0, (100 - 50.004) / 0.72, 0.0, 0.0), ("S1", "C2", 0.0, (100 - 50.001) / 0.72, 0.0, 0.0)]
    lc = learner_course(_with_scores(spark, scores, events=[]))
    top = P.top_risk_per_learner(lc).collect()
    assert len(top) == 1 and top[0].course_name == "Basics" and top[0].risk_score == 50.0


def test_week_labels(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 4, 5),), (dt.date(2026, 4, 6),)], "d date")
    got = [tuple(r) for r in df.select(week_label("d"), week_start("d")).collect()]
    assert got == [("12-29", dt.date(2025, 12, 29)), ("03-30", dt.date(2026, 3, 30)), ("04-06", dt.date(2026, 4, 6))]


def test_weekly_by_label_merges_years(spark):
    ev = [
        ("E1", "S1", "C1", "R1", dt.date(2025, 3, 31), 60, 50, 0, "pc"),  # Monday 03-31 of 2025
        ("E2", "S2", "C1", "R1", dt.date(2031, 3, 31), 60, 50, 0, "pc"),  # Monday 03-31 of 2031
    ]
    t = _with_scores(spark, micro_rows()["scores"], events=ev)
    by_label = P.weekly_activity(t.events).collect()
    by_date = P.weekly_activity_by_date(t.events).collect()
    assert [(r.week, r.events, r.active_students) for r in by_label] == [("03-31", 2, 2)]
    assert len(by_date) == 2


def test_empty_input_overview(spark):
    t = _with_scores(spark, [], events=[])
    ov = P.overview(learner_course(t)).collect()
    assert len(ov) == 1
    r = ov[0]
    assert (r.student_count, r.course_count, r.risk_records) == (0, 0, None)
    assert r.avg_score is None and r.total_study_hours is None


def test_keyword_is_literal(spark):
    df = spark.createDataFrame(
        [("Ann", "Org_A", "C", "T"), ("Bob", "OrgXA", "C", "T"), ("Cy", "50% org", "C", "T")],
        "student_name string, organization string, course_name string, tag string",
    )
    cols = ("student_name", "organization", "course_name", "tag")
    assert [r[0] for r in df.where(keyword_match("org_a", *cols)).collect()] == ["Ann"]
    assert [r[0] for r in df.where(keyword_match(" 50% ", *cols)).collect()] == ["Cy"]
    assert df.where(keyword_match("   ", *cols)).count() == 3
    # words are joined by single spaces: "ann org_a" matches across columns
    assert df.where(keyword_match("ANN ORG_A", *cols)).count() == 1


def test_scope_after_top1_vs_scope_first(micro):
    d = build_dashboard(micro)
    try:
        # Ann's riskiest course is Basics (T1); a T2 teacher does not see her.
        after = scoped(d, "teacher", allowed_tags=["T2"])["learner_risk"].collect()
        first = scoped(d, "teacher", allowed_tags=["T2"], scope_first=True)["learner_risk"].collect()
        assert [r.student_name for r in after] == ["Cy"]
        assert sorted(r.student_name for r in first) == ["Bob", "Cy"]
        org = scoped(d, "organization_manager", organization="OrgA")
        assert sorted(r.student_name for r in org["learner_risk"].collect()) == ["Ann", "Cy"]
        assert org["course_effect"].count() == 2  # global for managers
        admin = scoped(d, "admin")
        assert admin["learner_risk"].count() == 3
        none_org = scoped(d, "organization_manager", organization=None)
        assert none_org["learner_risk"].count() == 3  # None means no filter
        assert scoped(d, "teacher", allowed_tags=[])["learner_risk"].count() == 0
    finally:
        d.close()


def test_unknown_resource_only_leaves_format_usage(micro):
    fu = P.format_usage(micro.events, micro.resources).agg(F.sum("views")).collect()[0][0]
    assert fu == 5  # E5 (R9) is dropped
    assert micro.events.count() == 6


def test_results_do_not_depend_on_session_time_zone(spark, micro):
    def snapshot():
        d = build_dashboard(micro, how="none")
        return {n: [tuple(r) for r in df.collect()] for n, df in d.panels.items()}

    base = snapshot()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Los_Angeles", "Asia/Shanghai", "Pacific/Kiritimati"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            assert snapshot() == base, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_format_usage_null_progress(spark):
    ev = [
        ("E1", "S1", "C1", "R1", dt.date(2026, 4, 1), 30, None, 1, "pc"),
        ("E2", "S1", "C1", "R1", dt.date(2026, 4, 2), 20, 40, 0, "pc"),
        ("E3", "S2", "C1", "R2", dt.date(2026, 4, 3), 10, None, 0, "pc"),
    ]
    t = _with_scores(spark, micro_rows()["scores"], events=ev)
    got = {r.format: (r.views, r.completed, r.avg_progress, r.completion_rate) for r in P.format_usage(t.events, t.resources).collect()}
    assert got == {"video": (2, 1, 40.0, 50.0), "quiz": (1, 0, None, 0.0)}


def test_weekly_null_date(spark):
    ev = [
        ("E1", "S1", "C1", "R1", None, 30, 50, 1, "pc"),
        ("E2", "S2", "C1", "R1", dt.date(2026, 4, 6), 30, 50, 1, "pc"),
    ]
    t = _with_scores(spark, micro_rows()["scores"], events=ev)
    got = sorted((r.week is None, r.events) for r in P.weekly_activity(t.events).collect())
    assert got == [(False, 1), (True, 1)]
    assert sorted(r.week_start is None for r in P.weekly_activity_by_date(t.events).collect()) == [False, True]
