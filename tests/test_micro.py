"""The MICRO fixture: every panel against hand-checked expected rows."""

from __future__ import annotations

import datetime as dt

import pytest

from learnlens.operators import panels as P
from learnlens.operators.features import learner_course
from learnlens.plans.dashboard import build_dashboard, skill_scores


@pytest.fixture(scope="module")
def dash(micro):
    d = build_dashboard(micro)
    yield d
    d.close()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_learner_course(micro):
    lc = learner_course(micro).orderBy("student_id", "course_id")
    got = [
        (r.student_id, r.course_id, r.study_minutes, r.completed_resources, r.accessed_resources, r.avg_progress,
         r.last_event_date, r.score_level, round(r.risk_score, 4))
        for r in lc.collect()
    ]
    assert got == [
        ("S1", "C1", 50, 2, 2, 95.0, dt.date(2026, 4, 6), "优秀", 15.3733),
        ("S2", "C1", 10, 0, 1, 40.0, dt.date(2026, 4, 5), "高风险", 48.7739),
        ("S2", "C2", 60, 0, 1, 50.0, dt.date(2026, 4, 7), "达标", 35.6),
        ("S3", "C1", 0, 0, 0, 0.0, None, "待巩固", 56.8),
        ("S3", "C2", 5, 0, 1, 20.0, dt.date(2026, 4, 6), "高风险", 74.3833),
    ]


def test_overview(dash):
    assert rows(dash.panels["overview"]) == [(3, 2, 61.6, 41.0, 2.08, 60.0, 3)]


def test_course_effect(dash):
    assert rows(dash.panels["course_effect"]) == [
        ("C2", "Falls", "K2", "T2", 2, 50.0, 35.0, 65, 50.0),
        ("C1", "Basics", "K1", "T1", 3, 69.33, 45.0, 60, 66.67),
    ]


def test_tag_weakness(dash):
    assert rows(dash.panels["tag_weakness"]) == [("T2", 2, 50.0, 50.0), ("T1", 3, 69.33, 33.33)]


def test_format_usage(dash):
    assert rows(dash.panels["format_usage"]) == [("video", 4, 2, 55.0, 50.0), ("quiz", 1, 1, 100.0, 100.0)]


def test_weekly_activity(dash):
    assert rows(dash.panels["weekly_activity"]) == [("03-30", 0.67, 2, 2), ("04-06", 1.62, 3, 4)]


def test_score_distribution(dash):
    assert rows(dash.panels["score_distribution"]) == [("优秀", 1), ("达标", 1), ("待巩固", 1), ("高风险", 2)]


def test_learner_risk(dash):
    assert rows(dash.panels["learner_risk"]) == [
        ("Cy", "OrgA", "Falls", "T2", 30.0, 20.0, 5, 74.38),
        ("Bob", "OrgB", "Basics", "T1", 59.99, 40.0, 10, 48.77),
        ("Ann", "OrgA", "Basics", "T1", 88.0, 95.0, 50, 15.37),
    ]


def test_skill_scores(dash):
    r = skill_scores(dash).collect()[0]
    assert (list(r.categories), list(r["values"])) == (["Falls", "Basics"], [50.0, 69.33])


def test_recommendations(dash):
    got = rows(dash.panels["recommendations"])
    assert [r[0] for r in got] == [1, 2, 3, 4]
    assert got[0][1] == "加强「Falls」专项训练"
    assert got[0][2] == "该课程平均成绩偏低，建议增加T2情境案例、短测验和课后复盘任务。"
    assert got[1][1] == "加强「Basics」专项训练"
    assert got[2][1] == "对高风险学员建立跟踪清单"
    assert got[3][1] == "优化课程资源格式组合"


def test_overview_hours_differ_from_weekly(dash):
    """E6 has no score: out of the overview hours, in the weekly hours."""
    weekly = sum(r.study_hours for r in dash.panels["weekly_activity"].collect())
    assert dash.panels["overview"].collect()[0].total_study_hours == 2.08
    assert round(weekly, 2) == 2.29


def test_panels_read_stored_results(dash):
    for name, df in dash.panels.items():
        assert not any("learner_course" in f or "lineitem" in f for f in df.inputFiles()), name


def test_risk_list_cap(micro):
    lc = learner_course(micro)
    assert P.risk_list(lc, limit=2).count() == 2
    assert P.risk_list(lc, limit=0).count() == 3
