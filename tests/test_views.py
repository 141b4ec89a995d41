"""Filtered views: courses, tags, risks, cards, options, recommendations."""

from __future__ import annotations

import pytest

from learnlens.operators.views import filter_equals
from learnlens.params import WILDCARD
from learnlens.plans.dashboard import build_dashboard, filtered_view


@pytest.fixture(scope="module")
def dash(micro):
    d = build_dashboard(micro)
    yield d
    d.close()


def test_wildcard_view(dash):
    v = filtered_view(dash, WILDCARD, WILDCARD, 38, "")
    assert [r.course_id for r in v["courses"].collect()] == ["C2", "C1"]
    assert [r.tag for r in v["tags"].collect()] == ["T2", "T1"]
    assert [r.student_name for r in v["risks"].collect()] == ["Cy", "Bob"]
    cards = v["cards"].collect()[0]
    # unweighted mean of the per-course means: (50 + 69.33) / 2
    assert (cards.student_count, cards.course_count, cards.avg_score, cards.risk_count) == (3, 2, 59.67, 2)
    assert cards.avg_progress == 40.0 and cards.pass_rate == 58.34 and cards.total_study_hours == 2.08


def test_category_view_and_tag_semi_join(dash):
    v = filtered_view(dash, category="K2")
    assert [r.course_id for r in v["courses"].collect()] == ["C2"]
    assert [r.tag for r in v["tags"].collect()] == ["T2"]
    # category does not filter the risk list
    assert v["risks"].count() == 2


def test_chosen_tag_ignores_category(dash):
    v = filtered_view(dash, category="K2", tag="T1")
    assert v["courses"].count() == 0
    assert [r.tag for r in v["tags"].collect()] == ["T1"]
    cards = v["cards"].collect()[0]
    assert (cards.course_count, cards.avg_score, cards.pass_rate) == (0, 0.0, 0.0)


def test_risk_threshold_and_keyword(dash):
    assert filtered_view(dash, risk=0)["risks"].count() == 3
    assert filtered_view(dash, risk=48.77)["risks"].count() == 2  # rounded risk, inclusive
    assert [r.student_name for r in filtered_view(dash, risk=0, keyword="  ORGA ")["risks"].collect()] == ["Cy", "Ann"]
    assert filtered_view(dash, risk=0, keyword="basics t1")["risks"].count() == 2


def test_filtered_recommendations(dash):
    recs = filtered_view(dash)["recommendations"].collect()
    assert [r.title for r in recs] == ["加强「Falls」专项训练", "加强「Basics」专项训练", "建立高风险学员跟踪清单", "复盘资源完成率"]
    assert recs[0].detail == "该课程均分 50.0，建议增加T2案例训练、短测和课后复盘。"
    assert recs[1].detail.startswith("该课程均分 69.3，")
    assert recs[2].detail == "当前视角下有 2 名高风险学员，建议按机构、课程和标签分组补训。"
    none = filtered_view(dash, risk=99)["recommendations"].collect()
    assert [r.title for r in none][-1] == "复盘资源完成率" and len(none) == 3


def test_filter_options(dash):
    got = [tuple(r) for r in filtered_view(dash)["options"].orderBy("kind", "position").collect()]
    assert got == [("category", "K2", 1), ("category", "K1", 2), ("tag", "T2", 1), ("tag", "T1", 2)]


def test_filter_equals(dash):
    risks = dash.panels["learner_risk"]
    assert filter_equals(risks, organization="OrgA").count() == 2
    assert filter_equals(risks, organization="OrgA", tag=["T2"]).count() == 1
    assert filter_equals(risks, organization=None).count() == 3
    assert filter_equals(risks, tag=[]).count() == 0


def test_payloads(dash):
    from learnlens.plans.payload import chart_payload, dashboard_payload, to_json

    doc = dashboard_payload(dash)
    assert set(doc) == {
        "overview", "course_effect", "tag_weakness", "format_usage",
        "weekly_activity", "score_distribution", "learner_risk", "recommendations",
    }
    assert doc["overview"]["student_count"] == 3 and doc["overview"]["pass_rate"] == 60.0
    assert [r["student_name"] for r in doc["learner_risk"]] == ["Cy", "Bob", "Ann"]
    assert set(doc["recommendations"][0]) == {"title", "detail"}
    teacher = dashboard_payload(dash, "teacher", ["T2"])
    assert [r["tag"] for r in teacher["course_effect"]] == ["T2"] and len(teacher["learner_risk"]) == 1
    assert chart_payload(dash) == {"categories": ["Falls", "Basics"], "values": [50.0, 69.33]}
    assert '"优秀"' in to_json(doc)
