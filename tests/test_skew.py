"""One learner holding a third of all events: results stay whole and exact.

The skewed events are derived from the sf0.001 test tables; the check is a
brute-force pandas computation over the same rows.
"""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from learnlens.operators import panels as P
from learnlens.operators.features import learner_course, pair_features
from learnlens.sources.testdata import training_tables
from learnlens.tables import Tables

SF = "/root/testdata/sf0.001"
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark):
    t = training_tables(spark, SF)
    ev = t.events.withColumn(
        "student_id", F.when(F.xxhash64("event_id", "resource_id") % 3 == 0, F.lit(HOT).cast("bigint")).otherwise(F.col("student_id"))
    )
    return Tables(t.students, t.courses, t.resources, ev, t.scores)


def test_hot_learner_share(skewed):
    n = skewed.events.count()
    hot = skewed.events.where(F.col("student_id") == HOT).count()
    assert hot >= n / 4


def test_pair_features_exact(skewed):
    got = pair_features(skewed.events).toPandas().sort_values(["student_id", "course_id"]).reset_index(drop=True)
    ev = skewed.events.toPandas()
    want = (
        ev.groupby(["student_id", "course_id"])
        .agg(
            study_minutes=("duration_minutes", "sum"),
            completed_resources=("completed", "sum"),
            accessed_resources=("resource_id", "nunique"),
            avg_progress=("progress_percent", "mean"),
            last_event_date=("event_date", "max"),
        )
        .reset_index()
        .sort_values(["student_id", "course_id"])
        .reset_index(drop=True)
    )
    assert len(got) == len(want)
    for c in ["student_id", "course_id", "study_minutes", "completed_resources", "accessed_resources"]:
        assert (got[c].astype("int64") == want[c].astype("int64")).all(), c
    assert ((got.avg_progress - want.avg_progress).abs() < 1e-9).all()
    assert (pd.to_datetime(got.last_event_date) == pd.to_datetime(want.last_event_date)).all()


def test_weekly_exact(skewed):
    got = {r.week: (r.active_students, r.events) for r in P.weekly_activity(skewed.events).collect()}
    ev = skewed.events.select("student_id", "event_date").toPandas()
    d = pd.to_datetime(ev.event_date)
    monday = d - pd.to_timedelta(d.dt.weekday, unit="D")
    ev["week"] = monday.dt.strftime("%m-%d")
    want = {w: (g.student_id.nunique(), len(g)) for w, g in ev.groupby("week")}
    assert got == want


def test_top1_exact(skewed):
    lc = learner_course(skewed)
    top = {r.student_id: r.course_name for r in P.top_risk_per_learner(lc).collect()}
    pdf = lc.select("student_id", "course_id", "course_name", "risk_score").toPandas()
    pdf = pdf.sort_values(["student_id", "risk_score", "course_id"], ascending=[True, False, True])
    want = dict(pdf.groupby("student_id").head(1)[["student_id", "course_name"]].itertuples(index=False))
    assert top == want


def test_approx_distinct_opt_in(spark):
    from dataclasses import replace

    from learnlens.params import DEFAULTS

    t = training_tables(spark, "/root/testdata/sf0.01")
    exact = {r.week: r.active_students for r in P.weekly_activity(t.events).collect()}
    approx = {r.week: r.active_students for r in P.weekly_activity(t.events, replace(DEFAULTS, approx_distinct_rsd=0.01)).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[w] - exact[w]) <= max(3, 0.05 * exact[w]) for w in exact)
    assert "count(distinct" in P.weekly_activity(t.events)._jdf.queryExecution().optimizedPlan().toString()
    plan = P.weekly_activity(t.events, replace(DEFAULTS, approx_distinct_rsd=0.01))._jdf.queryExecution().optimizedPlan().toString()
    assert "approx_count_distinct" in plan
