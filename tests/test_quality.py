"""Declared constraints as Spark jobs."""

from __future__ import annotations

import datetime as dt

from learnlens.operators import quality as Q


def _report(df):
    return {(r.table, r.rule, r.columns): r.violations for r in df.collect()}


def test_micro_report(micro):
    rep = _report(Q.quality_report(micro))
    assert rep[("scores", "foreign_key", "student_id->students.student_id")] == 1  # S9
    assert rep[("events", "foreign_key", "resource_id->resources.resource_id")] == 1  # R9
    assert rep[("events", "foreign_key", "course_id->courses.course_id")] == 0
    assert rep[("scores", "primary_key", "student_id,course_id")] == 0
    assert rep[("students", "not_null", "age")] == 0
    assert rep[("scores", "decimal", "final_score")] == 0
    assert rep[("scores", "decimal_scale", "final_score")] == 0


def test_orphan_rows(micro):
    rows = Q.orphan_rows(micro.scores, "student_id", micro.students, "student_id").collect()
    assert [r.student_id for r in rows] == ["S9"]


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 3)], "k string, v int")
    assert [tuple(r) for r in Q.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    got = {r.columns: r.violations for r in Q.null_violations(df, "t").collect()}
    assert got == {"k": 1, "v": 1}


def test_type_rules(spark):
    df = spark.createDataFrame(
        [
            ("x" * 17, "1000.00", "abc", "2026-02-30", 300, 1.005),
            ("ok", "999.99", "12", "2026-02-28", 1, 1.5),
            ("ok", "12.345", "99999999999", "bad", -1, 100000.0),
        ],
        "student_id string, final_score string, age string, enroll_date string, completed int, hours double",
    )
    declared = {
        "student_id": ("varchar", 16),
        "final_score": ("decimal", 5, 2),
        "age": ("int",),
        "enroll_date": ("date",),
        "completed": ("tinyint",),
        "hours": ("decimal", 5, 2),
    }
    rep = {(r.rule, r.columns): r.violations for r in Q.type_violations(df, "t", declared).collect()}
    assert rep[("varchar", "student_id")] == 1
    assert rep[("decimal", "final_score")] == 1  # 1000.00 overflows
    assert rep[("decimal_scale", "final_score")] == 1  # 12.345 is rounded by the store
    assert rep[("int", "age")] == 2  # junk and overflow
    assert rep[("date", "enroll_date")] == 2  # Feb 30 and junk
    assert rep[("tinyint", "completed")] == 1
    assert rep[("decimal", "hours")] == 1 and rep[("decimal_scale", "hours")] == 1


def test_typed_date_column_has_no_rule(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1),)], "enroll_date date")
    assert Q.type_violations(df, "students", {"enroll_date": ("date",)}).count() == 0


def test_quality_gate(micro, spark):
    import pytest

    from conftest import make_tables, micro_rows
    from learnlens.plans.gate import QualityError, quality_gate

    with pytest.raises(QualityError) as err:
        quality_gate(micro)  # S9 and R9 are orphans
    assert {(f["table"], f["rule"]) for f in err.value.failures} == {("scores", "foreign_key"), ("events", "foreign_key")}
    rows = micro_rows()
    rows["scores"] = [r for r in rows["scores"] if r[0] != "S9"]
    rows["events"] = [r for r in rows["events"] if r[3] != "R9"]
    report = quality_gate(make_tables(spark, rows))
    assert report.where("violations > 0").count() == 0
    assert quality_gate(micro, blocking=["primary_key"]).count() > 0


def test_key_report_counts(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (3, None)], "k int, g string")
    up = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    named = {"child": child, "up": up}
    rep = _report(Q.key_report(named, {"child": ["k", "g"], "up": ["k"]}, [("child", "k", "up", "k")]))
    assert rep == {
        ("child", "primary_key", "k,g"): 1,  # (null, a) twice; a null is not the text null
        ("up", "primary_key", "k"): 1,
        ("child", "foreign_key", "k->up.k"): 2,  # 2 and 3; nulls refer to nothing
    }


def test_key_report_deals_many_keys_to_tasks_by_their_number(spark, monkeypatch):
    from pyspark.sql import functions as F

    ids = spark.range(600)
    child = ids.select(
        F.when(F.col("id") < 590, F.col("id")).otherwise(F.lit(None)).alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("lost")).alias("g"),
    ).unionByName(spark.createDataFrame([(5, "hot"), (5, "hot"), (None, None)], "k long, g string"))
    up = spark.createDataFrame([("hot",), ("hot",), (None,)], "g string")
    named, rules = {"child": child, "up": up}, ({"child": ["k"], "up": ["g"]}, [("child", "g", "up", "g")])
    few = Q.key_report(named, *rules)
    monkeypatch.setattr(Q, "TASK_PAIRS", 50)
    many = Q.key_report(named, *rules)
    expected = {("child", "primary_key", "k"): 2, ("up", "primary_key", "g"): 1, ("child", "foreign_key", "g->up.g"): 200}
    assert _report(few) == _report(many) == expected
    plan = many._jdf.queryExecution().executedPlan().toString()
    # The 1,212 pairs, 1,206 of them the child's, are 25 tasks of 50 pairs: for the child's slices and for all keys.
    assert "slice" in plan and plan.count(", 25), REPARTITION_BY_NUM") >= 2


def test_joined_rows_are_dealt_by_their_number(spark, monkeypatch):
    from learnlens import session
    from learnlens.sources import testdata

    sf = "/root/testdata/sf0.001"
    makers = (testdata.events, testdata.scores)
    before = [sorted(map(str, f(spark, sf).collect())) for f in makers]
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    for f, rows in zip(makers, before):
        df = f(spark, sf)
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, df.collect())) == rows
