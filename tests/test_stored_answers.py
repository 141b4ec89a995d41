"""What is stored so that views read less: cubes, trigrams, champions, and tables of
a run that broke."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from learnlens.operators import panels as P
from learnlens.operators import search as search_module
from learnlens.operators import views as V
from learnlens.operators.recommend import recommendations_filtered
from learnlens.operators.search import grams_of, search, trigram_index
from learnlens.params import DEFAULTS
from learnlens.plans import dashboard as D
from learnlens.session import stored
from learnlens.sources.testdata import training_tables

SF = "/root/testdata/sf0.001"


def files_of(df) -> set[str]:
    return {f.rsplit("/", 2)[-2].rsplit("-", 1)[0] for f in df.inputFiles()}


@pytest.fixture(scope="module")
def dash(spark):
    d = D.build_dashboard(training_tables(spark, SF), index=True)
    yield d
    d.close()


def test_cards_of_every_state_without_a_keyword(spark, dash):
    """All thresholds with all tags, and all categories, against the direct query."""
    ce, risk = (spark.createDataFrame(x.collect(), x.schema) for x in (dash.course_effect, dash.learner_risk))
    local = {"ce": ce.cache(), "risk": risk.cache()}
    tags = [None, "no such tag", *sorted(r.tag for r in ce.select("tag").distinct().collect())]
    categories = [None, "no such category", *sorted(r.category for r in ce.select("category").distinct().collect())]
    states = [(None, t, s) for t in tags for s in DEFAULTS.risk_steps] + [(c, t, 38.0) for c in categories for t in tags[:4]]
    names = ["student_count", "course_count", "avg_score", "avg_progress", "total_study_hours", "pass_rate", "risk_count"]
    parts = {"cube": [], "plain": []}
    for i, (c, t, s) in enumerate(states):
        courses, risks = V.filter_courses(local["ce"], c, t), V.filter_risks(local["risk"], t, s, " ")
        values = D.cubes.card_values(dash.course_cube, dash.risk_cube, dash.learners, c, t, s)
        for kind, df in (("cube", V.rounded_cards(values)), ("plain", V.metric_cards(courses, risks, dash.learners))):
            parts[kind].append(df.select(F.lit(i).alias("i"), *names))
    found = {}
    for kind, dfs in parts.items():
        for k in range(0, len(dfs), 20):
            out = dfs[k]
            for df in dfs[k + 1 : k + 20]:
                out = out.unionByName(df)
            found.setdefault(kind, []).extend(tuple(r) for r in out.collect())
    assert len(found["cube"]) == len(states) >= 50 and sorted(found["cube"]) == sorted(found["plain"])


def test_a_view_without_a_keyword_counts_in_the_cubes(dash):
    view = D.filtered_view(dash, category="ASIA", tag="TAG_3", risk=45)
    for name in ("cards", "card_texts"):
        assert files_of(view[name]) == {"risk_cube", "course_cube", "learners"}
    assert "top_risk" not in files_of(view["recommendations"])
    # A threshold that the page does not offer, and a keyword, are counted among the risks.
    for other in ({"risk": 41}, {"keyword": "building"}):
        assert "top_risk" in files_of(D.filtered_view(dash, **other)["cards"])
    risks = V.filter_risks(dash.learner_risk, "TAG_3", 45, "")
    plain = recommendations_filtered(V.filter_courses(dash.course_effect, "ASIA", "TAG_3"), risks)
    assert view["recommendations"].collect() == plain.collect()


def test_cubes_of_nothing(spark, dash):
    ce, risk = dash.course_effect.limit(0), dash.learner_risk.limit(0)
    values = D.cubes.card_values(D.cubes.course_cube(ce), D.cubes.risk_cube(risk), dash.learners, "ASIA", None, 38)
    assert values.collect() == V._card_values(ce, risk, dash.learners).collect()


ROWS = [
    (1, "Ann 100%", "Org_A", "护理基础", "T1"), (2, "Bob", "Org%A", "跌倒预防", "T_1"), (3, "ann", None, "护理", "T1"),
    (4, None, "", "", ""), (5, "ab", "c", "d", "e"), (None, "Ann 100%", "x", "y", "z"), (6, "\U0001f389\U0001f389\U0001f389 aXb", "o", "c", "t"),
]
COLUMNS = ["student_name", "organization", "course_name", "tag"]


@pytest.mark.parametrize("few", [1, 1_000])
@pytest.mark.parametrize("keyword", ["ann 100%", "100%", "%", "_", "g_a", "g%a", "护理", "护理基", "预防 t_1", " ANN ", "null", "null  ", "a", "", None, "no such", "b c d", "\U0001f389\U0001f389\U0001f389", "axb", "ann 100% org_a 护理基础 t1", "ann 100% org_a 护理基础 t12"])
def test_search_by_trigrams_equals_a_scan(spark, monkeypatch, keyword, few):
    monkeypatch.setattr(search_module, "FEW", few)
    rows = stored(spark.createDataFrame(ROWS, "id long, " + ", ".join(f"{c} string" for c in COLUMNS)), "rows")
    index = stored(trigram_index(rows, "id", COLUMNS), "index")
    plain = sorted(map(str, rows.where(V.keyword_match(keyword, *COLUMNS)).collect()))
    assert sorted(map(str, search(rows, index, "id", COLUMNS, keyword).collect())) == plain
    assert search(rows.limit(0), index.limit(0), "id", COLUMNS, keyword).collect() == []


def test_the_search_reads_postings(dash, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plain = V.filter_risks(dash.learner_risk, None, 0, "building").count()
    # Few ids are named in the filter that the scan gets.
    found = D.filtered_view(dash, risk=0, keyword="building")["risks"]
    assert "In(student_id, [" in plan(found) and found.count() == plain > 0
    # More of them are joined with the postings.
    monkeypatch.setattr(search_module, "FEW", plain - 1)
    found = D.filtered_view(dash, risk=0, keyword="building")["risks"]
    assert {"index", "top_risk"} <= files_of(found)
    assert "PushedFilters: [In(gram, [bui,din,ild,ing,ldi,uil])" in plan(found) and found.count() == plain
    assert "index" not in files_of(D.filtered_view(dash, risk=0, keyword="bu")["risks"])
    assert grams_of("  aBab ") == ["aba", "bab"]


def test_champions_rank_as_the_wide_table(dash):
    lc = dash.learner_course
    for tags in (["TAG_1"], ["TAG_1", "TAG_3", "TAG_6"], []):
        plain = P.top_risk_per_learner(V.scope_teacher(lc, tags)).select(*P.RISK_COLUMNS)
        ranked = P.top_risk_per_learner(V.scope_teacher(dash.champions, tags)).select(*P.RISK_COLUMNS)
        assert sorted(map(str, plain.collect())) == sorted(map(str, ranked.collect()))


def test_champions_of_ties_and_nulls(spark):
    schema = "student_id long, tag string, course_id long, risk_score double, x int"
    rows = [(1, "a", 2, 5.0, 0), (1, "a", 1, 5.0, 1), (1, None, 9, None, 2), (1, None, 8, None, 3), (None, "a", 1, None, 4), (None, "a", 2, 0.0, 5)]
    best = {(r.student_id, r.tag): r.x for r in P.risk_champions(spark.createDataFrame(rows, schema)).collect()}
    assert best == {(1, "a"): 1, (1, None): 3, (None, "a"): 5}


def test_a_broken_run_is_taken_up_where_it_broke(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    for name, df in training_tables(spark, SF).as_dict().items():
        df.write.parquet(f"{base}/{name}")
    tables = lambda: D.Tables.from_dict({n: spark.read.parquet(f"{base}/{n}") for n in ("students", "courses", "resources", "events", "scores")})

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(D.P, "tag_weakness", broken)
    with pytest.raises(RuntimeError):
        D.build_dashboard(tables(), resume=True)
    monkeypatch.undo()
    folder = f"{D.shared_root(spark)}/learnlens/{D.run_name(tables(), DEFAULTS)}".removeprefix("file:")
    done = {n: os.stat(f"{folder}/{n}/_SUCCESS").st_mtime_ns for n in os.listdir(folder) if os.path.exists(f"{folder}/{n}/_SUCCESS")}
    assert {"learner_course", "weekly_activity", "format_usage"} <= set(done) and "tag_weakness" not in done
    # A table that was being written has no mark of success, and is written anew.
    os.makedirs(f"{folder}/tag_weakness")
    dash = D.build_dashboard(tables(), resume=True)
    after = {n: os.stat(f"{folder}/{n}/_SUCCESS").st_mtime_ns for n in os.listdir(folder)}
    assert done.items() <= after.items() and len(after) > len(done)
    plain = D.build_dashboard(tables())
    for name in plain.panels:
        assert sorted(map(str, dash.panels[name].collect())) == sorted(map(str, plain.panels[name].collect()))
    # Other parameters and other inputs have a run of their own.
    name = D.run_name(tables(), DEFAULTS)
    assert D.run_name(tables(), D.Params(pass_score=1.0)) != name
    spark.read.parquet(f"{base}/events").limit(5).write.mode("append").parquet(f"{base}/events")
    assert D.run_name(tables(), DEFAULTS) != name
    dash.close()
    plain.close()
    assert os.listdir(folder) == []


def test_tables_without_files_have_no_run(spark, micro):
    assert D.run_name(micro, DEFAULTS) is None
    D.build_dashboard(micro, resume=True).close()
