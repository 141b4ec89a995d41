"""Registered queries: one per operator of the inventory, over the test tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose work
grows with the given tables. Filter states used by the view queries are
fixed here, next to the queries that use them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.functions.expressions import (
    conditional_count,
    conditional_rate,
    fixed_text,
    grouped_number,
    percent_text,
    round_columns,
    week_label,
    week_start,
)
from learnlens.operators import cubes, distinct
from learnlens.operators import panels as P
from learnlens.operators import quality as Q
from learnlens.operators import views as V
from learnlens.operators.features import join_courses, learner_course, null_fill, pair_features, scored_features
from learnlens.operators.recommend import recommendations, recommendations_filtered
from learnlens.operators.search import trigram_index
from learnlens.params import DEFAULTS
from learnlens.plans import refresh
from learnlens.schemas import FOREIGN_KEYS
from learnlens.session import scratch_path, stored
from learnlens.sources import keyed, publications, readers, writers
from learnlens.sources import testdata as TD
from learnlens.tables import Tables

# Filter states of the view queries (test-table values).
TEACHER_TAGS = ["TAG_1", "TAG_3", "TAG_6"]
ORGANIZATION = "BUILDING"
VIEW_CATEGORY = "ASIA"
VIEW_RISK = 45.0
VIEW_KEYWORD = "  Machinery "
LITERAL_KEYWORD = "tag_1"
CHOSEN_TAG = "TAG_0"
NO_RISK_THRESHOLD = 100.01  # above the largest possible risk score (100)
REC_VIEW = {"category": "EUROPE", "tag": None, "risk": 45.0, "keyword": ""}

Query = Callable[[SparkSession, str], DataFrame]


def tables(spark: SparkSession, sf: str) -> Tables:
    return TD.training_tables(spark, sf)


def lc(spark: SparkSession, sf: str) -> DataFrame:
    return learner_course(tables(spark, sf))


def ce(spark: SparkSession, sf: str) -> DataFrame:
    return P.course_effect(lc(spark, sf))


def top(spark: SparkSession, sf: str) -> DataFrame:
    return P.top_risk_per_learner(lc(spark, sf))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sources and sinks -------------------------------------------------------


def q_csv_scan(spark, sf):
    """The files' columns are in another order than the schema's, and one more."""
    scores = TD.scores(spark, sf)
    published = scores.select("final_score", F.lit("x").alias("note"), *[c for c in scores.columns if c != "final_score"][::-1])
    path = publications.publish_files(published, scratch_path(spark, "scores_csv"))
    return readers.read_csv(spark, path, scores.schema)


def q_fs_uri_scan(spark, sf):
    students = TD.students(spark, sf)
    base = scratch_path(spark, "fs")
    publications.publish_files(students, readers.table_uri(base, "students"))
    return readers.read_csv(spark, readers.table_uri(base, "students"), students.schema)


def q_publish_files(spark, sf):
    events = TD.events(spark, sf)
    uri = scratch_path(spark, "events_csv")
    publications.publish_files(TD.students(spark, sf), uri)  # an older publication, replaced below
    publications.publish_files(events, uri)
    return readers.read_csv(spark, uri, events.schema)


def q_normalize_types(spark, sf):
    t = tables(spark, sf)
    return readers.normalize_types(scored_features(t.events, t.scores))


def q_load_tables(spark, sf):
    base = scratch_path(spark, "tables")
    for name, df in tables(spark, sf).as_dict().items():
        df.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    loaded = readers.load_tables(spark, "PARQUET", base)
    return union_all([column_totals(df, n) for n, df in loaded.as_dict().items()])


def column_totals(df: DataFrame, name: str) -> DataFrame:
    """(table, column, rows, filled, total): per column the non-null cells and the
    sum of the numbers, of the days since 2000 or of the texts' lengths."""
    kinds = dict(df.dtypes)

    def number(c: str):
        if kinds[c] == "string":
            return F.length(c)
        return F.date_diff(F.col(c), F.lit("2000-01-01").cast("date")) if kinds[c] == "date" else F.col(c)

    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.round(F.sum(number(c).cast("double")), 2).alias("total")) for c in df.columns]
    wide = df.agg(F.count("*").alias("rows"), F.array(*aggs).alias("a"))
    return wide.select(F.lit(name).alias("table"), "rows", F.inline("a"))


def q_upsert_by_key(spark, sf):
    orders = TD.read_raw(spark, sf, "orders")
    key = [F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % TD.SCORE_COURSES).cast("int").alias("course_id")]
    target = orders.where(F.col("o_orderstatus") != "F").groupBy(*key).agg(
        (F.max("o_totalprice") / 5000).alias("final_score")
    )
    incoming = orders.where(F.col("o_orderstatus") == "F").select(
        *key, (F.col("o_totalprice") / 5000).alias("final_score"), "o_orderdate", "o_orderkey"
    )
    return writers.upsert_by_key(target, incoming, ["student_id", "course_id"], ["o_orderdate", "o_orderkey"])


def q_upsert_stored(spark, sf):
    """A stored table of scores, updated in place by two batches."""
    orders = TD.read_raw(spark, sf, "orders").withColumns({
        "student_id": F.col("o_custkey"), "course_id": (F.col("o_orderkey") % TD.SCORE_COURSES).cast("int"),
        "final_score": F.col("o_totalprice") / 5000,
    })
    keys, order = ["student_id", "course_id"], ["o_orderdate", "o_orderkey"]
    batch = lambda status: orders.where(F.col("o_orderstatus") == status).select(*keys, "final_score", *order)
    path = scratch_path(spark, "scores_keyed")
    keyed.write_keyed(writers.latest_by_key(batch("O"), keys, order).select(*keys, "final_score"), path, keys, parts=16)
    for status in ("F", "P"):
        keyed.upsert_keyed(spark, path, batch(status), keys, order, parts=16)
    return keyed.read_keyed(spark, path)


def q_rows_to_json(spark, sf):
    return writers.rows_to_json(ce(spark, sf).select(
        "course_id", "course_name", "category", "tag", "learners", "avg_score", "avg_progress", "study_minutes", "pass_rate"
    ))


# --- data quality ------------------------------------------------------------


def q_dq_primary_key(spark, sf):
    return Q.duplicate_keys(TD.events(spark, sf), ["event_id"])


def q_dq_not_null(spark, sf):
    t = tables(spark, sf)
    named = {**t.as_dict(), "features": scored_features(t.events, t.scores)}
    return union_all([Q.null_violations(df, name) for name, df in named.items()])


# Parents that know only a part of the children's keys.
MORE_REFERENCES = (
    ("documents", "doc_id", "labels", "doc_id"),
    ("pages", "page_id", "labels", "doc_id"),
    ("labels", "doc_id", "pages", "page_id"),
)


def q_dq_foreign_key(spark, sf):
    named = {**tables(spark, sf).as_dict(), **{n: TD.read_raw(spark, sf, n) for n in ("documents", "pages", "labels")}}
    return Q.key_report(named, references=(*FOREIGN_KEYS, *MORE_REFERENCES))


# Declarations that the test texts break, as typed columns and as text cells of a CSV file.
DOCUMENT_TYPES = {
    "doc_id": ("int",), "text": ("varchar", 1000), "lang": ("varchar", 1), "source": ("date",), "n_chars": ("tinyint",),
}
CELL_TYPES = {"doc_id": ("tinyint",), "lang": ("int",), "source": ("date",), "n_chars": ("decimal", 3, 0)}


def q_dq_types(spark, sf):
    docs = TD.read_raw(spark, sf, "documents")
    cells = docs.select(*CELL_TYPES)
    path = publications.publish_files(cells, scratch_path(spark, "cells_csv"))
    as_text = readers.read_csv(spark, path, cells.schema, as_text=True)
    parts = [Q.type_violations(df, name) for name, df in tables(spark, sf).as_dict().items()]
    return union_all([*parts, Q.type_violations(docs, "documents", DOCUMENT_TYPES), Q.type_violations(as_text, "cells", CELL_TYPES)])


def q_dq_offending_rows(spark, sf):
    docs = TD.read_raw(spark, sf, "documents")
    cells = docs.select(*CELL_TYPES)
    path = publications.publish_files(cells, scratch_path(spark, "cells_csv"))
    as_text = readers.read_csv(spark, path, cells.schema, as_text=True)
    t = tables(spark, sf)
    features = scored_features(t.events, t.scores)
    not_null = {c: ("varchar", 64) for c in ("last_event_date", "study_minutes")}
    return union_all([
        Q.offending_cells(docs, "documents", ["doc_id"], DOCUMENT_TYPES),
        Q.offending_cells(as_text, "cells", ["doc_id"], CELL_TYPES),
        Q.offending_cells(features, "features", ["student_id", "course_id"], not_null),
    ])


def q_dq_report(spark, sf):
    return Q.quality_report(tables(spark, sf))


# --- features, wide table, scalar expressions -------------------------------


def q_pair_features(spark, sf):
    return pair_features(TD.events(spark, sf))


def q_right_join_features(spark, sf):
    t = tables(spark, sf)
    return scored_features(t.events, t.scores)


def q_null_fill(spark, sf):
    t = tables(spark, sf)
    joined = pair_features(t.events).join(t.scores, ["student_id", "course_id"], "right")
    return null_fill(joined)


def q_inner_join_courses(spark, sf):
    t = tables(spark, sf)
    return join_courses(t.scores, t.courses)


def q_learner_course(spark, sf):
    return lc(spark, sf)


def q_score_level(spark, sf):
    return lc(spark, sf).select("student_id", "course_id", "final_score", "score_level")


def q_risk_score(spark, sf):
    return lc(spark, sf).select("student_id", "course_id", "risk_score")


def q_round_columns(spark, sf):
    out = lc(spark, sf).select("student_id", "course_id", "final_score", "avg_progress", "risk_score")
    return round_columns(out, ["final_score", "avg_progress", "risk_score"])


def q_project_risk_columns(spark, sf):
    return P.risk_rows(lc(spark, sf), DEFAULTS, "student_id", "course_id")


def q_week_label(spark, sf):
    ev = TD.events(spark, sf)
    return ev.select("event_date", week_start("event_date").alias("week_start"), week_label("event_date").alias("week")).distinct()


def q_display_formats(spark, sf):
    return ce(spark, sf).select(
        "course_id",
        grouped_number("learners").alias("learners_text"),
        grouped_number("study_minutes").alias("minutes_text"),
        fixed_text("avg_score", 2).alias("score_text"),
        percent_text("avg_progress").alias("progress_text"),
        percent_text("pass_rate").alias("pass_rate_text"),
    )


# --- panels ------------------------------------------------------------------


def q_overview(spark, sf):
    return P.overview(lc(spark, sf))


def q_overview_dashboard(spark, sf):
    """As the dashboard ships it: learners' part, course count from the course panel."""
    base = lc(spark, sf)
    return P.with_course_count(P.overview(base, courses=False), P.course_effect(base))


def q_overview_merged(spark, sf):
    """Learners are numbered in two steps, as two loads would."""
    base = lc(spark, sf)
    students = TD.students(spark, sf).select("student_id")
    first = distinct.numbered(students.where(F.col("student_id") % 2 == 0))
    learners = distinct.numbered(students, known=first)
    return P.overview_merged(base, learners, distinct.numbered(base.select("course_id")))


def q_course_effect(spark, sf):
    return P.ordered(ce(spark, sf), "course_effect")


def q_tag_weakness(spark, sf):
    return P.ordered(P.tag_weakness(lc(spark, sf)), "tag_weakness")


def q_format_usage(spark, sf):
    t = tables(spark, sf)
    return P.ordered(P.format_usage(t.events, t.resources), "format_usage")


def q_weekly_activity(spark, sf):
    return P.ordered(P.weekly_activity(TD.events(spark, sf)), "weekly_activity")


def q_weekly_activity_by_date(spark, sf):
    return P.ordered(P.weekly_activity_by_date(TD.events(spark, sf)), "weekly_activity_by_date")


# Events of the first load; later ones come as two batches, the second one twice.
FIRST_LOAD_TO, SECOND_TO = "1995-01-01", "1997-01-01"


def refreshed(spark, sf) -> dict[str, DataFrame]:
    events = TD.events(spark, sf)
    day = F.col("event_date")
    uri = scratch_path(spark, "event_states")
    refresh.add_events(spark, uri, events.where(day < FIRST_LOAD_TO), "first")
    refresh.add_events(spark, uri, events.where((day >= FIRST_LOAD_TO) & (day < SECOND_TO)), "second")
    for _ in range(2):
        refresh.add_events(spark, uri, events.where((day >= SECOND_TO) | day.isNull()), "third")
    return refresh.states(spark, uri)


def q_pair_features_refreshed(spark, sf):
    return refresh.pair_features(refreshed(spark, sf)["resources"])


def q_format_usage_refreshed(spark, sf):
    return P.ordered(refresh.format_usage(refreshed(spark, sf)["resources"], tables(spark, sf).resources), "format_usage")


def q_weekly_activity_refreshed(spark, sf):
    return P.ordered(refresh.weekly_activity(refreshed(spark, sf)["weeks"]), "weekly_activity")


def q_score_distribution(spark, sf):
    return P.ordered(P.score_distribution(lc(spark, sf)), "score_distribution")


def q_conditional_count(spark, sf):
    return lc(spark, sf).groupBy("course_id").agg(
        conditional_count(F.col("risk_score") >= DEFAULTS.risk_threshold).alias("risk_records")
    )


def q_conditional_rate(spark, sf):
    return lc(spark, sf).groupBy("tag").agg(
        F.round(conditional_rate(F.col("final_score") >= DEFAULTS.pass_score), 2).alias("pass_rate")
    )


def q_skill_scores(spark, sf):
    return P.skill_scores(ce(spark, sf))


def q_top_risk_per_learner(spark, sf):
    return top(spark, sf)


def q_sort_multi_key(spark, sf):
    return P.with_position(P.tag_weakness(lc(spark, sf)), P.ORDER["tag_weakness"](DEFAULTS))


def q_ordinal_sort(spark, sf):
    return P.with_position(P.score_distribution(lc(spark, sf)), P.ORDER["score_distribution"](DEFAULTS))


def q_risk_list(spark, sf):
    capped = P.risk_list(lc(spark, sf))
    return P.with_position(capped, P.ORDER["learner_risk"](DEFAULTS)).select(*P.RISK_COLUMNS, "position")


def q_risk_list_all(spark, sf):
    """The list without a cap: a position for every learner."""
    return P.risk_positions(top(spark, sf)).select("student_id", *P.RISK_COLUMNS, "position")


def q_weakest_courses(spark, sf):
    weak = P.weakest_courses(ce(spark, sf), DEFAULTS.weak_courses)
    return P.with_position(weak, P.ORDER["course_effect"](DEFAULTS))


def q_recommendations(spark, sf):
    return recommendations(ce(spark, sf))


def q_recommendations_filtered(spark, sf):
    courses = V.filter_courses(ce(spark, sf), REC_VIEW["category"], REC_VIEW["tag"])
    risks = V.filter_risks(top(spark, sf), REC_VIEW["tag"], REC_VIEW["risk"], REC_VIEW["keyword"])
    return recommendations_filtered(courses, risks)


def q_recommendations_filtered_no_risk(spark, sf):
    """No filtered risk row reaches the threshold: the risk row is left out."""
    courses = V.filter_courses(ce(spark, sf), REC_VIEW["category"], REC_VIEW["tag"])
    risks = V.filter_risks(top(spark, sf), REC_VIEW["tag"], NO_RISK_THRESHOLD, "")
    return recommendations_filtered(courses, risks)


# --- views and scopes --------------------------------------------------------


def q_filter_equals(spark, sf):
    return V.filter_equals(top(spark, sf), organization=ORGANIZATION, tag=TEACHER_TAGS, course_name=None)


def q_filter_courses(spark, sf):
    return V.filter_courses(ce(spark, sf), VIEW_CATEGORY, DEFAULTS.wildcard)


def q_filter_tags(spark, sf):
    base = lc(spark, sf)
    courses = V.filter_courses(P.course_effect(base), VIEW_CATEGORY, None)
    return V.filter_tags(P.tag_weakness(base), courses, None)


def q_filter_tags_chosen(spark, sf):
    """J5's other branch: a chosen tag shows whatever the category (here a
    tag with no course in the chosen category)."""
    base = lc(spark, sf)
    courses = V.filter_courses(P.course_effect(base), VIEW_CATEGORY, CHOSEN_TAG)
    return V.filter_tags(P.tag_weakness(base), courses, CHOSEN_TAG)


def q_filter_risks(spark, sf):
    return V.filter_risks(top(spark, sf), None, VIEW_RISK, VIEW_KEYWORD).select(*P.RISK_COLUMNS)


def q_keyword_search(spark, sf):
    return V.filter_risks(top(spark, sf), None, 0.0, LITERAL_KEYWORD)


def q_keyword_search_indexed(spark, sf):
    """The same search by way of the stored trigrams."""
    risks = stored(top(spark, sf), "risks")
    index = stored(trigram_index(risks, "student_id", V.SEARCHED), "trigrams")
    return V.search_risks(risks, index, None, 0.0, LITERAL_KEYWORD)


def q_risk_cube(spark, sf):
    return cubes.risk_cube(top(spark, sf))


def q_course_cube(spark, sf):
    return round_columns(cubes.course_cube(ce(spark, sf)), list(cubes.MEANS))


def q_metric_cards_from_cubes(spark, sf):
    base = lc(spark, sf)
    ov = P.overview(base, courses=False)
    values = cubes.card_values(cubes.course_cube(P.course_effect(base)), cubes.risk_cube(P.top_risk_per_learner(base)), ov, VIEW_CATEGORY)
    return V.rounded_cards(values)


def q_metric_cards(spark, sf):
    base = lc(spark, sf)
    courses = V.filter_courses(P.course_effect(base), VIEW_CATEGORY, None)
    risks = V.filter_risks(P.top_risk_per_learner(base), None, DEFAULTS.risk_threshold, "")
    return V.metric_cards(courses, risks, P.overview(base))


def q_metric_cards_no_course(spark, sf):
    """Cards of a state no course matches: course cards fall back to 0."""
    base = lc(spark, sf)
    courses = V.filter_courses(P.course_effect(base), VIEW_CATEGORY, CHOSEN_TAG)
    risks = V.filter_risks(P.top_risk_per_learner(base), CHOSEN_TAG, DEFAULTS.risk_threshold, "")
    return V.metric_cards(courses, risks, P.overview(base))


def q_card_texts(spark, sf):
    base = lc(spark, sf)
    courses = V.filter_courses(P.course_effect(base), VIEW_CATEGORY, None)
    risks = V.filter_risks(P.top_risk_per_learner(base), None, DEFAULTS.risk_threshold, "")
    return V.card_texts(courses, risks, P.overview(base))


def q_skill_score_rows(spark, sf):
    return P.skill_score_rows(ce(spark, sf))


def q_filter_options(spark, sf):
    return V.filter_options(ce(spark, sf))


def q_scope_teacher_courses(spark, sf):
    return V.scope_teacher(ce(spark, sf), TEACHER_TAGS)


def q_scope_teacher_tags(spark, sf):
    return V.scope_teacher(P.tag_weakness(lc(spark, sf)), TEACHER_TAGS)


def q_scope_teacher_risks(spark, sf):
    return V.scope_teacher(top(spark, sf), TEACHER_TAGS).select(*P.RISK_COLUMNS)


def q_scope_org_risks(spark, sf):
    return V.scope_organization(top(spark, sf), ORGANIZATION).select(*P.RISK_COLUMNS)


def q_scope_first_teacher_risks(spark, sf):
    """Option: rank within the scope, among each learner's champions by tag."""
    return P.top_risk_per_learner(V.scope_teacher(P.risk_champions(lc(spark, sf)), TEACHER_TAGS)).select(*P.RISK_COLUMNS)


def q_scope_first_org_risks(spark, sf):
    return P.top_risk_per_learner(V.scope_organization(P.risk_champions(lc(spark, sf)), ORGANIZATION)).select(*P.RISK_COLUMNS)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
