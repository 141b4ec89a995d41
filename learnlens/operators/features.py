"""Per-(learner, course) features and the wide ``learner_course`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.expressions import distinct_count, risk_score, score_level
from learnlens.params import DEFAULTS, Params
from learnlens.session import broadcast_if_small
from learnlens.tables import Tables

PAIR = ["student_id", "course_id"]
FILLED = {"study_minutes": 0, "completed_resources": 0, "accessed_resources": 0, "avg_progress": 0}

# Columns the panels read from the wide table; a persisted copy keeps only these.
PANEL_COLUMNS = [
    "student_id", "course_id", "student_name", "organization", "course_name", "category", "tag",
    "final_score", "avg_progress", "study_minutes", "score_level", "risk_score",
]


def pair_features(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per (student, course) with events.

    Sum/avg/max combine map-side; the exact distinct count is planned by
    Spark as a (pair, resource) pre-aggregation, so a hot pair never reaches
    one task as raw rows.
    """
    return events.groupBy(*PAIR).agg(
        F.sum("duration_minutes").alias("study_minutes"),
        F.sum("completed").alias("completed_resources"),
        distinct_count("resource_id", params).alias("accessed_resources"),
        F.avg("progress_percent").alias("avg_progress"),
        F.max("event_date").alias("last_event_date"),
    )


def scored_features(events: DataFrame, scores: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Right outer join of the features onto the scores, then the null fill.

    Scored pairs without events get 0 features and a null last date; event
    pairs without a score are dropped. Both sides are unique per pair, and
    the join reuses the aggregate's hash partitioning on the pair.
    """
    return null_fill(pair_features(events, params).join(scores, PAIR, "right"))


def null_fill(df: DataFrame, values: dict | None = None) -> DataFrame:
    return df.fillna(values or FILLED)


def join_courses(df: DataFrame, courses: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Inner join to the course catalogue, broadcast if its bytes are bounded."""
    return df.join(broadcast_if_small(courses, params.broadcast_max_bytes), "course_id")


def learner_course(tables: Tables, params: Params = DEFAULTS) -> DataFrame:
    """The wide table: one row per scored (learner, course) whose learner and
    course are known, with score level and risk score."""
    wide = join_courses(scored_features(tables.events, tables.scores, params), tables.courses, params)
    # Learners can be as many as the scores, so no broadcast hint here.
    wide = wide.join(tables.students, "student_id")
    return wide.withColumns(
        {
            "score_level": score_level("final_score", params),
            "risk_score": risk_score("final_score", "avg_progress", "study_minutes", params),
        }
    )
