"""Recommendation rows: weakest courses, a risk row, fixed advice.

Built as a UNION ALL of ordered blocks; a final position over the handful of
rows replaces the reference's driver-side list slicing. No rows are
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.functions.expressions import fixed_text
from learnlens.operators.panels import weakest_courses, with_position
from learnlens.params import (
    DEFAULTS,
    REC_COURSE_DETAIL,
    REC_COURSE_TITLE,
    REC_FIXED,
    REC_VIEW_COURSE_DETAIL,
    REC_VIEW_COURSE_TITLE,
    REC_VIEW_FIXED,
    REC_VIEW_RISK_DETAIL,
    REC_VIEW_RISK_TITLE,
    Params,
)


def _template(text: str, names: list[str]) -> str:
    """'{a} and {b}' -> '%1$s and %2$s' for ``format_string``."""
    for i, name in enumerate(names, start=1):
        text = text.replace("{" + name + "}", f"%{i}$s")
    return text


def _fill(text: str, **cols) -> Column:
    names = list(cols)
    return F.format_string(_template(text, names), *cols.values())


def _fixed_block(spark, block: int, rows) -> DataFrame:
    """Constant rows built in the JVM (one-row range + inline), no Python data."""
    structs = [
        F.struct(
            F.lit(block).alias("block"), F.lit(i).alias("rank"), F.lit(t).alias("title"), F.lit(d).alias("detail")
        )
        for i, (t, d) in enumerate(rows, start=1)
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _weak_block(ce: DataFrame, k: int, title: str, detail: Column) -> DataFrame:
    weak = with_position(weakest_courses(ce, k), [F.asc("avg_score"), F.asc("course_id")], "rank")
    return weak.select(
        F.lit(0).alias("block"),
        F.col("rank").cast("int").alias("rank"),
        _fill(title, course=F.col("course_name")).alias("title"),
        detail.alias("detail"),
    )


def _finish(blocks: list[DataFrame], cap: int) -> DataFrame:
    rows = blocks[0]
    for b in blocks[1:]:
        rows = rows.unionByName(b)
    ranked = with_position(rows, [F.asc("block"), F.asc("rank")])
    return ranked.where(F.col("position") <= cap).select("position", "title", "detail")


def recommendations(ce: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """k weakest courses by rounded average score, then the fixed rows; first n."""
    detail = _fill(REC_COURSE_DETAIL, tag=F.col("tag"))
    weak = _weak_block(ce, params.weak_courses, REC_COURSE_TITLE, detail)
    fixed = _fixed_block(ce.sparkSession, 1, REC_FIXED)
    return _finish([weak, fixed], params.recommendations)


def recommendations_filtered(
    courses: DataFrame, risks: DataFrame, params: Params = DEFAULTS, counted: DataFrame | None = None
) -> DataFrame:
    """For a filtered view: k weakest of the filtered courses, a risk row only
    when the filtered risk list is non-empty, one fixed row; first n. ``counted`` has the
    list's length (risk_count) where it is known, and the list is not read."""
    detail = _fill(
        REC_VIEW_COURSE_DETAIL,
        score=fixed_text("avg_score", 1),
        tag=F.col("tag"),
    )
    weak = _weak_block(courses, params.weak_courses_filtered, REC_VIEW_COURSE_TITLE, detail)
    risk = (
        (risks.agg(F.count("*").alias("n")) if counted is None else counted.select(F.col("risk_count").alias("n")))
        .where(F.col("n") > 0)
        .select(
            F.lit(1).alias("block"),
            F.lit(1).alias("rank"),
            F.lit(REC_VIEW_RISK_TITLE).alias("title"),
            _fill(REC_VIEW_RISK_DETAIL, count=F.col("n")).alias("detail"),
        )
    )
    fixed = _fixed_block(courses.sparkSession, 2, [REC_VIEW_FIXED])
    return _finish([weak, risk, fixed], params.recommendations_filtered)
