"""Counts of every filter state, made once.

A view's cards need the number, and three means, of the courses of a category and a
tag, and the number of learners at risk by tag and threshold. The page offers a few
thresholds only, so all answers fit in two small tables; a view without a keyword
reads a row of each and neither the courses nor the learners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.expressions import is_wild
from learnlens.params import DEFAULTS, Params

MEANS = ("avg_score", "avg_progress", "pass_rate")


def risk_cube(top: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(tag, all_tags, step, risk_count): learners whose rounded risk is at least ``step``, by tag
    (null too) and over all tags. One aggregate of the learners, with a column a step."""
    risk = F.coalesce(F.col("risk_score"), F.lit(0.0))
    steps = [float(s) for s in params.risk_steps]
    names = [f"n{i}" for i in range(len(steps))]
    by_tag = top.groupBy("tag").agg(*[F.count_if(risk >= s).alias(n) for s, n in zip(steps, names)])
    # The total from the tags' rows: the learners are not read again, and not multiplied.
    total = [F.sum(F.col(n)).alias(n) for n in names]
    both = by_tag.withColumn("all_tags", F.lit(False)).unionByName(
        by_tag.agg(*total).withColumn("all_tags", F.lit(True)), allowMissingColumns=True
    )
    rows = [F.struct(F.lit(s).alias("step"), F.coalesce(n, F.lit(0)).cast("long").alias("risk_count")) for s, n in zip(steps, names)]
    return both.select("tag", "all_tags", F.inline(F.array(*rows)))


def course_cube(ce: DataFrame) -> DataFrame:
    """(category, tag, all_categories, all_tags, course_count, means): the unweighted means over
    the courses of each category and tag, of each alone, and of all; null counts as 0."""
    means = [F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in MEANS]
    cube = ce.cube("category", "tag").agg(
        (F.grouping("category") == 1).alias("all_categories"), (F.grouping("tag") == 1).alias("all_tags"),
        F.count("*").alias("course_count"), *means,
    )
    return cube.where("course_count > 0")


def _chosen(cube: DataFrame, column: str, all_: str, value, params: Params) -> DataFrame:
    if is_wild(value, params):
        return cube.where(F.col(all_))
    return cube.where(~F.col(all_) & (F.col(column) == F.lit(value)))


def has_step(risk: float | None, params: Params = DEFAULTS) -> bool:
    return float(params.risk_threshold if risk is None else risk) in {float(s) for s in params.risk_steps}


def risk_count(cube: DataFrame, tag=None, risk: float | None = None, params: Params = DEFAULTS) -> DataFrame:
    """One row: the number of risk rows of a state without a keyword."""
    step = float(params.risk_threshold if risk is None else risk)
    row = _chosen(cube, "tag", "all_tags", tag, params).where(F.col("step") == step)
    return row.agg(F.coalesce(F.sum("risk_count"), F.lit(0)).cast("long").alias("risk_count"))


def card_values(courses: DataFrame, risks: DataFrame, ov: DataFrame, category=None, tag=None, risk: float | None = None, params: Params = DEFAULTS) -> DataFrame:
    """The cards' numbers before any rounding, one row, from the two cubes and the
    overview. A state without courses has the count and the means 0."""
    row = _chosen(_chosen(courses, "category", "all_categories", category, params), "tag", "all_tags", tag, params)
    parts = row.select("course_count", *MEANS).unionByName(risk_count(risks, tag, risk, params), allowMissingColumns=True)
    parts = parts.unionByName(ov.select("student_count", "total_study_hours"), allowMissingColumns=True)
    zero = lambda c, z: F.coalesce(F.max(c), F.lit(z)).alias(c)
    return parts.agg(
        F.max("student_count").alias("student_count"), zero("course_count", 0), zero("avg_score", 0.0), zero("avg_progress", 0.0),
        F.max("total_study_hours").alias("total_study_hours"), zero("pass_rate", 0.0), zero("risk_count", 0),
    )
