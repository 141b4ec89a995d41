"""Filtered views and role scopes over the panels.

The reference filters collected rows in the browser or the web server; here
every filter is a predicate on the panel DataFrames, so it holds at any size
and Catalyst pushes it as far down as the panel allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.functions.expressions import (
    equals_or_in,
    fixed_text,
    grouped_number,
    is_wild,
    keyword_match,
    percent_text,
    round_columns,
)
from learnlens.operators.panels import with_position
from learnlens.operators.search import search
from learnlens.params import DEFAULTS, Params


def filter_equals(df: DataFrame, **equals) -> DataFrame:
    """Scalar -> equality, list -> IN, None -> skipped; predicates ANDed."""
    for name, expected in equals.items():
        pred = equals_or_in(name, expected)
        if pred is not None:
            df = df.where(pred)
    return df


def filter_courses(ce: DataFrame, category=None, tag=None, params: Params = DEFAULTS) -> DataFrame:
    """Course rows of the chosen category and tag; the wildcard keeps all."""
    if not is_wild(category, params):
        ce = ce.where(F.col("category") == F.lit(category))
    if not is_wild(tag, params):
        ce = ce.where(F.col("tag") == F.lit(tag))
    return ce


def filter_tags(tw: DataFrame, courses: DataFrame, tag=None, params: Params = DEFAULTS) -> DataFrame:
    """Tag rows: with the wildcard, the tags of the filtered courses (semi
    join); with a chosen tag, that tag only, whatever the category."""
    if is_wild(tag, params):
        return tw.join(courses.select("tag"), "tag", "left_semi")
    return tw.where(F.col("tag") == F.lit(tag))


def filter_risks(
    risks: DataFrame, tag=None, risk: float | None = None, keyword: str | None = "", params: Params = DEFAULTS
) -> DataFrame:
    """Risk rows by tag (wildcard = all), rounded risk >= threshold and a
    literal keyword over 'name organization course tag'. Category is not
    applied, as in the reference."""
    return _at_risk(risks, tag, risk, params).where(keyword_match(keyword, *SEARCHED))


# The columns that a keyword is searched in.
SEARCHED = ("student_name", "organization", "course_name", "tag")


def search_risks(
    risks: DataFrame, index: DataFrame, tag=None, risk: float | None = None, keyword: str | None = "", params: Params = DEFAULTS
) -> DataFrame:
    """``filter_risks`` by way of a stored trigram index of the same rows."""
    return search(_at_risk(risks, tag, risk, params), index, "student_id", SEARCHED, keyword)


def _at_risk(risks: DataFrame, tag, risk: float | None, params: Params) -> DataFrame:
    threshold = params.risk_threshold if risk is None else risk
    out = risks.where(F.coalesce(F.col("risk_score"), F.lit(0.0)) >= F.lit(float(threshold)))
    if not is_wild(tag, params):
        out = out.where(F.col("tag") == F.lit(tag))
    return out


def _card_values(courses: DataFrame, risks: DataFrame, ov: DataFrame) -> DataFrame:
    """The cards' numbers before any rounding, one row.

    Course cards are unweighted means of the per-course values (null counts
    as 0, no rows gives 0); learner and hour cards come from the unfiltered
    overview. The three inputs are tagged and unioned into one global
    aggregate, so no join is needed.
    """
    tagged = (
        courses.select(F.lit("c").alias("src"), "avg_score", "avg_progress", "pass_rate")
        .unionByName(risks.select(F.lit("r").alias("src")), allowMissingColumns=True)
        .unionByName(ov.select(F.lit("o").alias("src"), "student_count", "total_study_hours"), allowMissingColumns=True)
    )
    is_course = F.col("src") == "c"

    def course_mean(c: str) -> Column:
        return F.coalesce(F.avg(F.when(is_course, F.coalesce(F.col(c), F.lit(0.0)))), F.lit(0.0)).alias(c)

    return tagged.agg(
        F.max(F.when(F.col("src") == "o", F.col("student_count"))).alias("student_count"),
        F.count_if(is_course).alias("course_count"),
        course_mean("avg_score"),
        course_mean("avg_progress"),
        F.max(F.when(F.col("src") == "o", F.col("total_study_hours"))).alias("total_study_hours"),
        course_mean("pass_rate"),
        F.count_if(F.col("src") == "r").alias("risk_count"),
    )


def metric_cards(courses: DataFrame, risks: DataFrame, ov: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Cards of a filtered view as numbers, one row."""
    return rounded_cards(_card_values(courses, risks, ov), params)


def rounded_cards(values: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return round_columns(values, ["avg_score", "avg_progress", "pass_rate"], params.decimals)


def card_texts(courses: DataFrame, risks: DataFrame, ov: DataFrame) -> DataFrame:
    """Cards as the page shows them: counts and hours grouped, the score with
    at most two places, shares with one; from the unrounded means."""
    return formatted_cards(_card_values(courses, risks, ov))


def formatted_cards(values: DataFrame) -> DataFrame:
    return values.select(
        grouped_number("student_count").alias("student_text"),
        grouped_number("course_count").alias("course_text"),
        grouped_number(fixed_text("avg_score", 2).cast("double")).alias("score_text"),
        percent_text("avg_progress").alias("progress_text"),
        grouped_number("total_study_hours").alias("hours_text"),
        percent_text("pass_rate").alias("pass_rate_text"),
        grouped_number("risk_count").alias("risk_text"),
    )


def filter_options(ce: DataFrame) -> DataFrame:
    """Distinct categories and tags in order of first appearance in the
    course panel's order: (kind, value, position).

    A value's first appearance is its smallest (avg_score, course_id), an
    ordinary aggregate; only the few distinct values are then numbered.
    """
    parts = []
    for kind in ("category", "tag"):
        first = ce.groupBy(F.col(kind).alias("value")).agg(
            F.min(F.struct(F.col("avg_score").alias("s"), F.col("course_id").alias("c"))).alias("first")
        )
        order = [F.asc("first.s"), F.asc("first.c")]
        parts.append(with_position(first, order).select(F.lit(kind).alias("kind"), "value", "position"))
    return parts[0].unionByName(parts[1])


def scope_teacher(panel: DataFrame, allowed_tags) -> DataFrame:
    """A teacher sees course, tag and risk rows of the allowed tags only."""
    return filter_equals(panel, tag=list(allowed_tags))


def scope_organization(risks: DataFrame, organization) -> DataFrame:
    """An organization manager sees risk rows of the own organization only;
    ``None`` means no filter."""
    return filter_equals(risks, organization=organization)
