"""Column expressions of the panels. All built-in functions, so they stay in
whole-stage codegen; none of them needs a UDF."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.params import DEFAULTS, Params


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_level(score: str | Column = "final_score", params: Params = DEFAULTS) -> Column:
    """Searched CASE over inclusive lower bounds; a null score falls through
    to the last level (null >= x is not true)."""
    s = col(score)
    names, cuts = params.level_names, params.level_cuts
    expr = F.when(s >= cuts[0], F.lit(names[0]))
    for name, cut in zip(names[1:], cuts[1:]):
        expr = expr.when(s >= cut, F.lit(name))
    return expr.otherwise(F.lit(names[-1]))


def risk_score(
    score: str | Column = "final_score",
    progress: str | Column = "avg_progress",
    minutes: str | Column = "study_minutes",
    params: Params = DEFAULTS,
) -> Column:
    """max(0, base - w_s*score - w_p*progress - min(minutes/div, cap)).

    ``greatest`` skips nulls, so a null score gives 0 rather than null.
    """
    raw = (
        F.lit(params.risk_base)
        - col(score) * params.score_weight
        - col(progress) * params.progress_weight
        - F.least(col(minutes) / params.minutes_divisor, F.lit(params.minutes_cap))
    )
    return F.greatest(F.lit(0.0), raw)


def round_columns(df: DataFrame, cols: Iterable[str], decimals: int = 2) -> DataFrame:
    """Round the named columns in place (half-up), in one projection."""
    return df.withColumns({c: F.round(F.col(c), decimals) for c in cols})


def distinct_count(c: str | Column, params: Params = DEFAULTS) -> Column:
    """Exact ``count(DISTINCT c)``, or a HyperLogLog++ estimate when
    ``params.approx_distinct_rsd`` is set (opt-in)."""
    if params.approx_distinct_rsd is None:
        return F.count_distinct(col(c))
    return F.approx_count_distinct(col(c), params.approx_distinct_rsd)


def conditional_count(cond: Column) -> Column:
    """Rows where ``cond`` is true; null counts as false."""
    return F.sum(F.when(cond, 1).otherwise(0))


def conditional_rate(cond: Column) -> Column:
    """Percentage of rows where ``cond`` is true (null counts as false)."""
    return F.avg(F.when(cond, 1).otherwise(0)) * 100


def week_start(date: str | Column = "event_date") -> Column:
    """Monday of the date's week, as a date."""
    return F.trunc(F.to_date(col(date)), "week")


def week_key(date: str | Column = "event_date") -> Column:
    """month * 100 + day of the week's Monday: sorts like the label and hashes
    cheaper than text."""
    monday = week_start(date)
    return F.month(monday) * 100 + F.dayofmonth(monday)


def key_label(key: str | Column) -> Column:
    """'MM-dd' of a week key; null stays null."""
    k = col(key)
    return F.when(k.isNotNull(), F.format_string("%02d-%02d", F.floor(k / 100), k % 100))


def week_label(date: str | Column = "event_date") -> Column:
    """'MM-dd' of the week's Monday (no year, as in the reference)."""
    return key_label(week_key(date))


def ordinal_position(value: str | Column, order: Sequence[str]) -> Column:
    """1-based position of ``value`` in a fixed list; unknown values give 0."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), col(value))


def clean_keyword(keyword: str | None) -> str:
    return (keyword or "").strip().lower()


def keyword_text(*text_cols: str) -> Column:
    """What a keyword is searched in: the columns joined by single spaces, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in text_cols]))


def keyword_match(keyword: str | None, *text_cols: str) -> Column:
    """Literal, case-insensitive substring test over the columns joined by
    single spaces. The keyword is trimmed; an empty keyword matches all.
    ``contains`` is literal, so ``%`` and ``_`` have no wildcard meaning."""
    kw = clean_keyword(keyword)
    return keyword_text(*text_cols).contains(F.lit(kw)) if kw else F.lit(True)


def is_wild(value, params: Params = DEFAULTS) -> bool:
    return value is None or value == params.wildcard


def equals_or_in(c: str, expected) -> Column | None:
    """Scalar -> equality, list/tuple/set -> IN, None -> no predicate.
    A null cell never equals a scalar, so null rows are dropped."""
    if expected is None:
        return None
    if isinstance(expected, (list, tuple, set, frozenset)):
        return F.col(c).isin(list(expected))
    return F.col(c) == F.lit(expected)


# x * 10**places as a sum of terms that are exact (powers of two, or a power of
# two times x): 10 = 8 + 2, 100 = 64 + 32 + 4.
_EXACT_TERMS = {1: (8.0, 2.0), 2: (64.0, 32.0, 4.0)}


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """The double nearest to a + b, and the exact rest."""
    s = a + b
    bb = s - a
    return s, (a - (s - bb)) + (b - bb)


def fixed_units(x: str | Column, places: int) -> Column:
    """x >= 0 in units of 10**-places, rounded on the exact binary value, as the
    reference's display does: the nearest integer, a true tie up. 37.15 is a
    little less than its text says, so one place gives 371."""
    x = col(x).cast("double")
    first, *more = _EXACT_TERMS[places]
    total, rest = x * first, F.lit(0.0)
    for t in more:
        total, e = _two_sum(total, x * t)
        rest = rest + e
    # The rest may reach over half a unit in the last place: once more.
    total, rest = _two_sum(total, rest)
    whole = F.floor(total)
    part = total - whole
    up = (part > 0.5) | ((part == 0.5) & (rest >= 0))
    return whole + F.when(up, 1).otherwise(0)


def fixed_text(x: str | Column, places: int) -> Column:
    """Number with exactly ``places`` (1 or 2) decimals; null counts as 0."""
    value = F.coalesce(col(x).cast("double"), F.lit(0.0))
    units = fixed_units(F.abs(value), places)
    scale = 10**places
    sign = F.when(value < 0, "-").otherwise("")
    return F.format_string(f"%s%d.%0{places}d", sign, F.floor(units / scale).cast("long"), (units % scale).cast("long"))


def percent_text(x: str | Column) -> Column:
    """'x.x%'; null counts as 0."""
    return F.concat(fixed_text(x, 1), F.lit("%"))


def grouped_number(x: str | Column) -> Column:
    """Thousands grouped with ',', at most three decimals (half up), no
    trailing zeros; null counts as 0."""
    text = F.format_number(F.round(F.coalesce(col(x).cast("double"), F.lit(0.0)), 3), 3)
    return F.regexp_replace(text, r"\.?0+$", "")
