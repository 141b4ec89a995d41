"""Positions in a global order, without a task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.session import stored

_TIE, _AT, _PART, _BEFORE = "__position_tie", "__position_at", "__position_part", "__position_before"
# monotonically_increasing_id: the task in the upper bits, the row within it in the lower 33.
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position", is_stored: bool = False) -> DataFrame:
    """``df`` with its position (from 1) in the given order.

    The rows are sorted by range over the tasks, a task numbers its own, and the numbers
    of rows of the tasks before it (one row a task, summed up) are added. Rows that
    tie in ``order`` are told apart by their place in the input, so a value that a third of
    all rows share is still cut into ranges; which of them comes first is not defined.
    The sorted rows are stored, since positions must come from a single sort; the
    input is too, unless it is a stored table already (``is_stored``), so that a repeated
    task numbers its rows as the first one did. Null order values sort as ``order``
    says; an empty input gives no rows.
    """
    rows = df if is_stored else stored(df, "unranked")
    by_range = rows.withColumn(_TIE, F.monotonically_increasing_id()).orderBy(*order, _TIE).drop(_TIE)
    numbered = stored(by_range.withColumn(_AT, F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned(F.col(_AT), _ROW_BITS)
    sizes = numbered.groupBy(part.alias(_PART)).agg(F.count("*").alias("n"))
    # One row for each task of the sort.
    before = sizes.select(_PART, F.expr(f"coalesce(sum(n) over (order by {_PART} rows between unbounded preceding and 1 preceding), 0L) as {_BEFORE}"))
    position = F.col(_BEFORE) + F.col(_AT).bitwiseAND((1 << _ROW_BITS) - 1) + 1
    joined = numbered.withColumn(_PART, part).join(F.broadcast(before), _PART)
    return joined.withColumn(name, position).select(*[F.col(f"`{c}`") for c in df.columns], name)
