"""Exact distinct counts that merge: bitmaps over dense numbers.

A value gets a dense number once (a stored dictionary); the values of a group are then bits,
32,768 to a bitmap of 4 KB. Bitmaps of two batches merge by OR, so a count over
both needs neither batch again, and several distinct counts of a pass do not
multiply its rows as COUNT(DISTINCT a), COUNT(DISTINCT b) does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.operators.ranking import with_position
from learnlens.session import stored

NUMBER, BUCKET, BITS = "number", "bucket", "bits"


def numbered(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(value, number): a stored dictionary of the distinct non-null values of the only
    column of ``values``, numbered from 1 without gaps. Values in ``known`` (an earlier
    dictionary) keep their numbers and new ones follow; the rows of ``known`` are included."""
    (column,) = values.columns
    new = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    if known is None:
        return stored(with_position(new, [F.col("value")], NUMBER), "dictionary")
    last = known.agg(F.max(NUMBER)).first()[0] or 0
    new = with_position(new.join(known.select("value"), "value", "left_anti"), [F.col("value")], NUMBER)
    return stored(known.unionByName(new.withColumn(NUMBER, F.col(NUMBER) + last)), "dictionary")


def distinct_bits(df: DataFrame, column: str, dictionary: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., bucket, bits): the distinct values of ``column`` in each group.

    Rows are first reduced to distinct (group, value) pairs in each task; values of a
    group lie in as many rows as it has buckets, so a group of any size is spread."""
    pairs = df.select(*groups, F.col(column).alias("value")).distinct().join(dictionary, "value")
    return pairs.groupBy(*groups, F.bitmap_bucket_number(NUMBER).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(NUMBER)).alias(BITS)
    )


def merge_bits(states: Sequence[DataFrame], groups: Sequence[str] = ()) -> DataFrame:
    """One state of several (of one dictionary)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*groups, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def bit_counts(state: DataFrame, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., name): the distinct values of each group; groups without one have no
    row, and no groups at all give one row."""
    return state.groupBy(*groups).agg(F.coalesce(F.sum(F.bitmap_count(BITS)), F.lit(0)).cast("long").alias(name))
