"""Positions against a sort in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from learnlens.operators.ranking import with_position

SCHEMA = "v long, `a.b` string, position_ int"


@pytest.mark.parametrize("distinct", [1, 3, 100_000])
def test_positions_are_those_of_the_sort(spark, distinct):
    r = random.Random(distinct)
    rows = [(r.choice([None, *range(min(distinct, 50)), r.randrange(distinct)]), r.choice(["x", "y", None]), i) for i in range(3_000)]
    order = [F.col("v").desc_nulls_last(), F.col("`a.b`").asc_nulls_first()]
    got = with_position(spark.createDataFrame(rows, SCHEMA).repartition(5), order, "at")
    assert got.columns == ["v", "a.b", "position_", "at"]
    out = sorted((tuple(x) for x in got.collect()), key=lambda x: x[3])
    assert [x[3] for x in out] == list(range(1, 3_001))
    assert sorted((x[:3] for x in out), key=lambda x: x[2]) == rows
    key = lambda x: (x[0] is None, -(x[0] or 0), x[1] is not None, x[1] or "")
    assert [key(x) for x in out] == sorted(map(key, rows))


def test_scratch_tables_are_removed(spark, tmp_path):
    import os

    from learnlens.session import cleaned, shared_root

    folder = f"{shared_root(spark)}/learnlens".removeprefix("file:")
    df = spark.range(100).select("id")
    with_position(df, [F.col("id")]).count()
    before = set(os.listdir(folder))
    with cleaned(spark):
        with_position(df, [F.col("id").desc()]).write.parquet(str(tmp_path / "out"))
        assert len(set(os.listdir(folder)) - before) == 2
    assert set(os.listdir(folder)) == before and spark.read.parquet(str(tmp_path / "out")).count() == 100
    with pytest.raises(ValueError), cleaned(spark):
        with_position(df, [F.col("id")])
        raise ValueError
    assert set(os.listdir(folder)) == before


def test_no_rows(spark):
    assert with_position(spark.createDataFrame([], SCHEMA), [F.col("v")]).collect() == []


def test_a_value_that_all_rows_share(spark):
    """One value everywhere is still cut into several ranges."""
    df = spark.range(40_000).select(F.lit(1).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_position(df, [F.col("v")])
        assert got.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first()[:] == (1, 40_000, 40_000)
        # The sorted rows are a stored table of a file for each range.
        assert len(got.inputFiles()) > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps_count_and_merge(spark):
    from learnlens.operators import distinct

    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([None, *range(40_000, 40_400)])) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v int")
    first = distinct.numbered(df.where("v < 40200").select("v"))
    known = distinct.numbered(df.select("v"), known=first)
    values = {v for _, v in rows if v is not None}
    assert sorted(x.number for x in known.collect()) == list(range(1, len(values) + 1))
    assert dict(map(tuple, first.collect())).items() <= dict(map(tuple, known.collect())).items()
    halves = [distinct.distinct_bits(df.where(c), "v", known, ["g"]) for c in ("v % 3 = 0", "v % 3 <> 0 or v % 5 = 0")]
    counts = {x.g: x.n for x in distinct.bit_counts(distinct.merge_bits(halves, ["g"]), "n", ["g"]).collect()}
    assert counts == {g: len({v for h, v in rows if h == g and v is not None}) for g in "ab"}
    assert distinct.bit_counts(distinct.distinct_bits(df.limit(0), "v", known), "n").first().n == 0
    # More than one bitmap a group.
    many = spark.range(100_000).select("id")
    numbers = many.select(F.col("id").alias("value"), (F.col("id") + 1).alias("number"))
    state = distinct.distinct_bits(many, "id", numbers)
    assert state.count() == 4 and distinct.bit_counts(state, "n").first().n == 100_000
