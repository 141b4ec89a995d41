"""Incremental refresh: panels from stored states and new events alone.

The events of all batches so far are kept as two mergeable states:

- ``resources``: sums, counts and the last date by (learner, course, resource);
- ``weeks``: sums and counts by (learner, Monday).

Pair features, format usage and weekly activity follow from them exactly, the distinct
counts too: a learner's resources and a week's learners are rows of the states. A batch is
reduced to its own states, merged with the stored ones and published as the next version
together with the list of batches it holds: a refresh that breaks leaves the last
version, and a batch that is given again changes nothing. Old events are never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.functions.expressions import key_label, week_start
from learnlens.operators.features import PAIR
from learnlens.operators.panels import format_rates
from learnlens.params import DEFAULTS, Params
from learnlens.sources.publications import new_version, published_path, switch, versions

KEYS = {"resources": [*PAIR, "resource_id"], "weeks": ["student_id", "week_start"]}
SUMS = {
    "resources": ("events", "minutes", "completed", "progress_sum", "progress_n"),
    "weeks": ("events", "minutes"),
}
LATEST = {"resources": ("last_event_date",), "weeks": ()}


def event_states(events: DataFrame) -> dict[str, DataFrame]:
    """The states of a batch of events."""
    sums = {
        "events": F.count("*"), "minutes": F.sum("duration_minutes"), "completed": F.sum("completed"),
        "progress_sum": F.sum("progress_percent"), "progress_n": F.count("progress_percent"),
        "last_event_date": F.max("event_date"),
    }
    by = events.withColumn("week_start", week_start("event_date"))
    return {n: by.groupBy(*KEYS[n]).agg(*[sums[c].alias(c) for c in (*SUMS[n], *LATEST[n])]) for n in KEYS}


def merge_states(name: str, states: Sequence[DataFrame]) -> DataFrame:
    """One row a key again. A sum stays null only if no batch had a value."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    last = [F.max(c).alias(c) for c in LATEST[name]]
    return out.groupBy(*KEYS[name]).agg(*[F.sum(c).alias(c) for c in SUMS[name]], *last)


def add_events(spark: SparkSession, uri: str, events: DataFrame, batch: str) -> bool:
    """Merge a batch of events into the states at ``uri`` (made by the first batch). False
    if the batch is in them already. One refresh at a time; of two at once, the later
    switch would hide the other's batch (``batches`` shows it)."""
    current = published_path(spark, uri) if versions(spark, uri) else None
    if batch in batches(spark, uri):
        return False
    version = new_version(uri)
    for name, state in event_states(events).items():
        if current:
            state = merge_states(name, [spark.read.parquet(f"{current}/{name}"), state])
        state.write.parquet(f"{version}/{name}")
    held = [*batches(spark, uri), batch]
    spark.createDataFrame([(b,) for b in held], "batch string").coalesce(1).write.parquet(f"{version}/batches")
    switch(spark, uri, version)
    return True


def batches(spark: SparkSession, uri: str) -> list[str]:
    """Names of the batches in the states, one a refresh."""
    if not versions(spark, uri):
        return []
    return [r[0] for r in spark.read.parquet(f"{published_path(spark, uri)}/batches").collect()]


def states(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    current = published_path(spark, uri)
    return {name: spark.read.parquet(f"{current}/{name}") for name in KEYS}


def pair_features(resources: DataFrame) -> DataFrame:
    """The features by (learner, course) from the ``resources`` state."""
    return resources.groupBy(*PAIR).agg(
        F.sum("minutes").alias("study_minutes"),
        F.sum("completed").alias("completed_resources"),
        # One row a resource of the pair; events without a resource have a row of null.
        F.count("resource_id").alias("accessed_resources"),
        F.when(F.sum("progress_n") > 0, F.sum("progress_sum").cast("double") / F.sum("progress_n")).alias("avg_progress"),
        F.max("last_event_date").alias("last_event_date"),
    )


def format_usage(state: DataFrame, resources: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Events by resource format from the ``resources`` state."""
    per_resource = state.groupBy("resource_id").agg(
        F.sum("events").alias("views"), *[F.sum(c).alias(c) for c in ("completed", "progress_sum", "progress_n")]
    )
    return format_rates(per_resource, resources, params)


def weekly_activity(weeks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """By 'MM-dd' label of the week's Monday, from the ``weeks`` state."""
    key = (F.month("week_start") * 100 + F.dayofmonth("week_start")).alias("week_key")
    out = weeks.groupBy(key).agg(
        F.round(F.sum("minutes") / 60, params.decimals).alias("study_hours"),
        # Weeks of different years share a label, so learners may repeat.
        F.count_distinct("student_id").alias("active_students"),
        F.sum("events").alias("events"),
    )
    return out.select(key_label("week_key").alias("week"), "study_hours", "active_students", "events")
