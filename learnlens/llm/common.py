"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.session import cleaned, remove_scratch, scratch_path, ship_package

# A word is a run of characters other than space and \t\n\v\f\r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows with two or three short columns that may be broadcast: about 16 MB.
BROADCAST_ROWS = 400_000
# Bytes of text that a Python task takes up at once.
PART_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def text_of(col: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


# After the first "://": the host up to / ? # or the end, then the path up to ? # or the end.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """In lower case; empty for a null URL or one without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


# Spark's own setting: the shuffle files of a query go at its end. Otherwise they stay until the
# driver happens to collect the garbage of the query's plan, and pile up.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that begin inside remove their shuffle files when they end."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


_SAVED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _SAVED[out] = path
    return out


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage is cut, and a
    lost executor costs a second read instead of a second computation."""
    return _written(df, scratch_path(df.sparkSession, f"llm-{name}"))


def save_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``save`` of what ``make`` returns; the scratch tables that were named on the way go."""
    path = scratch_path(spark, f"llm-{name}")
    with cleaned(spark):
        return _written(make(), path)


def drop(*saved: DataFrame) -> None:
    """Remove tables that ``save`` wrote and that no plan reads any more."""
    for df in saved:
        remove_scratch(df.sparkSession, _SAVED.pop(df))


def text_parts(batch: pa.RecordBatch, text: str, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def bounded(df: DataFrame) -> bool:
    """Whether a narrow, already stored table has at most ``BROADCAST_ROWS`` rows, by a count."""
    return df.count() <= BROADCAST_ROWS


def broadcast_if_bounded(df: DataFrame) -> DataFrame:
    """Broadcast a narrow, already stored table if it is ``bounded``; else leave
    the join to the optimizer (shuffle)."""
    return F.broadcast(df) if bounded(df) else df


def maybe_among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column``, a 64-bit hash, may be among the ``column`` of ``keys``: all that are, and of
    the others fewer the fewer keys there are (one in 64 for ``BROADCAST_ROWS`` distinct ones). For the rows
    that a join with many keys would move and then drop: the keys come as a broadcast table
    of ``BROADCAST_ROWS`` masks of 64 bits at most, whatever their number."""
    word, bit = f"pmod({column}, {BROADCAST_ROWS})", f"cast(shiftrightunsigned({column}, 40) & 63 as int)"
    masks = keys.groupBy(F.expr(word).alias("__word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("__mask"))
    met = rows.join(F.broadcast(masks), F.expr(word) == F.col("__word")).where(f"getbit(__mask, {bit}) = 1")
    return met.drop("__word", "__mask")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), component being
    the smallest node reachable.

    Alternating large-star and small-star steps: each rewires an edge list of
    about the same size, so no group is ever gathered, and the number of steps
    grows with the logarithm of the longest chain. Every step is written to
    the shared folder. More than ``max_rounds`` steps raise. A hub's neighbours are reduced by a plain ``min``
    (combined before the shuffle) and joined back, so a hub with a large share
    of all edges is only a skewed join, which adaptive execution splits.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = save(e, "cc")
    before = None
    for _ in range(max_rounds):
        # Large star: larger neighbours of a node go to its smallest neighbour.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = e.where("a <> b").distinct()
        # Small star: smaller neighbours and the node itself go to the smallest one.
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        pointed = e.join(least, "a")
        e = pointed.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        e = save(e.where("a <> b").distinct(), "cc")
        h = F.xxhash64("a", "b")
        state = e.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        # Finished when a step changes nothing: every edge then points to a smallest node.
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
