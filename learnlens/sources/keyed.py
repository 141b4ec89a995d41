"""Tables stored by key, which an update rewrites only in part.

A keyed table is a folder of Parquet files in partitions by a hash of the key. An
upsert reads and rewrites the partitions that its keys fall into (Spark's dynamic partition
overwrite) and leaves every other file as it is, so the cost of a refresh follows the
batch and not the table. A batch that is as large as the table touches every
partition and is then no worse than writing the table anew.

Each partition is written to a staging folder and put in place when the job commits; a
lost executor or a failed task changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnlens.sources.writers import latest_by_key

PART = "key_part"
PARTS = 64


def key_part(keys: Sequence[str], parts: int) -> Column:
    """The partition of a key. Keys are hashed as text, so an int and a long key agree."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(parts)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], parts: int = PARTS) -> str:
    """Store ``df`` (one row a key, see ``latest_by_key``) at ``path``, which must be new."""
    _write(df, path, keys, parts, "errorifexists")
    return path


def _write(df: DataFrame, path: str, keys: Sequence[str], parts: int, mode: str) -> None:
    rows = df.withColumn(PART, key_part(keys, parts))
    # One task a partition, so a partition is one file.
    rows = rows.repartition(parts, PART)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def read_keyed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return _with_part(spark, path, schema).drop(PART)


def _with_part(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField(PART, T.IntegerType())]))
    return reader.parquet(path)


def merge_keyed(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], merge, parts: int = PARTS) -> DataFrame:
    """Replace the rows of the partitions that ``batch``'s keys fall into by
    ``merge(rows, batch)``, both of these partitions alone. Returns the table read anew.

    The batch is read twice (its partitions, its rows); pass a stored one."""
    touched = sorted(r[0] for r in batch.select(key_part(keys, parts)).distinct().collect())  # at most ``parts`` numbers
    if touched:
        stored = _with_part(spark, path, None)
        old = stored.where(F.col(PART).isin(touched)).drop(PART)
        _write(merge(old, batch.select(*old.columns)), path, keys, parts, "overwrite")
    return read_keyed(spark, path)


def upsert_keyed(
    spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, parts: int = PARTS
) -> DataFrame:
    """Update the stored table in place: the latest incoming row of a key (by ``order``; by
    all values without one) replaces the stored row or is added.

    A null key equals nothing, as in SQL: such rows are always added. Columns of
    ``incoming`` beyond the table's are dropped after they have ordered the rows.
    """
    keys = list(keys)
    latest = latest_by_key(incoming, keys, order or [c for c in incoming.columns if c not in keys])

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        # Schemas follow the table, whatever the batch's numbers are stored as.
        typed = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema.fields])
        return old.join(new.select(*keys), keys, "left_anti").unionByName(typed)

    return merge_keyed(spark, path, latest, keys, merge, parts)
