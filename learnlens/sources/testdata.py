"""Role mapping of the TPC-H-like test tables onto the five training tables.

Every derived table is a plain DataFrame over the given parquet files, so its
work grows with them. Only the columns the mapping defines are produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.params import DEFAULTS, Params
from learnlens.session import broadcast_if_small, dealt
from learnlens.tables import Tables

# Number of test "courses" a score is spread over (scores.course_id range).
SCORE_COURSES = 25
# Test "tags": one per residue of the nation key.
TAG_BUCKETS = 8


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("student_id"),
        F.col("c_name").alias("student_name"),
        F.col("c_mktsegment").alias("organization"),
    )


def courses(spark: SparkSession, sf_dir: str, params: Params = DEFAULTS) -> DataFrame:
    nation = read_raw(spark, sf_dir, "nation")
    region = broadcast_if_small(read_raw(spark, sf_dir, "region"), params.broadcast_max_bytes)
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("course_id"),
        F.col("n_name").alias("course_name"),
        F.col("r_name").alias("category"),
        F.concat(F.lit("TAG_"), (F.col("n_nationkey") % TAG_BUCKETS).cast("string")).alias("tag"),
    )


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("resource_id"),
        F.col("p_name").alias("resource_title"),
        F.col("p_type").alias("format"),
        F.col("p_size").alias("duration_minutes"),
    )


def events(spark: SparkSession, sf_dir: str, params: Params = DEFAULTS) -> DataFrame:
    """lineitem ⋈ orders ⋈ supplier. orders is as large as lineitem at scale,
    so that join stays a shuffle join, of bounded rows a task; supplier is broadcast
    only if its bytes are bounded."""
    li = read_raw(spark, sf_dir, "lineitem")
    rows = li.count()  # from the files' footers
    li = dealt(li, rows, "l_orderkey")
    orders = dealt(read_raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rows, "o_orderkey")
    supplier = broadcast_if_small(
        read_raw(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), params.broadcast_max_bytes
    )
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
                "event_id"
            ),
            F.col("o_custkey").alias("student_id"),
            F.col("s_nationkey").alias("course_id"),
            F.col("l_partkey").alias("resource_id"),
            F.to_date("l_shipdate").alias("event_date"),
            F.col("l_quantity").cast("int").alias("duration_minutes"),
            F.round(F.col("l_discount") * 1000).cast("int").alias("progress_percent"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("completed"),
            F.col("l_returnflag").alias("device"),
        )
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_raw(spark, sf_dir, "orders")
    keyed = orders.select(
        F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % SCORE_COURSES).cast("int").alias("course_id"), "o_totalprice"
    )
    grouped = dealt(keyed, orders.count(), "student_id", "course_id").groupBy("student_id", "course_id")
    return grouped.agg((F.max("o_totalprice") / 5000).alias("final_score"))


def training_tables(spark: SparkSession, sf_dir: str, params: Params = DEFAULTS) -> Tables:
    return Tables(
        students=students(spark, sf_dir),
        courses=courses(spark, sf_dir, params),
        resources=resources(spark, sf_dir),
        events=events(spark, sf_dir, params),
        scores=scores(spark, sf_dir),
    )
