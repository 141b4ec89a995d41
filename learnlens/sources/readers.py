"""Readers for the five training tables: CSV on any Hadoop file system,
Parquet, and JDBC. All scans run in the executors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnlens.schemas import COLUMNS, CORRUPT, FILE_NAMES, SCHEMAS, SQL_TABLES, TABLES
from learnlens.sources.publications import published_path
from learnlens.tables import Tables


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the header line (reads one line)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    infer: bool = False,
    as_text: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV with a header line, columns found by name; of a publication, its current version.

    With a schema there is no inference pass: the types are put in the order
    of the header, undeclared columns are left out, a missing one raises, and a
    file of the same folder with another header fails when it is read
    (``enforceSchema=false``). ``as_text`` keeps the declared columns as text, so that a
    malformed cell is seen (by the declared-type checks) instead of becoming null;
    ``keep_corrupt`` adds such rows' source line in ``_corrupt_record``.
    ``infer=True`` reproduces the reference's inferred types instead.
    """
    path = published_path(spark, path)
    reader = spark.read.option("header", True)
    if schema is None or infer:
        return reader.option("inferSchema", True).csv(path)
    declared = {f.name: f for f in schema.fields}
    header = csv_header(spark, path)
    missing = [c for c in declared if c not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    text = T.StringType()
    found = T.StructType([T.StructField(c, text if as_text or c not in declared else declared[c].dataType) for c in header])
    names = list(declared)
    if keep_corrupt:
        found = found.add(CORRUPT, text)
        names.append(CORRUPT)
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("enforceSchema", False).schema(found).csv(path).select(*names)


def table_uri(base: str, name: str, file_names: dict[str, str] = FILE_NAMES) -> str:
    """Location of a table under a base URI of any Hadoop file system
    (``file:``, ``hdfs:``, ``s3a:``, ...)."""
    return f"{base.rstrip('/')}/{file_names.get(name, name)}"


def read_fs_csv(
    spark: SparkSession, base: str, name: str, infer: bool = False, as_text: bool = False, keep_corrupt: bool = False
) -> DataFrame:
    return read_csv(spark, table_uri(base, name), SCHEMAS.get(name), infer, as_text, keep_corrupt)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    fetchsize: int = 10_000,
    predicates: list[str] | None = None,
) -> DataFrame:
    """A table or query read through Spark's JDBC source.

    With a numeric ``partition_column`` and bounds, the read is split into
    ``num_partitions`` range queries run by the executors in parallel; with
    ``predicates``, into one query for each (they must cover every row once).
    Filters and the projection of later steps are pushed into the SQL.
    """
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table or query")
    options = jdbc_properties(url, properties, fetchsize)
    if predicates is not None:
        if table is None or partition_column is not None:
            raise ValueError("predicates need dbtable, and no partition column")
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    reader = spark.read.format("jdbc").option("url", url)
    for key, value in options.items():
        reader = reader.option(key, value)
    reader = reader.option("dbtable", table) if table is not None else reader.option("query", query)
    if partition_column is not None:
        if table is None:
            raise ValueError("a partitioned read needs dbtable, not query")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", num_partitions or spark.sparkContext.defaultParallelism)
        )
    return reader.load()


def jdbc_properties(url: str, properties: dict[str, str] | None = None, fetchsize: int = 10_000) -> dict[str, str]:
    """Connection properties. MySQL's driver ignores the fetch size, and reads a whole
    table into an executor, unless cursors are asked for."""
    out = {"fetchsize": str(fetchsize)}
    if url.startswith(("jdbc:mysql:", "jdbc:mariadb:")):
        out["useCursorFetch"] = "true"
    return {**out, **(properties or {})}


def jdbc_predicates(name: str, parts: int, first: dt.date, last: dt.date) -> list[str] | None:
    """How the two large tables are read in parallel: every row meets exactly
    one predicate. Keys are text, so events are split by date (the days from ``first`` to
    ``last``, and what lies outside) and scores by a hash of the learner."""
    if parts < 2:
        return None
    if name == "events":
        days = (last - first).days + 1
        cuts = sorted({first + dt.timedelta(days=days * i // parts) for i in range(1, parts)})
        bounds = [None, *cuts, None]
        out = []
        for lo, hi in zip(bounds, bounds[1:]):
            terms = ([f"event_date >= '{lo}'"] if lo else []) + ([f"event_date < '{hi}'"] if hi else [])
            out.append(" AND ".join(terms))
        out[0] = f"({out[0]} OR event_date IS NULL)"
        return out
    if name == "scores":
        return [f"MOD(CRC32(student_id), {parts}) = {i}" + (" OR student_id IS NULL" if i == 0 else "") for i in range(parts)]
    return None


def table_query(name: str) -> str:
    """The explicit projection of a stored training table."""
    return f"SELECT {', '.join(COLUMNS[name])} FROM {SQL_TABLES[name]}"


def decimals_to_double(df: DataFrame) -> DataFrame:
    """SQL decimals as doubles, as the panels expect them; dates stay dates."""
    return df.select(
        *[
            (F.col(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def normalize_types(df: DataFrame) -> DataFrame:
    """What the original's SQL client gave: decimals as doubles and, beyond what a
    load does, dates as 'yyyy-MM-dd' text."""
    out = decimals_to_double(df)
    dates = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})


def load_tables(
    spark: SparkSession,
    source: str = "csv",
    base: str | None = None,
    url: str | None = None,
    properties: dict[str, str] | None = None,
    infer: bool = False,
    jdbc_partitions: dict[str, dict] | None = None,
    as_text: bool = False,
    keep_corrupt: bool = False,
) -> Tables:
    """The five tables from one source.

    ``jdbc_partitions`` has ``read_jdbc`` arguments per table (see
    ``jdbc_predicates``); ``as_text`` reads CSV cells as text, for the quality
    report, and ``keep_corrupt`` adds the source line of rows that do not fit the columns.

    ``source`` is case-insensitive: ``parquet`` (``base/<name>.parquet``),
    ``hdfs`` (CSV under any file-system URI), ``mysql``/``jdbc`` (SQL tables)
    or ``csv``; any other value means ``csv``.
    """
    kind = (source or "csv").lower()
    if kind in ("mysql", "jdbc"):
        if url is None:
            raise ValueError("a JDBC source needs url")
        parts = jdbc_partitions or {}
        tables = {}
        for name in TABLES:
            if name in parts:
                df = read_jdbc(spark, url, table=SQL_TABLES[name], properties=properties, **parts[name])
            else:
                df = read_jdbc(spark, url, query=table_query(name), properties=properties)
            tables[name] = decimals_to_double(df.select(*COLUMNS[name]))
        return Tables.from_dict(tables)
    if base is None:
        raise ValueError("a file source needs base")
    if kind == "parquet":
        return Tables.from_dict(
            {n: spark.read.parquet(published_path(spark, f"{base.rstrip('/')}/{n}.parquet")) for n in TABLES}
        )
    return Tables.from_dict({n: read_fs_csv(spark, base, n, infer, as_text, keep_corrupt) for n in TABLES})
