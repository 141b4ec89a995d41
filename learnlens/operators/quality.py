"""Declared constraints of the store, checked as Spark jobs.

Primary keys, NOT NULL, foreign keys and declared types/lengths. Each check
returns offending rows or counts; ``quality_report`` gathers all counts into
one ``(table, rule, columns, violations)`` DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnlens.schemas import CORRUPT, DECLARED, FOREIGN_KEYS, PRIMARY_KEYS
from learnlens.session import partitions_for
from learnlens.sources.publications import publish_files
from learnlens.tables import Tables

INT_RANGE = {"int": (-(2**31), 2**31 - 1), "tinyint": (-128, 127)}


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null child key values missing from the parent, with row counts.

    The child is first reduced to its distinct keys (combined map-side), so
    a hot key is one row in the anti join, not a third of the table.
    """
    keys = child.where(F.col(column).isNotNull()).groupBy(column).count()
    present = parent.select(F.col(parent_column).alias(column))
    return keys.join(present, column, "left_anti")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key is missing from the parent."""
    missing = orphan_keys(child, column, parent, parent_column).select(column)
    return child.join(missing, column, "left_semi")


def _type_violation(c: Column, dtype: T.DataType, declared: tuple) -> dict[str, Column]:
    """Predicates (rule -> violation) for one column and its declared type."""
    kind = declared[0]
    is_text = isinstance(dtype, T.StringType)
    if kind == "varchar":
        return {"varchar": F.length(c.cast("string")) > declared[1]}
    if kind in INT_RANGE:
        lo, hi = INT_RANGE[kind]
        if is_text:
            as_long = c.try_cast("bigint")
            return {kind: c.isNotNull() & (as_long.isNull() | (as_long < lo) | (as_long > hi))}
        if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return {kind: (c < lo) | (c > hi)}
        # A typed fraction would be rounded by the store, as the text of one is refused.
        fraction = F.rint(c.cast("double")) != c.cast("double")
        return {kind: c.isNotNull() & (F.isnan(c.cast("double")) | (c < lo) | (c > hi) | fraction)}
    if kind == "decimal":
        precision, scale = declared[1], declared[2]
        fitted = c.try_cast(T.DecimalType(precision, scale))
        exact = c.try_cast(T.DecimalType(38, 10))
        return {
            "decimal": c.isNotNull() & fitted.isNull(),
            # More decimals than the scale: the store rounds them silently.
            "decimal_scale": fitted.isNotNull() & (exact != fitted),
        }
    if kind == "date":
        if is_text:
            return {"date": c.isNotNull() & c.try_cast("date").isNull()}
        return {}
    raise ValueError(f"unknown declared type {declared}")


def _type_checks(df: DataFrame, declared: dict[str, tuple]) -> list[tuple[str, str, Column]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = []
    for column, decl in declared.items():
        if column in types:
            for rule, pred in _type_violation(F.col(column), types[column], decl).items():
                checks.append((rule, column, pred))
    return checks


def _row_report(df: DataFrame, table: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """Count every (rule, column, predicate) in ONE aggregate pass over the
    table, then turn the single wide row into report rows."""
    if not checks:
        return _empty_report(df)
    wide = df.agg(*[F.count_if(pred).alias(f"c{i}") for i, (_, _, pred) in enumerate(checks)])
    stack = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("columns"), F.col(f"c{i}").alias("violations"))
                for i, (rule, column, _) in enumerate(checks)
            ]
        )
    )
    return wide.select(stack.alias("r")).select(F.lit(table).alias("table"), "r.rule", "r.columns", "r.violations")


def _null_checks(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str, Column]]:
    return [("not_null", c, F.col(c).isNull()) for c in columns if c in df.columns]


def null_violations(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column in one pass: (table, rule, columns, violations)."""
    return _row_report(df, table, _null_checks(df, columns or df.columns))


def type_violations(df: DataFrame, table: str, declared: dict[str, tuple] | None = None) -> DataFrame:
    """Violations of the declared types and lengths, one pass over the table:
    (table, rule, columns, violations)."""
    declared = DECLARED[table] if declared is None else declared
    return _row_report(df, table, _type_checks(df, declared))


def row_checks(df: DataFrame, table: str, declared: dict[str, tuple] | None = None) -> DataFrame:
    """NOT NULL and declared-type checks of one table together, in one scan; and
    lines that do not fit the columns, where the read kept them."""
    return _row_report(df, table, _row_rules(df, table, declared))


def _row_rules(df: DataFrame, table: str, declared: dict[str, tuple] | None = None) -> list[tuple[str, str, Column]]:
    declared = DECLARED[table] if declared is None else declared
    corrupt = [("corrupt", CORRUPT, F.col(CORRUPT).isNotNull())] if CORRUPT in df.columns else []
    return _null_checks(df, list(declared)) + _type_checks(df, declared) + corrupt


BROKEN = "_broken"


def offending_rows(df: DataFrame, table: str, declared: dict[str, tuple] | None = None) -> DataFrame:
    """Rows that break a NOT NULL or type rule, with all the rules each breaks in
    ``_broken``: an array of (rule, columns, value), the cell as text. One scan, no shuffle."""
    found = [
        F.when(pred, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("columns"), F.col(c).cast("string").alias("value")))
        for rule, c, pred in _row_rules(df, table, declared)
    ]
    if not found:
        return df.withColumn(BROKEN, F.expr("cast(array() as array<struct<rule:string,columns:string,value:string>>)")).limit(0)
    return df.withColumn(BROKEN, F.array_compact(F.array(*found))).where(F.size(BROKEN) > 0)


def offending_cells(
    df: DataFrame, table: str, keys: Sequence[str] | None = None, declared: dict[str, tuple] | None = None
) -> DataFrame:
    """(table, rule, columns, key, value): one row for each rule a row breaks. ``key`` is the
    row's primary key as text, a JSON object if it has several columns."""
    keys = [k for k in (keys or PRIMARY_KEYS[table]) if k in df.columns]
    rows = offending_rows(df, table, declared).select(_key_text(keys).alias("key"), F.explode(BROKEN).alias("b"))
    return rows.select(F.lit(table).alias("table"), "b.rule", "b.columns", "key", "b.value")


def clean_rows(df: DataFrame, table: str, declared: dict[str, tuple] | None = None) -> DataFrame:
    """The other rows: those that break no rule of their own cells."""
    broken = [F.coalesce(pred, F.lit(False)) for _, _, pred in _row_rules(df, table, declared)]
    kept = df
    for pred in broken:
        kept = kept.where(~pred)
    return kept


def write_offending(tables: dict[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write the offending rows of each table once, whole, as a publication at
    ``base/<table>`` partitioned by rule and column; a row that breaks two rules is in both."""
    out = {}
    for name, df in tables.items():
        rows = offending_rows(df, name)
        cells = rows.select(*[F.col(c) for c in df.columns], F.explode(BROKEN).alias("b"))
        flat = cells.select(*[F.col(c) for c in df.columns], F.col("b.rule").alias("_rule"), F.col("b.columns").alias("_column"))
        out[name] = publish_files(flat, f"{base.rstrip('/')}/{name}", fmt, partition_by=("_rule", "_column"))
    return out


def _empty_report(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "table string, rule string, columns string, violations bigint"
    )


def _key_text(columns: Sequence[str]) -> Column:
    """Key values as one text, nulls told apart from texts."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("string")
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})


# (rule, key) pairs that a task counts.
TASK_PAIRS = 2_000_000
# Slices of a table that a task counts one by one.
SLICES = 16


def _key_counts(df: DataFrame, table: str, keys: list[tuple[int, Column]], n: int | None, known: bool) -> DataFrame:
    """(rule, key, n, known): how often a table has each of its keys, or, ``known``, that it has
    them. With ``n`` the rows are dealt to so many tasks by slices, and a key has a
    row for each slice it is in; else each row's keys are given as they are."""
    ones = lambda: F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"k{r}").alias("key")) for r, _ in keys]))
    rows = [key.alias(f"k{r}") for r, key in keys]
    count = F.lit(0).cast("long") if known else F.lit(1).cast("long")
    if n is None:
        return df.select(*rows).select(ones()).select("rule", "key", count.alias("n"), F.lit(known).alias("known"))
    # The table's own key as well, so that rows of one hot reference are in all slices.
    own = [F.col(k) for k in PRIMARY_KEYS.get(table, ()) if k in df.columns]
    piece = F.pmod(F.xxhash64(*[key for _, key in keys], *own), F.lit(n * SLICES)).alias("slice")
    pairs = df.select(*rows, piece).repartition(n, "slice").select("slice", ones())
    return pairs.groupBy("slice", "rule", "key").agg(F.sum(count).alias("n")).select("rule", "key", "n", F.lit(known).alias("known"))


def key_report(
    tables: dict[str, DataFrame],
    primary: dict[str, Sequence[str]] | None = None,
    references: Sequence[tuple[str, str, str, str]] = (),
) -> DataFrame:
    """Primary keys and references together: (table, rule, columns, violations).

    Each table is scanned once for all its own keys, after a count of its rows: a row
    becomes one (rule, key) pair per rule, pairs are counted (combined before the shuffle, so
    a hot key is one row per slice), and a parent's keys are counted with its children's,
    as known, which finds what is missing. The number of tasks grows with the pairs.
    Violations are key values that repeat, and rows whose key has no parent.
    """
    primary = primary or {}
    rules: list[tuple[str, str, str]] = []
    child: dict[str, list[tuple[int, Column]]] = {}
    parent: dict[str, list[tuple[int, Column]]] = {}

    def add(side: dict[str, list[tuple[int, Column]]], table: str, key: Column) -> None:
        side.setdefault(table, []).append((len(rules), key))

    for table, keys in primary.items():
        if all(k in tables[table].columns for k in keys):
            add(child, table, _key_text(keys))
            rules.append((table, "primary_key", ",".join(keys)))
    for table, column, up, up_column in references:
        if column in tables[table].columns and up_column in tables[up].columns:
            add(child, table, F.col(column).cast("string"))
            add(parent, up, F.col(up_column).cast("string"))
            rules.append((table, "foreign_key", f"{column}->{up}.{up_column}"))
    pairs = {t: tables[t].count() * (len(child.get(t, ())) + len(parent.get(t, ()))) for t in {**child, **parent}}
    n = partitions_for(sum(pairs.values()), TASK_PAIRS)
    parts = [
        _key_counts(tables[t], t, keys, n and partitions_for(pairs[t], TASK_PAIRS), known)
        for side, known in ((child, False), (parent, True))
        for t, keys in side.items()
    ]
    counts = _union(parts)
    counts = (counts.repartition(n, "rule", "key") if n else counts).groupBy("rule", "key")
    counts = counts.agg(F.sum("n").alias("n"), F.max("known").alias("known"))
    is_rule = lambda i: F.col("rule") == i
    found = [
        F.count_if(is_rule(i) & (F.col("n") > 1)).alias(f"c{i}")
        if kind == "primary_key"
        else F.coalesce(F.sum(F.when(is_rule(i) & ~F.col("known") & F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias(f"c{i}")
        for i, (_, kind, _) in enumerate(rules)
    ]
    rows = [
        F.struct(F.lit(t).alias("table"), F.lit(r).alias("rule"), F.lit(c).alias("columns"), F.col(f"c{i}").alias("violations"))
        for i, (t, r, c) in enumerate(rules)
    ]
    return counts.agg(*found).select(F.inline(F.array(*rows)))


def foreign_key_report(tables: Tables) -> DataFrame:
    """Orphan rows per declared reference whose columns exist."""
    return key_report(tables.as_dict(), references=FOREIGN_KEYS)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_report(tables: Tables) -> DataFrame:
    """All checks on the tables that have the columns they need: one scan of
    each table for its keys and one for its rows, after a count of its rows."""
    named = tables.as_dict()
    return _union([key_report(named, PRIMARY_KEYS, FOREIGN_KEYS), *[row_checks(df, name) for name, df in named.items()]])
