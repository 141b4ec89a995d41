"""Sinks: JDBC refresh, key upsert and JSON rows (publications: ``publications``, stored upserts: ``keyed``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnlens.schemas import COLUMNS, FOREIGN_KEYS, PRIMARY_KEYS, SQL_TABLES, TABLES


def staging(table: str) -> str:
    return f"{table}__new"


def _former(table: str) -> str:
    return f"{table}__old"


def _drop(names: Sequence[str], suffixed) -> list[str]:
    """Children first, so no dropped table is referenced."""
    return [f"DROP TABLE IF EXISTS `{suffixed(SQL_TABLES[n])}`" for n in reversed(names)]


def staging_statements(names: Sequence[str] = TABLES) -> list[str]:
    """SQL that makes empty staging tables like the live ones, parents first. A copied
    table has the keys but not the references, so they are declared again, between the
    staging tables (a later rename keeps them)."""
    order = [n for n in TABLES if n in names]
    missing = sorted({c for c, _, p, _ in FOREIGN_KEYS if p in order and c not in order})
    if missing:
        # A table that stays would keep its references to the replaced parent.
        raise ValueError(f"{', '.join(missing)} must be refreshed with their parents")
    out = _drop(order, staging) + _drop(order, _former)
    for n in order:
        out.append(f"CREATE TABLE `{staging(SQL_TABLES[n])}` LIKE `{SQL_TABLES[n]}`")
        for child, column, parent, key in FOREIGN_KEYS:
            if child == n:
                up = staging(SQL_TABLES[parent]) if parent in order else SQL_TABLES[parent]
                out.append(f"ALTER TABLE `{staging(SQL_TABLES[n])}` ADD FOREIGN KEY (`{column}`) REFERENCES `{up}` (`{key}`)")
    return out


def switch_statements(names: Sequence[str] = TABLES) -> list[str]:
    """SQL that puts the filled staging tables in place, all in one atomic statement,
    and drops the former ones."""
    order = [n for n in TABLES if n in names]
    renames = [f"`{SQL_TABLES[n]}` TO `{_former(SQL_TABLES[n])}`, `{staging(SQL_TABLES[n])}` TO `{SQL_TABLES[n]}`" for n in order]
    return [f"RENAME TABLE {', '.join(renames)}", *_drop(order, _former)]


def _run_statements(spark: SparkSession, url: str, properties: dict[str, str], statements: Sequence[str]) -> None:
    """In turn, on one driver connection."""
    manager, info = spark._jvm.java.sql.DriverManager, spark._jvm.java.util.Properties()
    for key, value in properties.items():
        info.setProperty(key, value)
    connection = manager.getConnection(url, info)
    try:
        for sql in statements:
            connection.createStatement().execute(sql)
    finally:
        connection.close()


def jdbc_full_refresh(
    tables: dict[str, DataFrame],
    url: str,
    properties: dict[str, str] | None = None,
    order: dict[str, Sequence[str]] | None = None,
    run=_run_statements,
) -> list[str]:
    """Replace the rows of the given tables (all five, usually).

    The rows go to staging tables, parents first, in parallel from the executors; then
    one statement renames all of them into place. Whatever fails before, a violated
    reference included, leaves the live tables as they were; a further run starts anew.
    Of the rows of a repeated primary key the last by ``order`` (columns by table;
    all values without one) is stored, as an insert that updates on a repeated key
    would leave it. Returns the tables in the order of the inserts."""
    properties = properties or {}
    names = [n for n in TABLES if n in tables]
    spark = tables[names[0]].sparkSession
    run(spark, url, properties, staging_statements(names))
    for name in names:
        unique_rows(name, tables[name], (order or {}).get(name)).write.jdbc(
            url, staging(SQL_TABLES[name]), mode="append", properties=properties
        )
    run(spark, url, properties, switch_statements(names))
    return names


def unique_rows(name: str, df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The stored columns of a training table with one row for each primary key. Rows
    with a null in the key are no repetition; the store rejects them."""
    keys = [k for k in PRIMARY_KEYS[name] if k in df.columns]
    last = latest_by_key(df, keys, order or [c for c in df.columns if c not in keys]) if keys else df
    return last.select(*[c for c in COLUMNS[name] if c in df.columns])


def latest_by_key(incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``order`` (ascending; later wins).

    ``max(struct(order..., values...))`` is an ordinary aggregate, so it is
    combined map-side: a key that holds a third of the rows is reduced in
    every partition before the shuffle instead of landing in one task.
    The order columns should make rows unique per key; remaining ties are
    broken by the value columns, so the result is still deterministic.
    """
    keys = list(keys)
    values = [c for c in incoming.columns if c not in keys]
    packed = F.struct(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(c) for c in values]
    )
    last = incoming.groupBy(*keys).agg(F.max(packed).alias("_last"))
    return last.select(*keys, *[F.col("_last").getField(c).alias(c) for c in values]).select(*incoming.columns)


def upsert_by_key(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Target rows whose key is not updated, plus the latest incoming row per
    key (a later row replaces all fields). ``order`` defaults to the row
    values, which only makes sense when duplicates are identical."""
    keys = list(keys)
    latest = latest_by_key(incoming, keys, order or [c for c in incoming.columns if c not in keys])
    kept = target.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def rows_to_json(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One JSON object per row (column ``json``); a cap of 0 or None means
    no cap."""
    capped = df.limit(limit) if limit else df
    return capped.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
