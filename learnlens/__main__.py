"""Command line: run the dashboard, a filtered view, a role scope or the
quality report over stored tables and write the results.

    spark-submit -m learnlens dashboard --source parquet --base hdfs://nn/training --out hdfs://nn/out/dash
    python -m learnlens view --base /data/csv --category K2 --risk 45 --keyword "org a" --out /tmp/view
    python -m learnlens scope --role teacher --tags T1 T2 --base ... --out ...
    python -m learnlens quality --base ... --out ...
    python -m learnlens payload [--role teacher] --base ... --out ...   (dashboard.json + chart.json)
    python -m learnlens publish --base /data/csv --out hdfs://nn/training --format parquet [--gate]
    python -m learnlens import --base /data/csv --out jdbc:mysql://host/db --user u --password p [--gate]

The session comes from ``SparkSession.builder.getOrCreate()``, so cluster
settings are whatever ``spark-submit`` or the environment provides.
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import replace

from pyspark.sql import SparkSession

from learnlens.operators.quality import quality_report, write_offending
from learnlens.params import DEFAULTS
from learnlens.plans.gate import quality_gate
from learnlens.plans.payload import write_chart, write_payload
from learnlens.plans.dashboard import (
    ACCOUNT,
    MATERIALIZE,
    build_dashboard,
    filtered_view,
    run_concurrently,
    scoped,
    skill_scores,
    write_dashboard,
)
from learnlens.schemas import SQL_TABLES
from learnlens.sources.readers import jdbc_predicates, load_tables, table_uri
from learnlens.sources.publications import publish_files
from learnlens.sources.writers import jdbc_full_refresh


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="learnlens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("dashboard", "view", "scope", "quality", "payload", "publish", "import"):
        s = sub.add_parser(name)
        s.add_argument("--source", default="csv", help="csv | hdfs | parquet | jdbc (any other value: csv)")
        s.add_argument("--base", help="base path or URI of the tables (file sources)")
        s.add_argument("--url", help="JDBC url (jdbc source)")
        s.add_argument("--user")
        s.add_argument("--password")
        s.add_argument("--out", required=True, help="output base path or URI")
        s.add_argument("--format", default="json", help="output format of each result (json, parquet, csv)")
        s.add_argument(
            "--materialize", default="table", choices=list(MATERIALIZE), help="how the wide table and the small results are kept"
        )
        s.add_argument("--jdbc-partitions", type=int, default=16, help="parallel queries for events and scores (jdbc source)")
        s.add_argument("--jdbc-from", type=dt.date.fromisoformat, default=dt.date(2020, 1, 1), help="first day of the events' split")
        s.add_argument("--jdbc-to", type=dt.date.fromisoformat, default=dt.date(2030, 1, 1), help="last day of the events' split")
        s.add_argument("--risk-limit", type=int, default=DEFAULTS.risk_table_limit, help="risk list cap; 0 = no cap")
        s.add_argument("--approx-rsd", type=float, help="use HyperLogLog++ distinct counts with this error")
        s.add_argument("--gate", action="store_true", help="stop if keys, references or NOT NULL are violated")
        if name == "quality":
            s.add_argument("--rows", action="store_true", help="also write the rows that break NOT NULL and type rules")
        if name == "view":
            s.add_argument("--category")
            s.add_argument("--tag")
            s.add_argument("--risk", type=float)
            s.add_argument("--keyword", default="")
        if name in ("scope", "payload"):
            s.add_argument("--role", required=name == "scope", help="teacher | organization_manager | other (no filter)")
            s.add_argument("--tags", nargs="*", help="allowed tags of a teacher (default: the account's)")
            s.add_argument("--organization", help="organization of a manager (default: the account's)")
            s.add_argument("--scope-first", action="store_true", help="rank risks within the scope")
    return p


def main(argv: list[str] | None = None) -> dict[str, str]:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"learnlens-{args.command}").getOrCreate()
    props = {k: v for k, v in (("user", args.user), ("password", args.password)) if v}
    split = {n: jdbc_predicates(n, args.jdbc_partitions, args.jdbc_from, args.jdbc_to) for n in ("events", "scores")}
    tables = load_tables(
        spark, args.source, base=args.base, url=args.url, properties=props or None,
        jdbc_partitions={n: {"predicates": p} for n, p in split.items() if p},
        # Checks see malformed cells as they are in the files.
        as_text=args.command == "quality",
        keep_corrupt=args.command == "quality" and args.source.lower() not in ("parquet", "mysql", "jdbc"),
    )
    if args.command == "quality":
        out = write_dashboard({"quality_report": quality_report(tables)}, args.out, args.format)
        if args.rows:
            rows = write_offending(tables.as_dict(), f"{args.out.rstrip('/')}/offending", args.format)
            out.update({f"offending_{name}": path for name, path in rows.items()})
        return out
    if args.gate:
        quality_gate(tables).unpersist()
    if args.command == "import":
        order = jdbc_full_refresh(tables.as_dict(), args.out, props)
        return {name: f"{args.out} {SQL_TABLES[name]}" for name in order}
    if args.command == "publish":
        # --format csv keeps the original's file names (students.csv, ...);
        # other formats write <name>.<format> directories.
        def publish(name, df):
            target = table_uri(args.out, name) if args.format == "csv" else f"{args.out.rstrip('/')}/{name}.{args.format}"
            return publish_files(df, target, args.format)

        return run_concurrently(tables.as_dict(), publish)
    params = replace(DEFAULTS, risk_table_limit=args.risk_limit, approx_distinct_rsd=args.approx_rsd)
    dash = build_dashboard(tables, params, how=args.materialize)
    try:
        if args.command == "payload":
            tags = ACCOUNT if args.tags is None else args.tags
            org = ACCOUNT if args.organization is None else args.organization
            return {
                "dashboard": write_payload(dash, args.out, args.role, tags, org, args.scope_first),
                "chart": write_chart(dash, args.out),
            }
        if args.command == "dashboard":
            results = dict(dash.panels, skill_scores=skill_scores(dash))
        elif args.command == "view":
            results = filtered_view(dash, args.category, args.tag, args.risk, args.keyword)
        else:
            tags = ACCOUNT if args.tags is None else args.tags
            org = ACCOUNT if args.organization is None else args.organization
            results = scoped(dash, args.role, tags, org, scope_first=args.scope_first)
        return write_dashboard(results, args.out, args.format)
    finally:
        dash.close()


def run(argv: list[str] | None = None) -> int:
    """Console entry: write the results and print one ``name<TAB>path`` line each."""
    for name, path in main(argv).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    raise SystemExit(run())
