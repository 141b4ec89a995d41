"""Quality gate in front of the dashboard.

The store the original job read enforced its keys, references and NOT NULL
constraints on insert; files do not. The gate runs the same checks as Spark
jobs and stops the run when a blocking rule is violated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.operators.quality import quality_report
from learnlens.tables import Tables

BLOCKING = ("primary_key", "not_null", "foreign_key")


class QualityError(ValueError):
    def __init__(self, failures: list[dict]):
        self.failures = failures
        lines = ", ".join(f"{f['table']}.{f['columns']} {f['rule']}={f['violations']}" for f in failures)
        super().__init__(f"quality gate failed: {lines}")


def quality_gate(tables: Tables, blocking: Sequence[str] = BLOCKING) -> DataFrame:
    """Run every check; raise ``QualityError`` if a blocking rule has
    violations, else return the report (already computed, cached).

    The report has one row per (table, rule, column) — a few dozen rows —
    so reading the failures on the driver does not move table data.
    """
    report = quality_report(tables).cache()
    failures = [
        r.asDict()
        for r in report.where(F.col("rule").isin(list(blocking)) & (F.col("violations") > 0)).collect()
    ]
    if failures:
        report.unpersist()
        raise QualityError(sorted(failures, key=lambda f: (f["table"], f["rule"], f["columns"])))
    return report
