"""learnlens: training analytics on Spark DataFrames.

Reads learners, courses, resources, learning events and assessment scores,
checks them, builds one wide learner-by-course table and derives the
dashboard panels, filtered views and role scopes from it.

    from learnlens import load_tables, build_dashboard, write_dashboard
    dash = build_dashboard(load_tables(spark, "parquet", base))
    write_dashboard(dash.panels, out)
"""

from learnlens.operators.features import learner_course
from learnlens.operators.quality import quality_report
from learnlens.params import DEFAULTS, Params
from learnlens.plans.dashboard import (
    build_dashboard,
    collect_dashboard,
    filtered_view,
    scoped,
    skill_scores,
    write_dashboard,
)
from learnlens.plans.gate import QualityError, quality_gate
from learnlens.plans.payload import chart_payload, dashboard_payload
from learnlens.sources.readers import load_tables
from learnlens.tables import Tables

__all__ = [
    "DEFAULTS",
    "Params",
    "QualityError",
    "Tables",
    "build_dashboard",
    "chart_payload",
    "collect_dashboard",
    "dashboard_payload",
    "filtered_view",
    "learner_course",
    "load_tables",
    "quality_gate",
    "quality_report",
    "scoped",
    "skill_scores",
    "write_dashboard",
]
