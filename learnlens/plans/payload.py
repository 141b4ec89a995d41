"""The two JSON documents the original dashboard served.

``dashboard_payload``: ``overview`` as one object, the six row lists, and
``recommendations`` as ``{title, detail}`` objects (role-scoped if asked).
``chart_payload``: ``{categories, values}`` of the course panel. Parts of at
most ``PART_ROWS`` rows are put together on the driver. A larger part (an
uncapped risk list, a very large catalogue) does not pass through it:
``write_payload`` writes it as JSON lines beside the document, which then names
the folder, and the functions that return a document refuse it.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json

from pyspark.sql import DataFrame, SparkSession

from learnlens.operators.panels import skill_score_rows
from learnlens.plans.dashboard import ACCOUNT, Dashboard, collect_dashboard, scoped, write_dashboard

PART_ROWS = 10_000
BOUNDED = ("overview", "recommendations")
PANELS = (
    "overview", "course_effect", "tag_weakness", "format_usage",
    "weekly_activity", "score_distribution", "learner_risk", "recommendations",
)


def _parts(dash: Dashboard, role, allowed_tags, organization, scope_first: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(small, large) parts; the served risk list keeps its cap in a scope too."""
    panels = dict(scoped(dash, role, allowed_tags, organization, scope_first) if role else dash.panels)
    if dash.params.risk_table_limit:
        panels["learner_risk"] = panels["learner_risk"].limit(dash.params.risk_table_limit)
    small, large = {}, {}
    for name in PANELS:
        fits = name in BOUNDED or panels[name].limit(PART_ROWS + 1).count() <= PART_ROWS
        (small if fits else large)[name] = panels[name]
    return small, large


def _document(small: dict[str, DataFrame]) -> dict:
    rows = collect_dashboard(small)
    out = {name: rows[name] for name in PANELS if name in rows}
    out["overview"] = rows["overview"][0] if rows["overview"] else {}
    out["recommendations"] = [{"title": r["title"], "detail": r["detail"]} for r in rows["recommendations"]]
    return out


def dashboard_payload(
    dash: Dashboard, role: str | None = None, allowed_tags=ACCOUNT, organization=ACCOUNT, scope_first: bool = False
) -> dict:
    small, large = _parts(dash, role, allowed_tags, organization, scope_first)
    if large:
        raise ValueError(f"more than {PART_ROWS} rows in {', '.join(large)}: use write_payload")
    return _document(small)


def write_payload(
    dash: Dashboard, uri: str, role: str | None = None, allowed_tags=ACCOUNT, organization=ACCOUNT, scope_first: bool = False
) -> str:
    """The dashboard document under ``uri/dashboard``, large parts beside it."""
    base = uri.rstrip("/")
    small, large = _parts(dash, role, allowed_tags, organization, scope_first)
    doc = _document(small)
    doc.update({name: {"files": path} for name, path in write_dashboard(large, base).items()})
    return write_document(dash.learner_course.sparkSession, doc, f"{base}/dashboard")


def chart_payload(dash: Dashboard) -> dict:
    rows = skill_score_rows(dash.course_effect, dash.params).limit(PART_ROWS + 1).collect()
    if len(rows) > PART_ROWS:
        raise ValueError(f"more than {PART_ROWS} courses: use skill_score_rows")
    return {"categories": [r.course_name for r in rows], "values": [r.avg_score for r in rows]}


def write_chart(dash: Dashboard, uri: str) -> str:
    """The chart document under ``uri/chart``; of more than ``PART_ROWS`` courses the rows
    lie beside it as JSON lines, in order, and the document names the folder."""
    rows = skill_score_rows(dash.course_effect, dash.params)
    if rows.limit(PART_ROWS + 1).count() > PART_ROWS:
        doc = {"files": write_dashboard({"chart_rows": rows}, uri)["chart_rows"]}
    else:
        doc = chart_payload(dash)
    return write_document(dash.learner_course.sparkSession, doc, f"{uri.rstrip('/')}/chart")


def to_json(doc: dict) -> str:
    def default(v):
        if isinstance(v, (dt.date, dt.datetime)):
            return v.isoformat()
        if isinstance(v, decimal.Decimal):
            return float(v)
        raise TypeError(f"not JSON serialisable: {type(v)}")

    return json.dumps(doc, ensure_ascii=False, default=default)


def write_document(spark: SparkSession, doc: dict, uri: str) -> str:
    """One JSON document as a single text file under ``uri`` (any file
    system Spark can write to)."""
    df: DataFrame = spark.createDataFrame([(to_json(doc),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(uri)
    return uri
