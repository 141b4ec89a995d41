"""Write PLANS.md: final adaptive physical plans of the main operators.

Runs each operator once over the five tables stored as Parquet (derived from
the test tables at $BENCH_SF_DIR, default sf0.1), then prints the plan Spark
actually executed (``isFinalPlan=true``).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from learnlens.operators import panels as P  # noqa: E402
from learnlens.operators import quality as Q  # noqa: E402
from learnlens.operators import cubes, distinct  # noqa: E402
from learnlens.operators import views as V  # noqa: E402
from learnlens.operators.features import PANEL_COLUMNS, learner_course  # noqa: E402
from learnlens.operators.search import trigram_index  # noqa: E402
from learnlens.plans import refresh  # noqa: E402
from learnlens.schemas import FOREIGN_KEYS, PRIMARY_KEYS  # noqa: E402
from learnlens.session import local_session, scratch_path, stored  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from learnlens.sources import readers, writers  # noqa: E402
from learnlens.sources.testdata import training_tables  # noqa: E402


def final_plan(df) -> str:
    df.collect()  # executes this DataFrame's own plan, so AQE finalises it
    text = df._jdf.queryExecution().executedPlan().toString()
    text = re.sub(r"#\d+L?", "", text)  # expression ids
    text = re.sub(r"\[plan_id=\d+\]", "", text)
    text = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[[^\]]*\]", "Location: <table>", text)
    return "\n".join(line[:220] for line in text.splitlines())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(cores=8, shuffle_partitions=16, app="learnlens-plans")
    spark.sparkContext.setLogLevel("ERROR")
    base = scratch_path(spark, "plan_tables")
    for name, df in training_tables(spark, sf_dir).as_dict().items():
        df.write.parquet(f"{base}/{name}.parquet")
    t = readers.load_tables(spark, "parquet", base)
    lc = learner_course(t).select(*PANEL_COLUMNS)
    items = {
        "learner_course (wide table, 12 panel columns)": lc,
        "course_effect": P.course_effect(lc),
        "top_risk_per_learner": P.top_risk_per_learner(lc),
        "risk_list (capped)": P.risk_list(lc),
        "format_usage": P.format_usage(t.events, t.resources),
        "weekly_activity": P.weekly_activity(t.events),
        "overview (learner part; the course count comes from the stored course panel)": P.overview(lc, courses=False),
        "primary keys and references (quality, one scan per table)": Q.key_report(t.as_dict(), PRIMARY_KEYS, FOREIGN_KEYS),
        "NOT NULL and type checks of events (quality, one scan)": Q.row_checks(t.events, "events"),
        "upsert: latest incoming row per key": writers.upsert_by_key(
            t.scores,
            t.events.select(
                "student_id", "course_id", (F.col("progress_percent") / 1.0).alias("final_score"), "event_date", "event_id"
            ),
            ["student_id", "course_id"],
            ["event_date", "event_id"],
        ),
    }
    risks = stored(P.top_risk_per_learner(lc), "risks")
    grams = stored(trigram_index(risks, "student_id", V.SEARCHED), "grams")
    states = scratch_path(spark, "states")
    day = F.col("event_date")
    refresh.add_events(spark, states, t.events.where(day < "1997-01-01"), "old")
    old, batch = refresh.states(spark, states)["resources"], t.events.where(day >= "1997-01-01")
    learners = distinct.numbered(t.students.select("student_id"))
    items |= {
        "risk positions without a cap (the stored, sorted rows; offsets of the ranges)": P.risk_positions(risks),
        "champions by (learner, tag)": P.risk_champions(lc),
        "risk cube (counts by tag and threshold; the total from the tags)": cubes.risk_cube(risks),
        "keyword search by trigrams": V.search_risks(risks, grams, None, 0.0, "machinery"),
        "distinct learners as bitmaps": distinct.distinct_bits(lc, "student_id", learners),
        "incremental refresh: the stored state and a batch of events": refresh.merge_states(
            "resources", [old, refresh.event_states(batch)["resources"]]
        ),
        "pair features from the stored state": refresh.pair_features(old),
        "offending rows of events (one scan, no shuffle)": Q.offending_rows(t.events, "events"),
    }
    out = [
        "# Final physical plans",
        "",
        f"Generated by `tools/show_plans.py` on `local[8]`, {os.path.basename(sf_dir)}, tables stored as Parquet,",
        "sessions as in `learnlens.session.local_session` (static broadcast off, AQE on).",
        "",
    ]
    for title, df in items.items():
        out += [f"## {title}", "", "```", final_plan(df), "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)
    spark.stop()


if __name__ == "__main__":
    main()
