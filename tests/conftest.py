from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

from pyspark.sql import SparkSession  # noqa: E402

from learnlens.schemas import SCHEMAS  # noqa: E402
from learnlens.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .appName("learnlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # Broadcast only on measured sizes: no static (file-size estimate)
        # broadcast; AQE converts a join once a shuffle stage has measured
        # its side below the adaptive threshold.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "16MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not (s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getCheckpointDir()):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="learnlens-test-ckpt-"))
    yield s
    s.stop()


D = dt.date


def micro_rows():
    students = [
        ("S1", "Ann", 30, "OrgA", "nurse", "pc", D(2025, 1, 1)),
        ("S2", "Bob", 40, "OrgB", "nurse", "mobile", D(2025, 1, 1)),
        ("S3", "Cy", 50, "OrgA", "aide", "pc", D(2025, 1, 1)),
    ]
    courses = [
        ("C1", "Basics", "K1", "T1", "初级", 4),
        ("C2", "Falls", "K2", "T2", "中级", 6),
        ("C3", "Unused", "K2", "T3", "高级", 8),
    ]
    resources = [
        ("R1", "C1", "Basics video", "video", 10, "pc"),
        ("R2", "C1", "Basics quiz", "quiz", 5, "both"),
        ("R3", "C2", "Falls video", "video", 12, "mobile"),
    ]
    events = [
        ("E1", "S1", "C1", "R1", D(2026, 4, 1), 30, 90, 1, "pc"),
        ("E2", "S1", "C1", "R2", D(2026, 4, 6), 20, 100, 1, "pc"),
        ("E3", "S2", "C1", "R1", D(2026, 4, 5), 10, 40, 0, "mobile"),
        ("E4", "S3", "C2", "R3", D(2026, 4, 6), 5, 20, 0, "pc"),
        ("E5", "S2", "C2", "R9", D(2026, 4, 7), 60, 50, 0, "mobile"),
        ("E6", "S1", "C2", "R3", D(2026, 4, 8), 12, 70, 1, "pc"),
    ]
    scores = [
        ("S1", "C1", 80.0, 88.0, 90.0, 95.0),
        ("S2", "C1", 50.0, 59.99, 60.0, 80.0),
        ("S2", "C2", 70.0, 70.0, 70.0, 90.0),
        ("S3", "C2", 30.0, 30.0, 40.0, 60.0),
        ("S3", "C1", 60.0, 60.0, 60.0, 70.0),
        ("S9", "C1", 75.0, 75.0, 75.0, 75.0),
    ]
    return {"students": students, "courses": courses, "resources": resources, "events": events, "scores": scores}


def make_tables(spark, rows: dict) -> Tables:
    return Tables.from_dict({n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()})


@pytest.fixture(scope="session")
def micro(spark) -> Tables:
    return make_tables(spark, micro_rows())
