"""The five training tables: Spark schemas, keys, references, declared types."""

from __future__ import annotations

from pyspark.sql import types as T

TABLES = ("students", "courses", "resources", "events", "scores")


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in cols])


S, I, D, DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.DateType()

# --- Fixed values (must equal the original store's; natural order) ----------
# Columns and types of the five tables.
SCHEMAS: dict[str, T.StructType] = {
    "students": _schema(
        ("student_id", S), ("student_name", S), ("age", I), ("organization", S),
        ("position", S), ("platform", S), ("enroll_date", DT),
    ),
    "courses": _schema(
        ("course_id", S), ("course_name", S), ("category", S), ("tag", S),
        ("difficulty", S), ("hours", I),
    ),
    "resources": _schema(
        ("resource_id", S), ("course_id", S), ("resource_title", S), ("format", S),
        ("duration_minutes", I), ("terminal", S),
    ),
    "events": _schema(
        ("event_id", S), ("student_id", S), ("course_id", S), ("resource_id", S),
        ("event_date", DT), ("duration_minutes", I), ("progress_percent", I),
        ("completed", I), ("device", S),
    ),
    "scores": _schema(
        ("student_id", S), ("course_id", S), ("midterm_score", D), ("final_score", D),
        ("practical_score", D), ("attendance_rate", D),
    ),
}

# File names of the CSV layout (one file or directory per table).
FILE_NAMES = {
    "students": "students.csv",
    "courses": "courses.csv",
    "resources": "resources.csv",
    "events": "learning_events.csv",
    "scores": "assessment_scores.csv",
}

# Table names of the SQL layout.
SQL_TABLES = {
    "students": "students",
    "courses": "courses",
    "resources": "resources",
    "events": "learning_events",
    "scores": "assessment_scores",
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "students": ("student_id",),
    "courses": ("course_id",),
    "resources": ("resource_id",),
    "events": ("event_id",),
    "scores": ("student_id", "course_id"),
}

# (child table, column, parent table, parent column)
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("resources", "course_id", "courses", "course_id"),
    ("events", "student_id", "students", "student_id"),
    ("events", "course_id", "courses", "course_id"),
    ("events", "resource_id", "resources", "resource_id"),
    ("scores", "student_id", "students", "student_id"),
    ("scores", "course_id", "courses", "course_id"),
)

# Declared SQL types of the store: ("varchar", n) | ("int",) | ("tinyint",)
# | ("decimal", precision, scale) | ("date",). Every column is NOT NULL.
DECLARED: dict[str, dict[str, tuple]] = {
    "students": {
        "student_id": ("varchar", 16), "student_name": ("varchar", 32), "age": ("int",),
        "organization": ("varchar", 64), "position": ("varchar", 32),
        "platform": ("varchar", 16), "enroll_date": ("date",),
    },
    "courses": {
        "course_id": ("varchar", 16), "course_name": ("varchar", 128),
        "category": ("varchar", 32), "tag": ("varchar", 32),
        "difficulty": ("varchar", 16), "hours": ("int",),
    },
    "resources": {
        "resource_id": ("varchar", 16), "course_id": ("varchar", 16),
        "resource_title": ("varchar", 128), "format": ("varchar", 24),
        "duration_minutes": ("int",), "terminal": ("varchar", 16),
    },
    "events": {
        "event_id": ("varchar", 20), "student_id": ("varchar", 16),
        "course_id": ("varchar", 16), "resource_id": ("varchar", 16),
        "event_date": ("date",), "duration_minutes": ("int",),
        "progress_percent": ("int",), "completed": ("tinyint",), "device": ("varchar", 16),
    },
    "scores": {
        "student_id": ("varchar", 16), "course_id": ("varchar", 16),
        "midterm_score": ("decimal", 5, 2), "final_score": ("decimal", 5, 2),
        "practical_score": ("decimal", 5, 2), "attendance_rate": ("decimal", 5, 2),
    },
}

# -----------------------------------------------------------------------------

# Where a CSV read keeps the source line of a row that does not fit its columns.
CORRUPT = "_corrupt_record"

# Columns of the SQL projections, in store order.
COLUMNS = {name: tuple(f.name for f in schema.fields) for name, schema in SCHEMAS.items()}
