"""The dashboard as a set of DataFrames over one shared wide table.

``build_dashboard`` materialises the wide table once, and then everything
that is small and read again: the panels, each learner's riskiest course and
the overview. Views, scopes and the served documents are predicates on these
stored results and never go back to the wide table. ``write_dashboard`` writes
each panel with a parallel writer instead of collecting it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from learnlens.functions.expressions import clean_keyword
from learnlens.operators import cubes
from learnlens.operators import panels as P
from learnlens.operators.features import PANEL_COLUMNS, learner_course
from learnlens.operators.recommend import recommendations, recommendations_filtered
from learnlens.operators.search import trigram_index
from learnlens.operators.views import (
    SEARCHED,
    card_texts,
    filter_courses,
    filter_options,
    filter_risks,
    filter_tags,
    formatted_cards,
    metric_cards,
    rounded_cards,
    scope_organization,
    scope_teacher,
    search_risks,
)
from learnlens.params import DEFAULTS, Params
from learnlens.session import file_marks, remove_scratch, scratch_path, shared_root
from learnlens.tables import Tables

MATERIALIZE = ("table", "checkpoint", "persist", "none")


@dataclass
class Dashboard:
    """``learner_risk`` has every learner; the cap applies only to the panel
    of that name, which is what the served list shows. The champions and the
    cubes, which only some views and scopes read, are made and kept when first asked for."""

    tables: Tables
    learner_course: DataFrame
    course_effect: DataFrame
    learner_risk: DataFrame
    tag_weakness: DataFrame
    learners: DataFrame  # the overview's row without the course count
    panels: dict[str, DataFrame]
    params: Params = DEFAULTS
    index: DataFrame | None = None  # trigrams of the risk rows
    _kept: list[DataFrame | str] = field(default_factory=list)
    _keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
    _later: dict[str, DataFrame] = field(default_factory=dict)
    _lock: Lock = field(default_factory=Lock)

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            if name not in self._later:
                self._later[name] = self._keep(name, make())
            return self._later[name]

    @property
    def champions(self) -> DataFrame:
        """Each learner's riskiest course of each tag."""
        columns = ["student_id", "course_id", *P.RISK_COLUMNS]
        return self._once("champions", lambda: P.risk_champions(self.learner_course.select(*columns)))

    @property
    def risk_cube(self) -> DataFrame:
        """Risk rows by tag and threshold."""
        return self._once("risk_cube", lambda: cubes.risk_cube(self.learner_risk, self.params))

    @property
    def course_cube(self) -> DataFrame:
        """Cards by category and tag."""
        return self._once("course_cube", lambda: cubes.course_cube(self.course_effect))

    def close(self) -> None:
        """Free what was kept: cached frames, and tables in the shared folder."""
        for kept in self._kept:
            if isinstance(kept, str):
                remove_scratch(self.learner_course.sparkSession, kept)
            else:
                kept.unpersist()
        self._kept.clear()
        self._later.clear()


def materialize(
    df: DataFrame, how: str = "table", kept: list | None = None, name: str = "learner_course", run: str | None = None
) -> DataFrame:
    """Make a reused DataFrame cheap to read again.

    ``table``: Parquet in the shared folder, read back: lineage is cut, so a
    lost executor costs a re-read, and the scan gets column pruning and filter
    pushdown. ``checkpoint``: reliable checkpoint in ``spark.checkpoint.dir``
    (same guarantees). ``persist``: memory and disk; lost blocks are recomputed
    from lineage. ``none``: recomputed by every reader. What must be freed
    later is added to ``kept``. With ``run`` (see ``run_name``) a table lies in a folder of
    that name, and one that a broken run has finished there is read and not computed again.
    """
    kept = [] if kept is None else kept
    if how == "persist":
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept[-1]
    if how == "checkpoint":
        scratch_path(df.sparkSession, "ckpt")  # makes sure the dir is set
        return df.checkpoint(eager=True)
    if how == "table":
        path = scratch_path(df.sparkSession, name) if run is None else f"{shared_root(df.sparkSession)}/learnlens/{run}/{name}"
        if run is None or not is_complete(df.sparkSession, path):
            df.write.mode("overwrite").parquet(path)
        kept.append(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    if how == "none":
        return df
    raise ValueError(f"materialize must be one of {MATERIALIZE}")


def is_complete(spark, path: str) -> bool:
    """Whether a written table has all its files: its job's last act is to say so."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def run_name(tables: Tables, params: Params) -> str | None:
    """The same for the same input files (names, sizes, times) and parameters; None for
    tables that are not read from files."""
    parts = [repr(params)]
    for name, df in tables.as_dict().items():
        files = df.inputFiles()
        if not files:
            return None
        parts.append(name)
        # One listing for each folder.
        for folder in sorted({f.rpartition("/")[0] for f in files}):
            parts.append(folder)
            parts += file_marks(df.sparkSession, folder)
        parts += sorted(files)
    return f"run-{hashlib.sha256(chr(10).join(parts).encode()).hexdigest()[:24]}"


def build_dashboard(
    tables: Tables, params: Params = DEFAULTS, how: str = "table", resume: bool = False, index: bool = False
) -> Dashboard:
    """Materialise the wide table, then the small results over it, in the same
    way; independent ones concurrently.

    ``resume``: tables are named by the inputs and parameters, and those that a broken run
    over the same inputs finished are used as they are (``how="table"`` only). ``index``: the risk
    rows also get a trigram index, which keyword searches read instead of them."""
    kept: list = []
    run = run_name(tables, params) if resume and how == "table" else None
    keep = lambda name, df: materialize(df, how, kept, name, run)
    ev = {
        "format_usage": lambda: P.format_usage(tables.events, tables.resources, params),
        "weekly_activity": lambda: P.weekly_activity(tables.events, params),
    }
    wide = {"learner_course": lambda: learner_course(tables, params).select(*PANEL_COLUMNS)}
    base = run_concurrently({**wide, **ev}, lambda name, make: keep(name, make()), first=EVENT_PANELS)
    lc = base["learner_course"]
    small = {
        "course_effect": lambda: P.course_effect(lc, params),
        "tag_weakness": lambda: P.tag_weakness(lc, params),
        "score_distribution": lambda: P.score_distribution(lc, params),
        "top_risk": lambda: P.top_risk_per_learner(lc, params),
        "learners": lambda: P.overview(lc, params, courses=False),
    }
    base.update(run_concurrently(small, lambda name, make: keep(name, make())))
    ce, risk, tw = base["course_effect"], base["top_risk"], base["tag_weakness"]
    grams = keep("index", trigram_index(risk, "student_id", SEARCHED)) if index else None
    panels = {
        "overview": P.with_course_count(base["learners"], ce),
        "course_effect": P.ordered(ce, "course_effect", params),
        "tag_weakness": P.ordered(tw, "tag_weakness", params),
        "format_usage": P.ordered(base["format_usage"], "format_usage", params),
        "weekly_activity": P.ordered(base["weekly_activity"], "weekly_activity", params),
        "score_distribution": P.ordered(base["score_distribution"], "score_distribution", params),
        "learner_risk": P.capped_risks(risk, params).select(*P.RISK_COLUMNS),
        "recommendations": recommendations(ce, params),
    }
    return Dashboard(tables, lc, ce, risk, tw, base["learners"], panels, params, grams, kept, keep)


# Panels that read only the events: started first, so they run while the
# wide table is being materialised by the others.
EVENT_PANELS = ("weekly_activity", "format_usage")


def run_concurrently(jobs: dict, fn, parallel: int = 8, first=EVENT_PANELS) -> dict:
    """Run independent Spark actions from a few driver threads, so small
    panels share the executors instead of queueing one after another.
    Results come back in the order of ``jobs``."""
    order = [n for n in first if n in jobs] + [n for n in jobs if n not in first]
    if parallel <= 1:
        done = {name: fn(name, jobs[name]) for name in order}
    else:
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            futures = {name: pool.submit(fn, name, jobs[name]) for name in order}
            done = {name: f.result() for name, f in futures.items()}
    return {name: done[name] for name in jobs}


def skill_scores(dash: Dashboard) -> DataFrame:
    return P.skill_scores(dash.course_effect)


def filtered_view(dash: Dashboard, category=None, tag=None, risk: float | None = None, keyword: str = "") -> dict[str, DataFrame]:
    """One state of the browser's filters as DataFrames."""
    p = dash.params
    courses = filter_courses(dash.course_effect, category, tag, p)
    if dash.index is not None:
        risks = search_risks(dash.learner_risk, dash.index, tag, risk, keyword, p)
    else:
        risks = filter_risks(dash.learner_risk, tag, risk, keyword, p)
    counted = None
    if clean_keyword(keyword) or not cubes.has_step(risk, p):
        cards, texts = metric_cards(courses, risks, dash.learners, p), card_texts(courses, risks, dash.learners)
    else:
        counted = cubes.risk_count(dash.risk_cube, tag, risk, p)
        values = cubes.card_values(dash.course_cube, dash.risk_cube, dash.learners, category, tag, risk, p)
        cards, texts = rounded_cards(values, p), formatted_cards(values)
    return {
        "courses": P.ordered(courses, "course_effect", p),
        "tags": P.ordered(filter_tags(dash.tag_weakness, courses, tag, p), "tag_weakness", p),
        "risks": P.ordered(risks, "learner_risk", p).select(*P.RISK_COLUMNS),
        "cards": cards,
        "card_texts": texts,
        "recommendations": recommendations_filtered(courses, risks, p, counted),
        "options": filter_options(dash.course_effect),
    }


# Marks "the account's own scope" (the params' values), as opposed to None.
ACCOUNT = object()


def scoped(
    dash: Dashboard, role: str, allowed_tags=ACCOUNT, organization=ACCOUNT, scope_first: bool = False
) -> dict[str, DataFrame]:
    """Panels as a role sees them.

    teacher: course, tag and risk rows of the allowed tags (an empty list
    shows no rows); organization manager: risk rows of the organization
    (``None``: no filter); anyone else: unfiltered. ``ACCOUNT`` (default)
    takes the scope from ``params``. By default the scope applies after
    top-1, as in the original; ``scope_first`` ranks within the scope instead, among
    each learner's champions by tag. A scope's risk rows are not capped.
    """
    p = dash.params
    out = dict(dash.panels)

    def risks(scope, what):
        rows = P.top_risk_per_learner(scope(dash.champions, what), p) if scope_first else scope(dash.learner_risk, what)
        return P.ordered(rows, "learner_risk", p).select(*P.RISK_COLUMNS)

    if role == "teacher":
        tags = p.teacher_tags if allowed_tags is ACCOUNT else (allowed_tags or [])
        out["course_effect"] = scope_teacher(out["course_effect"], tags)
        out["tag_weakness"] = scope_teacher(out["tag_weakness"], tags)
        out["learner_risk"] = risks(scope_teacher, tags)
    elif role == "organization_manager":
        org = p.manager_organization if organization is ACCOUNT else organization
        out["learner_risk"] = risks(scope_organization, org)
    return out


def collect_dashboard(panels: dict[str, DataFrame], parallel: int = 8) -> dict[str, list]:
    """Rows of every panel, for serving small results: one row, or one per
    course, tag, format, level or week label, and the capped risk list. Results
    without such a bound (an uncapped risk list, a scope's risks over many
    learners) belong to ``write_dashboard``."""
    return run_concurrently(panels, lambda name, df: [r.asDict(recursive=True) for r in df.collect()], parallel)


def write_dashboard(panels: dict[str, DataFrame], base: str, fmt: str = "json", parallel: int = 8) -> dict[str, str]:
    """Write each panel under ``base/<panel>`` (overwrite); returns the paths."""

    def write(name: str, df: DataFrame) -> str:
        path = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(path)
        return path

    return run_concurrently(panels, write, parallel)
