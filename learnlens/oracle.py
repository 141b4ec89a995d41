"""DuckDB SQL for every registered query, over the raw test tables.

Each statement starts from the pre-registered views (``customer``,
``orders``, ``lineitem``, ...) and derives the training tables in CTEs named
``tr_*``. Engine differences handled here (all checked against Spark):
``sum`` of integers is HUGEINT in DuckDB (cast to BIGINT); ``round`` is done
on the decimal value (``r2``) to match Spark's half-up rounding of the
shortest decimal text; literals are typed DOUBLE; ascending nulls are first
in Spark, so ``NULLS FIRST`` is written out.
"""

from __future__ import annotations

from learnlens import registry as R

# --- Fixed values, written out here on their own (natural order) -------------
LEVEL_NAMES = ("优秀", "达标", "待巩固", "高风险")
LEVEL_CUTS = (85.0, 70.0, 60.0)
REC_COURSE_TITLE = "加强「{course}」专项训练"
REC_COURSE_DETAIL = "该课程平均成绩偏低，建议增加{tag}情境案例、短测验和课后复盘任务。"
REC_FIXED = (
    ("对高风险学员建立跟踪清单", "优先关注成绩低、学习进度慢、学习时长不足的学员，安排导师一对一补训。"),
    ("优化课程资源格式组合", "结合资源完成率调整视频、文档、题库和实操清单比例，提高移动端学习效率。"),
)
REC_VIEW_COURSE_TITLE = "加强「{course}」专项训练"
REC_VIEW_COURSE_DETAIL = "该课程均分 {score}，建议增加{tag}案例训练、短测和课后复盘。"
REC_VIEW_RISK_TITLE = "建立高风险学员跟踪清单"
REC_VIEW_RISK_DETAIL = "当前视角下有 {count} 名高风险学员，建议按机构、课程和标签分组补训。"
REC_VIEW_FIXED = ("复盘资源完成率", "结合视频、文档、题库和清单完成率，调整课前预习与课后巩固资源比例。")
# -----------------------------------------------------------------------------


def rnd(x: str, d: int = 2) -> str:
    return f"CAST(ROUND(CAST(({x}) AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tmpl(text: str, **parts: str) -> str:
    """A text template as a SQL concatenation; parts are SQL expressions."""
    out, rest = [], text
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if head:
            out.append(q(head))
        out.append(f"CAST(({parts[name]}) AS VARCHAR)")
    if rest:
        out.append(q(rest))
    return " || ".join(out)


LEVEL = (
    "CASE "
    + " ".join(f"WHEN final_score >= {cut} THEN {q(name)}" for name, cut in zip(LEVEL_NAMES, LEVEL_CUTS))
    + f" ELSE {q(LEVEL_NAMES[-1])} END"
)
RISK = (
    "greatest(0.0::DOUBLE, 100.0::DOUBLE - final_score * 0.72::DOUBLE - avg_progress * 0.18::DOUBLE"
    " - least(study_minutes / 12.0::DOUBLE, 10.0::DOUBLE))"
)

TR = """
tr_students AS (
  SELECT c_custkey AS student_id, c_name AS student_name, c_mktsegment AS organization FROM customer),
tr_courses AS (
  SELECT n_nationkey AS course_id, n_name AS course_name, r_name AS category,
         'TAG_' || CAST(n_nationkey % 8 AS VARCHAR) AS tag
  FROM nation JOIN region ON n_regionkey = r_regionkey),
tr_resources AS (
  SELECT p_partkey AS resource_id, p_name AS resource_title, p_type AS format, p_size AS duration_minutes FROM part),
tr_events AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS event_id,
         o_custkey AS student_id, s_nationkey AS course_id, l_partkey AS resource_id,
         CAST(l_shipdate AS DATE) AS event_date,
         CAST(trunc(l_quantity) AS INTEGER) AS duration_minutes,
         CAST(round(l_discount * 1000) AS INTEGER) AS progress_percent,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS completed,
         l_returnflag AS device
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
tr_scores AS (
  SELECT o_custkey AS student_id, CAST(o_orderkey % 25 AS INTEGER) AS course_id,
         max(o_totalprice) / 5000 AS final_score
  FROM orders GROUP BY o_custkey, CAST(o_orderkey % 25 AS INTEGER)),
feats AS (
  SELECT student_id, course_id,
         CAST(sum(duration_minutes) AS BIGINT) AS study_minutes,
         CAST(sum(completed) AS BIGINT) AS completed_resources,
         count(DISTINCT resource_id) AS accessed_resources,
         avg(progress_percent) AS avg_progress,
         max(event_date) AS last_event_date
  FROM tr_events GROUP BY student_id, course_id),
filled AS (
  SELECT s.student_id, s.course_id,
         coalesce(f.study_minutes, 0) AS study_minutes,
         coalesce(f.completed_resources, 0) AS completed_resources,
         coalesce(f.accessed_resources, 0) AS accessed_resources,
         coalesce(f.avg_progress, 0.0) AS avg_progress,
         f.last_event_date, s.final_score
  FROM feats f RIGHT JOIN tr_scores s ON f.student_id = s.student_id AND f.course_id = s.course_id),
lc AS (
  SELECT f.*, c.course_name, c.category, c.tag, st.student_name, st.organization,
         {level} AS score_level, {risk} AS risk_score
  FROM filled f JOIN tr_courses c ON f.course_id = c.course_id
       JOIN tr_students st ON f.student_id = st.student_id),
ce AS (
  SELECT course_id, course_name, category, tag,
         count(DISTINCT student_id) AS learners,
         {avg_score} AS avg_score,
         {avg_progress} AS avg_progress,
         CAST(sum(study_minutes) AS BIGINT) AS study_minutes,
         {pass_rate} AS pass_rate
  FROM lc GROUP BY course_id, course_name, category, tag),
tw AS (
  SELECT tag, count(*) AS records, {avg_score} AS avg_score, {weak_rate} AS weak_rate
  FROM lc GROUP BY tag),
ov AS (
  SELECT count(DISTINCT student_id) AS student_count, count(DISTINCT course_id) AS course_count,
         {avg_score} AS avg_score, {avg_progress} AS avg_progress,
         {hours} AS total_study_hours, {pass_rate} AS pass_rate,
         CAST(sum(CASE WHEN risk_score >= 38.0 THEN 1 ELSE 0 END) AS BIGINT) AS risk_records
  FROM lc),
top1 AS (
  SELECT student_id, student_name, organization, course_name, tag,
         {r_final} AS final_score, {r_progress} AS avg_progress, study_minutes, {r_risk} AS risk_score
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id
                  ORDER BY risk_score DESC NULLS LAST, course_id ASC NULLS FIRST) AS rn FROM lc)
  WHERE rn = 1),
risk120 AS (
  SELECT * FROM top1 ORDER BY risk_score DESC NULLS LAST, student_id ASC NULLS FIRST LIMIT 120)
""".format(
    level=LEVEL,
    risk=RISK,
    avg_score=rnd("avg(final_score)"),
    avg_progress=rnd("avg(avg_progress)"),
    pass_rate=rnd("avg(CASE WHEN final_score >= 60.0 THEN 1 ELSE 0 END) * 100"),
    weak_rate=rnd("avg(CASE WHEN final_score < 60.0 THEN 1 ELSE 0 END) * 100"),
    hours=rnd("sum(study_minutes) / 60"),
    r_final=rnd("final_score"),
    r_progress=rnd("avg_progress"),
    r_risk=rnd("risk_score"),
)


def w(body: str) -> str:
    return f"WITH {TR.strip()}\n{body.strip()}"


RISK_COLS = "student_name, organization, course_name, tag, final_score, avg_progress, study_minutes, risk_score"
TEACHER = ", ".join(q(t) for t in R.TEACHER_TAGS)
CE_ORDER = "avg_score ASC NULLS FIRST, course_id ASC NULLS FIRST"
TW_ORDER = "weak_rate DESC NULLS LAST, avg_score ASC NULLS FIRST, tag ASC NULLS FIRST"
RISK_ORDER = "risk_score DESC NULLS LAST, student_id ASC NULLS FIRST"
LEVEL_POS = "coalesce(list_position([" + ", ".join(q(n) for n in LEVEL_NAMES) + "], score_level), 0)"


def fixed(x: str, places: int) -> str:
    """The exact binary value rounded by printf, but a true tie (only a value that
    is a whole number of 1/8 or coarser can be one) goes up, not to even."""
    v = f"coalesce(CAST({x} AS DOUBLE), 0.0)"
    scale = 10**places
    tie = f"({v} * 8 = floor({v} * 8) AND {v} * {scale} - floor({v} * {scale}) = 0.5)"
    return f"CASE WHEN {tie} THEN printf('%.{places}f', (floor({v} * {scale}) + 1) / {scale}) ELSE printf('%.{places}f', {v}) END"


def pct(x: str) -> str:
    return f"({fixed(x, 1)} || '%')"


def grouped(x: str) -> str:
    return f"regexp_replace(format('{{:,.3f}}', {rnd(f'coalesce(CAST({x} AS DOUBLE), 0.0)', 3)}), '\\.?0+$', '')"


def keyword(kw: str) -> str:
    kw = kw.strip().lower()
    return (
        "contains(lower(concat_ws(' ', coalesce(CAST(student_name AS VARCHAR), 'null'), "
        "coalesce(CAST(organization AS VARCHAR), 'null'), coalesce(CAST(course_name AS VARCHAR), 'null'), "
        f"coalesce(CAST(tag AS VARCHAR), 'null'))), {q(kw)})"
    )


# Column types of the derived test tables, for the declared-type checks.
TR_TYPES = {
    "students": {"student_id": "int", "student_name": "text", "organization": "text"},
    "courses": {"course_id": "int", "course_name": "text", "category": "text", "tag": "text"},
    "resources": {"resource_id": "int", "resource_title": "text", "format": "text", "duration_minutes": "int"},
    "events": {
        "event_id": "text", "student_id": "int", "course_id": "int", "resource_id": "int", "event_date": "date",
        "duration_minutes": "int", "progress_percent": "int", "completed": "int", "device": "text",
    },
    "scores": {"student_id": "int", "course_id": "int", "final_score": "double"},
}


def _declared_cols(table: str) -> list[str]:
    from learnlens.schemas import DECLARED

    return [c for c in DECLARED[table] if c in TR_TYPES[table]]


FEATURES = (
    "student_id", "course_id", "study_minutes", "completed_resources", "accessed_resources", "avg_progress",
    "last_event_date", "final_score",
)


def not_null_sql() -> str:
    parts = []
    sources = [(t, f"tr_{t}", list(cols)) for t, cols in TR_TYPES.items()] + [("features", "filled", list(FEATURES))]
    for table, source, cols in sources:
        for c in cols:
            parts.append(
                f"SELECT {q(table)} AS \"table\", 'not_null' AS rule, {q(c)} AS columns, "
                f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {source}"
            )
    return "\nUNION ALL\n".join(parts)


def totals_sql() -> str:
    parts = []
    for t, cols in TR_TYPES.items():
        for c, kind in cols.items():
            value = {"text": f"length({c})", "date": f"({c} - DATE '2000-01-01')"}.get(kind, c)
            parts.append(
                f"SELECT {q(t)} AS \"table\", {q(c)} AS \"column\", count(*) AS rows, count({c}) AS filled, "
                f"{rnd(f'sum(CAST({value} AS DOUBLE))')} AS total FROM tr_{t}"
            )
    return "\nUNION ALL\n".join(parts)


DOCUMENT_RULES = (
    ("documents", "int", "doc_id", "doc_id < -2147483648 OR doc_id > 2147483647"),
    ("documents", "varchar", "text", "length(text) > 1000"),
    ("documents", "varchar", "lang", "length(lang) > 1"),
    ("documents", "date", "source", "source IS NOT NULL AND TRY_CAST(source AS DATE) IS NULL"),
    ("documents", "tinyint", "n_chars", "n_chars < -128 OR n_chars > 127"),
    ("cells", "tinyint", "doc_id", "doc_id < -128 OR doc_id > 127"),
    ("cells", "int", "lang", "lang IS NOT NULL AND TRY_CAST(lang AS BIGINT) IS NULL"),
    ("cells", "date", "source", "source IS NOT NULL AND TRY_CAST(source AS DATE) IS NULL"),
    ("cells", "decimal", "n_chars", "abs(n_chars) > 999"),
    ("cells", "decimal_scale", "n_chars", "false"),
)


def document_types_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(t)} AS \"table\", {q(rule)} AS rule, {q(c)} AS columns, count(*) FILTER (WHERE {pred}) AS violations FROM documents"
        for t, rule, c, pred in DOCUMENT_RULES
    )


def _type_rules(table: str) -> list[tuple[str, str, str]]:
    from learnlens.schemas import DECLARED

    rules = []
    for c in _declared_cols(table):
        decl, actual = DECLARED[table][c], TR_TYPES[table][c]
        kind = decl[0]
        if kind == "varchar":
            rules.append(("varchar", c, f"length(CAST({c} AS VARCHAR)) > {decl[1]}"))
        elif kind in ("int", "tinyint"):
            lo, hi = (-(2**31), 2**31 - 1) if kind == "int" else (-128, 127)
            if actual == "int":
                rules.append((kind, c, f"({c} < {lo} OR {c} > {hi})"))
            elif actual == "text":
                rules.append((kind, c, f"({c} IS NOT NULL AND (TRY_CAST({c} AS BIGINT) IS NULL OR TRY_CAST({c} AS BIGINT) < {lo} OR TRY_CAST({c} AS BIGINT) > {hi}))"))
            else:
                rules.append((kind, c, f"({c} IS NOT NULL AND (isnan({c}) OR {c} < {lo} OR {c} > {hi}))"))
        elif kind == "decimal":
            fit = f"TRY_CAST({c} AS DECIMAL({decl[1]},{decl[2]}))"
            rules.append(("decimal", c, f"({c} IS NOT NULL AND {fit} IS NULL)"))
            rules.append(("decimal_scale", c, f"({fit} IS NOT NULL AND TRY_CAST({c} AS DECIMAL(38,10)) <> {fit})"))
        elif kind == "date" and actual == "text":
            rules.append(("date", c, f"({c} IS NOT NULL AND TRY_CAST({c} AS DATE) IS NULL)"))
    return rules


def types_sql() -> str:
    parts = []
    for table in TR_TYPES:
        for rule, c, pred in _type_rules(table):
            parts.append(
                f"SELECT {q(table)} AS \"table\", {q(rule)} AS rule, {q(c)} AS columns, "
                f"count(*) FILTER (WHERE {pred}) AS violations FROM tr_{table}"
            )
    return "\nUNION ALL\n".join(parts)


FKS = [
    ("events", "student_id", "students", "student_id"),
    ("events", "course_id", "courses", "course_id"),
    ("events", "resource_id", "resources", "resource_id"),
    ("scores", "student_id", "students", "student_id"),
    ("scores", "course_id", "courses", "course_id"),
]


MORE_FKS = [
    ("documents", "doc_id", "labels", "doc_id"),
    ("pages", "page_id", "labels", "doc_id"),
    ("labels", "doc_id", "pages", "page_id"),
]


def more_fk_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(child)} AS \"table\", 'foreign_key' AS rule, {q(f'{c}->{parent}.{pc}')} AS columns, count(*) AS violations "
        f"FROM {child} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pc} = x.{c})"
        for child, c, parent, pc in MORE_FKS
    )


def fk_sql() -> str:
    parts = []
    for child, c, parent, pc in FKS:
        parts.append(
            f"SELECT {q(child)} AS \"table\", 'foreign_key' AS rule, {q(f'{c}->{parent}.{pc}')} AS columns, "
            f"count(*) AS violations FROM tr_{child} x WHERE x.{c} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM tr_{parent} p WHERE p.{pc} = x.{c})"
        )
    return "\nUNION ALL\n".join(parts)


PKS = {
    "students": ["student_id"], "courses": ["course_id"], "resources": ["resource_id"],
    "events": ["event_id"], "scores": ["student_id", "course_id"],
}


def report_sql() -> str:
    parts = []
    for table in TR_TYPES:
        keys = ", ".join(PKS[table])
        parts.append(
            f"SELECT {q(table)} AS \"table\", 'primary_key' AS rule, {q(','.join(PKS[table]))} AS columns, "
            f"count(*) AS violations FROM (SELECT {keys} FROM tr_{table} GROUP BY {keys} HAVING count(*) > 1)"
        )
        for c in _declared_cols(table):
            parts.append(
                f"SELECT {q(table)} AS \"table\", 'not_null' AS rule, {q(c)} AS columns, "
                f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM tr_{table}"
            )
    return "\nUNION ALL\n".join(parts + [types_sql(), fk_sql()])


def _rec_rows(weak_sql: str, title: str, detail: str, fixed: list[tuple[str, str]], cap: int, risk_sql: str = "") -> str:
    fixed_rows = " UNION ALL ".join(
        f"SELECT {blk} AS block, {i} AS rnk, {q(t)} AS title, {q(d)} AS detail"
        for blk, i, t, d in fixed
    )
    return f"""
SELECT position, title, detail FROM (
  SELECT CAST(row_number() OVER (ORDER BY block, rnk) AS INTEGER) AS position, title, detail FROM (
    SELECT 0 AS block, row_number() OVER (ORDER BY {CE_ORDER}) AS rnk, {title} AS title, {detail} AS detail
    FROM ({weak_sql})
    {risk_sql}
    UNION ALL {fixed_rows}))
WHERE position <= {cap}"""


def recommendations_sql() -> str:
    weak = f"SELECT * FROM ce ORDER BY {CE_ORDER} LIMIT 3"
    fixed = [(1, i, t, d) for i, (t, d) in enumerate(REC_FIXED, start=1)]
    return w(_rec_rows(weak, tmpl(REC_COURSE_TITLE, course="course_name"), tmpl(REC_COURSE_DETAIL, tag="tag"), fixed, 5))


def recommendations_filtered_sql(risk: float | None = None) -> str:
    v = R.REC_VIEW
    courses = f"SELECT * FROM ce WHERE category = {q(v['category'])}"
    threshold = float(v["risk"] if risk is None else risk)
    risks = f"SELECT * FROM top1 WHERE coalesce(risk_score, 0.0) >= {threshold}"
    weak = f"SELECT * FROM ({courses}) ORDER BY {CE_ORDER} LIMIT 2"
    score = fixed("avg_score", 1)
    risk_sql = (
        f"UNION ALL SELECT 1 AS block, 1 AS rnk, {q(REC_VIEW_RISK_TITLE)} AS title, "
        f"{tmpl(REC_VIEW_RISK_DETAIL, count='n')} AS detail "
        f"FROM (SELECT count(*) AS n FROM ({risks})) WHERE n > 0"
    )
    return w(
        _rec_rows(
            weak,
            tmpl(REC_VIEW_COURSE_TITLE, course="course_name"),
            tmpl(REC_VIEW_COURSE_DETAIL, score=score, tag="tag"),
            [(2, 1, REC_VIEW_FIXED[0], REC_VIEW_FIXED[1])],
            4,
            risk_sql,
        )
    )


def upsert_sql() -> str:
    return f"""WITH {TR.strip()},
tgt AS (
  SELECT o_custkey AS student_id, CAST(o_orderkey % 25 AS INTEGER) AS course_id,
         max(o_totalprice) / 5000 AS final_score
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
inc AS (
  SELECT student_id, course_id, final_score FROM (
    SELECT o_custkey AS student_id, CAST(o_orderkey % 25 AS INTEGER) AS course_id,
           o_totalprice / 5000 AS final_score,
           row_number() OVER (PARTITION BY o_custkey, CAST(o_orderkey % 25 AS INTEGER)
                              ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1)
SELECT * FROM tgt WHERE NOT EXISTS (
  SELECT 1 FROM inc WHERE inc.student_id = tgt.student_id AND inc.course_id = tgt.course_id)
UNION ALL SELECT * FROM inc"""


def upsert_stored_sql() -> str:
    """A batch beats what is stored; within a batch the last row of a key counts."""
    return """
SELECT student_id, course_id, final_score FROM (
  SELECT o_custkey AS student_id, CAST(o_orderkey % 25 AS INTEGER) AS course_id, o_totalprice / 5000 AS final_score,
         row_number() OVER (PARTITION BY o_custkey, o_orderkey % 25
           ORDER BY CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')) WHERE rn = 1"""


def offending_sql() -> str:
    parts = [
        f"SELECT {q(t)} AS \"table\", {q(rule)} AS rule, {q(c)} AS columns, CAST(doc_id AS VARCHAR) AS \"key\","
        f" CAST({c} AS VARCHAR) AS value FROM documents WHERE {pred}"
        for t, rule, c, pred in DOCUMENT_RULES
    ]
    for t, cols in (("documents", ("doc_id", "text", "lang", "source", "n_chars")), ("cells", ("doc_id", "lang", "source", "n_chars"))):
        parts += [f"SELECT {q(t)}, 'not_null', {q(c)}, CAST(doc_id AS VARCHAR), NULL FROM documents WHERE {c} IS NULL" for c in cols]
    key = "'{\"student_id\":\"' || student_id || '\",\"course_id\":\"' || course_id || '\"}'"
    parts += [f"SELECT 'features', 'not_null', {q(c)}, {key}, NULL FROM filled WHERE {c} IS NULL" for c in ("last_event_date", "study_minutes")]
    return w("\nUNION ALL\n".join(parts))


def scope_first_sql(pred: str) -> str:
    """Rank within the scoped wide table."""
    return w(
        f"""
SELECT {RISK_COLS} FROM (
  SELECT student_id, student_name, organization, course_name, tag,
         {rnd('final_score')} AS final_score, {rnd('avg_progress')} AS avg_progress, study_minutes,
         {rnd('risk_score')} AS risk_score
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id
                  ORDER BY risk_score DESC NULLS LAST, course_id ASC NULLS FIRST) AS rn
        FROM lc WHERE {pred})
  WHERE rn = 1)"""
    )


def sql() -> dict[str, str]:
    metric_courses = f"SELECT * FROM ce WHERE category = {q(R.VIEW_CATEGORY)}"
    metric_risks = "SELECT * FROM top1 WHERE coalesce(risk_score, 0.0) >= 38.0"
    none_courses = f"SELECT * FROM ce WHERE category = {q(R.VIEW_CATEGORY)} AND tag = {q(R.CHOSEN_TAG)}"
    none_risks = f"SELECT * FROM top1 WHERE coalesce(risk_score, 0.0) >= 38.0 AND tag = {q(R.CHOSEN_TAG)}"
    cm = lambda c: rnd(f"coalesce(avg(coalesce({c}, 0.0)), 0.0)")
    out = {
        # sources and sinks
        "csv_scan": w("SELECT * FROM tr_scores"),
        "fs_uri_scan": w("SELECT * FROM tr_students"),
        "publish_files": w("SELECT * FROM tr_events"),
        "normalize_types": w(
            "SELECT student_id, course_id, study_minutes, completed_resources, accessed_resources, avg_progress,"
            " strftime(last_event_date, '%Y-%m-%d') AS last_event_date, final_score FROM filled"
        ),
        "load_tables": w(totals_sql()),
        "upsert_by_key": upsert_sql(),
        "upsert_stored": upsert_stored_sql(),
        "rows_to_json": w(
            "SELECT CAST(to_json(struct_pack(course_id := course_id, course_name := course_name, category := category,"
            " tag := tag, learners := learners, avg_score := avg_score, avg_progress := avg_progress,"
            " study_minutes := study_minutes, pass_rate := pass_rate)) AS VARCHAR) AS json FROM ce"
        ),
        # data quality
        "dq_primary_key": w("SELECT event_id, count(*) AS count FROM tr_events GROUP BY event_id HAVING count(*) > 1"),
        "dq_not_null": w(not_null_sql()),
        "dq_foreign_key": w(fk_sql() + "\nUNION ALL\n" + more_fk_sql()),
        "dq_types": w(types_sql() + "\nUNION ALL\n" + document_types_sql()),
        "dq_report": w(report_sql()),
        "dq_offending_rows": offending_sql(),
        # features, wide table, expressions
        "pair_features": w("SELECT * FROM feats"),
        "right_join_features": w("SELECT * FROM filled"),
        "null_fill": w("SELECT * FROM filled"),
        "inner_join_courses": w(
            "SELECT s.course_id, s.student_id, s.final_score, c.course_name, c.category, c.tag"
            " FROM tr_scores s JOIN tr_courses c ON s.course_id = c.course_id"
        ),
        "learner_course": w("SELECT * FROM lc"),
        "score_level": w("SELECT student_id, course_id, final_score, score_level FROM lc"),
        "risk_score": w("SELECT student_id, course_id, risk_score FROM lc"),
        "round_columns": w(
            f"SELECT student_id, course_id, {rnd('final_score')} AS final_score,"
            f" {rnd('avg_progress')} AS avg_progress, {rnd('risk_score')} AS risk_score FROM lc"
        ),
        "project_risk_columns": w(
            f"SELECT student_id, course_id, student_name, organization, course_name, tag,"
            f" {rnd('final_score')} AS final_score, {rnd('avg_progress')} AS avg_progress, study_minutes,"
            f" {rnd('risk_score')} AS risk_score FROM lc"
        ),
        "week_label": w(
            "SELECT DISTINCT event_date, CAST(date_trunc('week', event_date) AS DATE) AS week_start,"
            " strftime(date_trunc('week', event_date), '%m-%d') AS week FROM tr_events"
        ),
        "display_formats": w(
            f"SELECT course_id, {grouped('learners')} AS learners_text, {grouped('study_minutes')} AS minutes_text,"
            f" {fixed('avg_score', 2)} AS score_text, {pct('avg_progress')} AS progress_text,"
            f" {pct('pass_rate')} AS pass_rate_text FROM ce"
        ),
        # panels
        "overview": w("SELECT * FROM ov"),
        "overview_dashboard": w("SELECT * FROM ov"),
        "overview_merged": w("SELECT * FROM ov"),
        "course_effect": w(f"SELECT * FROM ce ORDER BY {CE_ORDER}"),
        "tag_weakness": w(f"SELECT * FROM tw ORDER BY {TW_ORDER}"),
        "format_usage": w(
            f"SELECT format, views, completed, {rnd('progress_sum / progress_n')} AS avg_progress,"
            f" {rnd('completed / views * 100')} AS completion_rate FROM ("
            " SELECT r.format, count(*) AS views, CAST(sum(e.completed) AS BIGINT) AS completed,"
            " CAST(sum(e.progress_percent) AS DOUBLE) AS progress_sum, count(e.progress_percent) AS progress_n"
            " FROM tr_events e JOIN tr_resources r ON e.resource_id = r.resource_id GROUP BY r.format)"
            " ORDER BY views DESC, format"
        ),
        "weekly_activity": w(
            f"SELECT strftime(date_trunc('week', event_date), '%m-%d') AS week,"
            f" {rnd('sum(duration_minutes) / 60')} AS study_hours, count(DISTINCT student_id) AS active_students,"
            " count(*) AS events FROM tr_events GROUP BY 1 ORDER BY 1"
        ),
        "weekly_activity_by_date": w(
            f"SELECT CAST(date_trunc('week', event_date) AS DATE) AS week_start,"
            f" {rnd('sum(duration_minutes) / 60')} AS study_hours, count(DISTINCT student_id) AS active_students,"
            " count(*) AS events, strftime(date_trunc('week', event_date), '%m-%d') AS week"
            " FROM tr_events GROUP BY 1, 5 ORDER BY 1"
        ),
        "score_distribution": w(f"SELECT score_level, count(*) AS count FROM lc GROUP BY score_level ORDER BY {LEVEL_POS}"),
        "conditional_count": w(
            "SELECT course_id, CAST(sum(CASE WHEN risk_score >= 38.0 THEN 1 ELSE 0 END) AS BIGINT) AS risk_records"
            " FROM lc GROUP BY course_id"
        ),
        "conditional_rate": w(
            f"SELECT tag, {rnd('avg(CASE WHEN final_score >= 60.0 THEN 1 ELSE 0 END) * 100')} AS pass_rate"
            " FROM lc GROUP BY tag"
        ),
        "skill_scores": w(
            f"SELECT list(course_name ORDER BY {CE_ORDER}) AS categories,"
            f" list(avg_score ORDER BY {CE_ORDER}) AS \"values\" FROM ce"
        ),
        "top_risk_per_learner": w("SELECT * FROM top1"),
        "sort_multi_key": w(f"SELECT *, CAST(row_number() OVER (ORDER BY {TW_ORDER}) AS INTEGER) AS position FROM tw"),
        "ordinal_sort": w(
            "SELECT score_level, count, CAST(row_number() OVER (ORDER BY "
            + LEVEL_POS
            + ", score_level) AS INTEGER) AS position FROM (SELECT score_level, count(*) AS count FROM lc GROUP BY score_level)"
        ),
        "risk_list": w(f"SELECT {RISK_COLS}, CAST(row_number() OVER (ORDER BY {RISK_ORDER}) AS INTEGER) AS position FROM risk120"),
        "risk_list_all": w(f"SELECT student_id, {RISK_COLS}, row_number() OVER (ORDER BY {RISK_ORDER}) AS position FROM top1"),
        "weakest_courses": w(
            f"SELECT *, CAST(row_number() OVER (ORDER BY {CE_ORDER}) AS INTEGER) AS position FROM"
            f" (SELECT * FROM ce ORDER BY {CE_ORDER} LIMIT 3)"
        ),
        "recommendations": recommendations_sql(),
        "recommendations_filtered": recommendations_filtered_sql(),
        "recommendations_filtered_no_risk": recommendations_filtered_sql(R.NO_RISK_THRESHOLD),
        # views and scopes
        "filter_equals": w(f"SELECT * FROM top1 WHERE organization = {q(R.ORGANIZATION)} AND tag IN ({TEACHER})"),
        "filter_courses": w(f"SELECT * FROM ce WHERE category = {q(R.VIEW_CATEGORY)}"),
        "filter_tags": w(f"SELECT * FROM tw WHERE tag IN (SELECT tag FROM ce WHERE category = {q(R.VIEW_CATEGORY)})"),
        "filter_tags_chosen": w(f"SELECT * FROM tw WHERE tag = {q(R.CHOSEN_TAG)}"),
        "filter_risks": w(
            f"SELECT {RISK_COLS} FROM top1 WHERE coalesce(risk_score, 0.0) >= {R.VIEW_RISK}"
            f" AND {keyword(R.VIEW_KEYWORD)}"
        ),
        "keyword_search": w(f"SELECT * FROM top1 WHERE coalesce(risk_score, 0.0) >= 0.0 AND {keyword(R.LITERAL_KEYWORD)}"),
        "risk_cube": w("\nUNION ALL\n".join(
            f"SELECT tag, false AS all_tags, {s}::DOUBLE AS step, count(*) FILTER (WHERE coalesce(risk_score, 0.0) >= {s}) AS risk_count FROM top1 GROUP BY tag"
            f" UNION ALL SELECT NULL, true, {s}::DOUBLE, count(*) FILTER (WHERE coalesce(risk_score, 0.0) >= {s}) FROM top1"
            for s in (0.0, 30.0, 38.0, 45.0, 55.0)
        )),
        "course_cube": w(
            "SELECT category, tag, grouping(category) = 1 AS all_categories, grouping(tag) = 1 AS all_tags, count(*) AS course_count, "
            + ", ".join(f"{rnd(f'avg(coalesce({c}, 0.0))')} AS {c}" for c in ("avg_score", "avg_progress", "pass_rate"))
            + " FROM ce GROUP BY CUBE (category, tag)"
        ),
        "metric_cards": w(
            f"SELECT (SELECT student_count FROM ov) AS student_count,"
            f" (SELECT count(*) FROM ({metric_courses})) AS course_count,"
            f" (SELECT {cm('avg_score')} FROM ({metric_courses})) AS avg_score,"
            f" (SELECT {cm('avg_progress')} FROM ({metric_courses})) AS avg_progress,"
            f" (SELECT total_study_hours FROM ov) AS total_study_hours,"
            f" (SELECT {cm('pass_rate')} FROM ({metric_courses})) AS pass_rate,"
            f" (SELECT count(*) FROM ({metric_risks})) AS risk_count"
        ),
        "metric_cards_no_course": w(
            f"SELECT (SELECT student_count FROM ov) AS student_count,"
            f" (SELECT count(*) FROM ({none_courses})) AS course_count,"
            f" (SELECT {cm('avg_score')} FROM ({none_courses})) AS avg_score,"
            f" (SELECT {cm('avg_progress')} FROM ({none_courses})) AS avg_progress,"
            f" (SELECT total_study_hours FROM ov) AS total_study_hours,"
            f" (SELECT {cm('pass_rate')} FROM ({none_courses})) AS pass_rate,"
            f" (SELECT count(*) FROM ({none_risks})) AS risk_count"
        ),
        "card_texts": w(
            f"SELECT {grouped('(SELECT student_count FROM ov)')} AS student_text,"
            f" {grouped(f'(SELECT count(*) FROM ({metric_courses}))')} AS course_text,"
            f" (SELECT {grouped('CAST(' + fixed('s', 2) + ' AS DOUBLE)')} FROM (SELECT avg(coalesce(avg_score, 0.0)) AS s FROM ({metric_courses}))) AS score_text,"
            f" (SELECT {pct('p')} FROM (SELECT avg(coalesce(avg_progress, 0.0)) AS p FROM ({metric_courses}))) AS progress_text,"
            f" {grouped('(SELECT total_study_hours FROM ov)')} AS hours_text,"
            f" (SELECT {pct('p')} FROM (SELECT avg(coalesce(pass_rate, 0.0)) AS p FROM ({metric_courses}))) AS pass_rate_text,"
            f" {grouped(f'(SELECT count(*) FROM ({metric_risks}))')} AS risk_text"
        ),
        "skill_score_rows": w(f"SELECT course_name, avg_score FROM ce ORDER BY {CE_ORDER}"),
        "filter_options": w(
            "SELECT kind, value, CAST(row_number() OVER (PARTITION BY kind ORDER BY first_at) AS INTEGER) AS position FROM ("
            f" SELECT 'category' AS kind, category AS value, min(appear) AS first_at FROM"
            f"   (SELECT *, row_number() OVER (ORDER BY {CE_ORDER}) AS appear FROM ce) GROUP BY category"
            " UNION ALL"
            f" SELECT 'tag' AS kind, tag AS value, min(appear) AS first_at FROM"
            f"   (SELECT *, row_number() OVER (ORDER BY {CE_ORDER}) AS appear FROM ce) GROUP BY tag)"
        ),
        "scope_teacher_courses": w(f"SELECT * FROM ce WHERE tag IN ({TEACHER})"),
        "scope_teacher_tags": w(f"SELECT * FROM tw WHERE tag IN ({TEACHER})"),
        "scope_teacher_risks": w(f"SELECT {RISK_COLS} FROM top1 WHERE tag IN ({TEACHER})"),
        "scope_org_risks": w(f"SELECT {RISK_COLS} FROM top1 WHERE organization = {q(R.ORGANIZATION)}"),
        "scope_first_teacher_risks": scope_first_sql(f"tag IN ({TEACHER})"),
        "scope_first_org_risks": scope_first_sql(f"organization = {q(R.ORGANIZATION)}"),
    }
    # From stored states, an index or cubes: the same rows as from the tables.
    same = {"pair_features": "pair_features_refreshed", "format_usage": "format_usage_refreshed", "weekly_activity": "weekly_activity_refreshed",
            "keyword_search": "keyword_search_indexed", "metric_cards": "metric_cards_from_cubes"}
    return {**out, **{new: out[old] for old, new in same.items()}}
