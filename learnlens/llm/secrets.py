"""Secret scans over an incremental blob ledger, with built-in functions only.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger, two Parquet tables in one folder, knows which rule versions have
seen which blob (``scanned``) and what they found (``findings``). ``scan``
reads the distinct blobs of the given versions, runs a rule only on blobs that
its present version has not seen, appends to the ledger, and joins the
findings back to all paths. So copies and unchanged history are scanned once,
and a changed rule is the only one that reads old blobs again.

Positions: Spark has no function for them, but the pieces between the matches
(``split``) and the matches (``regexp_extract_all``) alternate, so running
sums of their lengths along a text give every start and end in code points, in
time n log n for n matches. A match counts
only if its value is long enough; failing matches are dropped after the scan,
since they still use up their characters.

Skew: a blob's text crosses the shuffle once per task that holds copies of it
(the grouping is combined first); only (id, hash) pairs of all versions meet
the findings, and the hot side of that join is the splittable one.

Cases: a null text is the empty text; equal or null paths give one row each;
an empty table gives no rows; other columns are not read. A text without
secrets has the SHA-256 of the empty string as its digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import broadcast_if_bounded, save, text_of
from learnlens.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """``value_group`` is the part of a match that needs ``min_chars``."""

    kind: str
    pattern: str
    version: str = "1"
    value_group: int = 0
    min_chars: int = 0

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# Java's (?i) folds A-Z only, as the rule asks.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", ASSIGN, value_group=2, min_chars=6),
    # A run of too few characters holds no longer run, so the length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,rule:string>>"


HITS = "array<struct<rank:int,i:int,gap:int,len:int,value:int>>"


def hits_of(text: Column, rule: Rule, rank: int) -> Column:
    """Every match of one rule, leftmost and non-overlapping, as lengths: of the
    piece before it, of the match and of its value."""
    p = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(rule.value_group))
    # One more piece than matches: the last entry has no match.
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("p"), hits.alias("h"), values.alias("v"))
    lengths = F.transform(
        parts,
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("i"), F.char_length(x["p"]).alias("gap"),
            F.char_length(x["h"]).alias("len"), F.char_length(x["v"]).alias("value"),
        ),
    )
    # Most texts have no match at all: one search ends there.
    return F.when(text.rlike(rule.pattern), F.filter(lengths, lambda x: x["len"].isNotNull()))


def spans_of(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) from (blob, hits): running sums of the lengths along a text
    are the matches' places; failing matches go after that."""
    rows = hits.where(F.size("hits") > 0).select("blob", F.inline("hits")).repartition("blob")
    along = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_rule = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rank") + 1)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along).cast("int"))
    span = F.struct(
        (F.col("end") - F.col("len")).alias("start"), "rank", "end",
        of_rule([r.kind for r in rules]).alias("kind"), of_rule([r.id for r in rules]).alias("rule"),
    )
    passing = rows.where(F.col("value") >= of_rule([r.min_chars for r in rules]))
    return passing.groupBy("blob").agg(F.collect_list(span).alias("spans"))


class BlobLedger:
    """The ledger's folder; empty or absent at first."""

    def __init__(self, spark, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.rules = spark, rules
        self.path = (path or scratch_path(spark, "ledger")).rstrip("/")
        self._known = path is not None and self._exists()

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        return p.getFileSystem(conf).exists(p)

    def scanned(self) -> DataFrame:
        return self.spark.read.schema("blob binary, rules array<string>").parquet(f"{self.path}/scanned")

    def findings(self) -> DataFrame:
        return self.spark.read.schema(f"blob binary, spans {SPAN}").parquet(f"{self.path}/findings")

    def update(self, versions: DataFrame) -> None:
        """Scan what no present rule version has seen among ``versions`` (blob, text)."""
        ids = [r.id for r in self.rules]
        todo = versions
        if self._known:
            # Blobs and the rule versions that have seen them; a blob seen by all does not bring its text along.
            done = self.scanned().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
            complete = done.where(F.size(F.array_except(F.array(*map(F.lit, ids)), "rules")) == 0).select("blob")
            todo = todo.join(complete, "blob", "left_anti").join(done, "blob", "left")
        else:
            todo = todo.withColumn("rules", F.lit(None).cast("array<string>"))
        # Equal blobs have equal texts, so any one of them will do.
        blobs = todo.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("rules").alias("rules"))
        unseen = lambda r: ~F.coalesce(F.array_contains("rules", r.id), F.lit(False))
        none = F.array().cast(HITS)
        found = [F.coalesce(F.when(unseen(r), hits_of(F.col("text"), r, i)), none) for i, r in enumerate(self.rules)]
        out = blobs.select(
            "blob", F.array_except(F.array(*map(F.lit, ids)), F.coalesce("rules", F.array().cast("array<string>"))).alias("rules"),
            F.concat(*found).alias("hits"),
        )
        # One pass over the texts; both tables come from what it wrote.
        staged = scratch_path(self.spark, "ledger-step")
        out.write.parquet(staged)
        step = self.spark.read.schema(out.schema).parquet(staged)
        # Findings first: a run that breaks off between the two scans again instead of forgetting.
        spans_of(step.select("blob", "hits"), self.rules).write.mode("append").parquet(f"{self.path}/findings")
        step.select("blob", "rules").write.mode("append").parquet(f"{self.path}/scanned")
        self._known = True

    def present(self) -> DataFrame:
        """(blob, start, rank, end, kind, rule) of the present rule versions; a
        rule that was scanned twice, after a broken run, counts once."""
        rows = self.findings().select("blob", F.inline("spans"))
        return rows.where(F.col("rule").isin([r.id for r in self.rules])).distinct()

    def scan(self, versions: DataFrame) -> DataFrame:
        """``versions`` (path columns and ``text``) with the present rules'
        findings of every row as a ``spans`` array in (start, rule) order."""
        paths = [c for c in versions.columns if c != "text"]
        keyed = versions.select(*paths, text_of().alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
        self.update(keyed.select("blob", "text"))
        span = F.struct("start", "rank", "end", "kind", "rule")
        # By shuffle: a blob's spans can be many, so their rows bound no broadcast.
        found = self.present().groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
        none = F.array().cast(SPAN)
        return keyed.select(*paths, "blob").join(found, "blob", "left").select(
            *paths, F.coalesce("spans", none).alias("spans")
        )


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(doc_id, n_<kind> per base rule, base_sha256, spans) from ``BlobLedger.scan``."""
    as_text = lambda a: F.array_join(
        F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(as_text(own), 256).alias("base_sha256"), as_text("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "<SECRET>", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``;
    ``n_chars`` follows the text. Texts without secrets stay as they are.

    The spans are found again per distinct blob through a ledger and joined to
    the rows by the blob's hash; only texts that have spans are rewritten.
    """
    ledger = BlobLedger(docs.sparkSession, rules=rules)
    blob = F.unhex(F.sha2(text_of(), 256))
    ledger.update(docs.select(blob.alias("blob"), text_of().alias("text")))
    # What is kept between the spans, seen along the text: from the greatest end so far to the next start beyond it.
    before = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ledger.present().withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    piece = F.when(F.col("start") >= F.col("from"), F.struct("from", F.col("start").alias("to")))
    found = rows.groupBy(F.col("blob").alias("__blob")).agg(
        F.sort_array(F.collect_list(piece)).alias("__pieces"), F.max("end").alias("__end")
    )
    found = save(found, "pieces")
    keyed = docs.withColumn("__key", blob)
    # The blobs' hashes alone are broadcast, 32 bytes each; only texts with spans are shuffled to their pieces.
    marked = broadcast_if_bounded(found.select("__blob"))
    whole = keyed.join(marked, F.col("__key") == F.col("__blob"), "left_anti").drop("__key")
    joined = keyed.join(marked, F.col("__key") == F.col("__blob"), "left_semi").join(found, F.col("__key") == F.col("__blob"))
    text = F.col("text")
    pieces = F.transform("__pieces", lambda x: F.substring(text, x["from"] + 1, x["to"] - x["from"]))
    tail = F.substring(text, F.col("__end") + 1, F.char_length(text))
    out = joined.withColumn("__text", F.array_join(F.concat(pieces, F.array(tail)), mark))
    changed = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    out = out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else None
    return out.unionByName(whole.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]))


def _oracle() -> str:
    """The same spans in DuckDB: pieces and matches alternate there as well."""
    fold = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    patterns = [ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", fold), *(r.pattern for r in RULES[1:])]
    parts = []
    for i, (r, p) in enumerate(zip(RULES, patterns)):
        q = p.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, {r.min_chars} AS least, regexp_extract_all(t, '{q}') AS h, "
            f"regexp_extract_all(t, '{q}', {r.value_group}) AS v, regexp_split_to_array(t, '{q}') AS p FROM d"
        )
    base = len(BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m WHERE len(h) > 0),
s AS (SELECT doc_id, rank, kind,
        (list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i-1]]), 0))::BIGINT AS a,
        length(h[i]) AS n FROM e WHERE length(v[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (rank < {base}) AS b,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS x FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(x, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()
