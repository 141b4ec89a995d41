"""URL filters: stated host and path rules, then association rules mined from labels.

``mine`` turns every labelled page's URL into a transaction of tokens (host,
domain, top-level domain, first host label, first path part, file ending,
names of the query's keys, scheme) and its class (block: low quality or toxic;
else allow), and runs Spark's FP-growth over all of them. Rules
``tokens -> class`` are kept if their support and confidence suffice and no
rule with fewer of the same tokens is as confident. A URL has at most eight
tokens, so a transaction has at most 255 combinations and the number of rules
is bounded by 255 / min_support, whatever the size of the input.

``match`` uses an inverted index, token -> rules: the distinct token sets of
the pages (combined before the shuffle, so a host with a third of all pages is
one row per task) look up their tokens, and a rule fits a set that hits it as
often as it has tokens. The most confident rule decides, then the better
supported, the longer, and the first by text; without a rule the verdict is
allow. Stated rules come first: the longest that fits.

Cases: a null URL or one without ``://`` has empty host and path, no tokens and
the verdict allow; equal page ids give one row each; a page with several labels
is blocked if one of them says so; null labels are no labels; an empty table
gives no rows; without labels there are no mined rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.llm.common import broadcast_if_bounded, save, url_host, url_path


@dataclass(frozen=True)
class HostRule:
    """Fits the host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules that come before the mined ones.
STATED_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
MIN_SUPPORT = 0.002
# A rule seen on fewer labelled pages than this says nothing, however small the table.
MIN_PAGES = 10
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"
KINDS = ("host", "domain", "tld", "sub", "dir", "ext", "query", "scheme")


def stated_rule(host: Column, path: Column, rules: tuple[HostRule, ...], value: str) -> Column:
    """``value`` ("text" or "verdict") of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one to fit is the outermost test
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """The URL's tokens, at most one of each kind; none without a host."""
    host, path = url_host(url), url_path(url)
    part = lambda pattern, of, group=1: F.regexp_extract(of, pattern, group)
    keys = F.array_sort(F.array_distinct(F.regexp_extract_all(part(r"\?([^#]*)", url), F.lit(r"(?:^|&)([^&=]+)"), F.lit(1))))
    values = {
        "host": host,
        "domain": part(r"([^.]+\.[^.]+)$", host),
        "tld": part(r"([^.]+)$", host),
        "sub": part(r"^([^.]+)\.[^.]+\.[^.]+", host),
        "dir": part(r"^/([^/]+)/", path),
        "ext": part(r"\.([A-Za-z0-9]+)$", path),
        "query": F.array_join(keys, "&"),
        "scheme": part(r"^([A-Za-z]+)://", url),
    }
    tokens = [F.when(values[k] != "", F.concat(F.lit(f"{k}:"), values[k])) for k in KINDS]
    return F.when(host != "", F.array_compact(F.array(*tokens))).otherwise(F.array().cast("array<string>"))


def mine(
    pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(tokens, verdict, confidence, support, rule) from pages (page_id, url)
    and labels (doc_id, quality, toxic) of the same ids."""
    spark = pages.sparkSession
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.coalesce(bad, F.lit(False))).alias("bad")
    )
    verdict = F.when(F.col("bad"), "class:block").otherwise("class:allow")
    baskets = pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).where(F.size("tokens") > 0)
    baskets = save(baskets.join(known, "page_id").select(F.concat("tokens", F.array(verdict)).alias("items")), "baskets")
    n = baskets.count()
    least = max(MIN_PAGES, math.ceil(min_support * n))
    if n < least:
        return spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support long, rule string")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n).fit(baskets)
    sets = save(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    classes = F.filter("items", lambda x: x.startswith("class:"))
    plain = sets.where(F.size(classes) == 0).select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
    rules = (
        sets.where((F.size(classes) == 1) & (F.size("items") > 1))
        .select(F.array_except("items", classes).alias("tokens"), F.substring(classes[0], 7, 10).alias("verdict"), "freq")
        .join(plain, "tokens")
        .select("tokens", "verdict", (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("support"))
        .where(F.col("confidence") >= min_confidence)
    )
    rules = save(rules, "rules")
    # Every proper part of a rule's tokens; a rule over one of them that is as confident makes it needless.
    masks = F.expr("sequence(1, cast(pow(2, size(tokens)) as int) - 2)")
    picked = F.expr("filter(tokens, (x, i) -> (shiftright(mask, i) & 1) = 1)")
    parts = (
        rules.where(F.size("tokens") > 1)
        .select("tokens", "verdict", "confidence", F.explode(masks).alias("mask"))
        .select(F.col("tokens").alias("whole"), "verdict", "confidence", picked.alias("tokens"))
    )
    general = rules.select("tokens", "verdict", F.col("confidence").alias("general"))
    needless = parts.join(general, ["tokens", "verdict"]).where("general >= confidence").select(
        F.col("whole").alias("tokens"), "verdict"
    )
    kept = rules.join(needless.distinct(), ["tokens", "verdict"], "left_anti")
    return save(kept.withColumn("rule", F.array_join("tokens", " ")), "rules")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with ``tokens``) and the verdict, confidence and text of the
    mined rule that decides, null without one."""
    best = F.max(F.struct("confidence", "support", F.col("need").alias("n"), F.struct("verdict", "rule").alias("what")))
    facts = ["rule", "verdict", "confidence", "support"]
    index = broadcast_if_bounded(rules.select(*facts, F.size("tokens").alias("need"), F.explode("tokens").alias("token")))
    sets = pages.select("tokens").distinct()
    fits = (
        sets.select(F.col("tokens").alias("page_tokens"), F.explode("tokens").alias("token"))
        .join(index, "token")
        .groupBy("page_tokens", *facts, "need")
        .count()
        .where("count = need")
    )
    chosen = fits.groupBy("page_tokens").agg(best.alias("best"))
    chosen = save(
        chosen.select("page_tokens", F.col("best.what.verdict").alias("mined"), F.col("best.confidence").alias("confidence"), F.col("best.what.rule").alias("mined_rule")),
        "matched",
    )
    return pages.join(broadcast_if_bounded(chosen), F.col("tokens") == F.col("page_tokens"), "left").drop("page_tokens")


def judge(pages: DataFrame, labels: DataFrame, stated: tuple[HostRule, ...] = STATED_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, confidence) per row."""
    pages = pages.select("page_id", "url")
    rules = mine(pages, labels)
    url = F.col("url")
    parsed = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_tokens(url).alias("tokens"))
    out = match(parsed, rules)
    host, path = F.col("host"), F.col("path")
    return out.select(
        "page_id", "host", "path",
        stated_rule(host, path, stated, "text").alias("rule"),
        F.coalesce(stated_rule(host, path, stated, "verdict"), F.col("mined"), F.lit(DEFAULT)).alias("verdict"),
        "mined_rule", "confidence",
    )


ORACLE = r"""
WITH u AS (SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
t AS (SELECT *, CASE WHEN host = '' THEN [] ELSE list_sort(list_filter([
    'host:' || host, 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'tld:' || regexp_extract(host, '([^.]+)$', 1),
    'sub:' || regexp_extract(host, '^([^.]+)\.[^.]+\.[^.]+', 1), 'dir:' || regexp_extract(path, '^/([^/]+)/', 1),
    'ext:' || regexp_extract(path, '\.([A-Za-z0-9]+)$', 1),
    'query:' || array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&)([^&=]+)', 1))), '&'),
    'scheme:' || regexp_extract(url, '^([A-Za-z]+)://', 1)], lambda x: x NOT LIKE '%:')) END AS tokens FROM u),
s AS (SELECT page_id, tokens, array_to_string(list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1), ' ') AS sub, bit_count(m) AS n
      FROM (SELECT page_id, tokens, unnest(range(1, (1 << len(tokens))::BIGINT))::INT AS m FROM t)),
l AS (SELECT doc_id, max(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad FROM labels
      WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
b AS (SELECT greatest(10, ceil(0.002 * count(*))) AS least FROM t JOIN l ON page_id = doc_id WHERE len(tokens) > 0),
c AS (SELECT sub, n, count(*) AS a, count(*) FILTER (bad) AS bad, count(*) FILTER (NOT bad) AS good
      FROM s JOIN l ON page_id = doc_id GROUP BY sub, n),
r AS (SELECT sub, n, v, f AS support, f::DOUBLE / a AS confidence FROM (
        SELECT sub, n, a, 'block' AS v, bad AS f FROM c UNION ALL SELECT sub, n, a, 'allow', good FROM c), b
      WHERE f >= least AND f::DOUBLE / a >= 0.7),
k AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE g.v = r.v AND g.n < r.n AND g.confidence >= r.confidence
      AND list_has_all(string_split(r.sub, ' '), string_split(g.sub, ' ')))),
m AS (SELECT page_id, arg_max({'v': v, 'sub': k.sub, 'c': confidence}, (confidence, support, k.n, v, k.sub)) AS w
      FROM s JOIN k ON s.sub = k.sub GROUP BY page_id)
SELECT page_id, host, path,
  CASE WHEN x.r1 THEN 'example.com/de/' WHEN x.r2 THEN 'example.net/en/' WHEN x.r3 THEN 'org/fr/' WHEN x.r4 THEN 'net/' END AS rule,
  CASE WHEN x.r1 THEN 'block' WHEN x.r2 THEN 'allow' WHEN x.r3 THEN 'allow' WHEN x.r4 THEN 'block' ELSE coalesce(w.v, 'allow') END AS verdict,
  w.sub AS mined_rule, w.c AS confidence
FROM (SELECT page_id, host, path,
   (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') AS r1,
   (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') AS r2,
   (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') AS r3,
   (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') AS r4 FROM t) x
LEFT JOIN m USING (page_id)
"""
