"""Mixing sources to target weights by hash-random keys and prefix sums.

``mix`` plans how many words of every document a training mix takes:

1. every document gets a random key, the MD5 of its id (without one, of its text) and
   a seed (reruns agree, and no state is kept);
2. within each source the documents are range-sorted by that key: the leading
   hex digits of the key name a bucket, so a source of any size is spread over
   16**d buckets;
3. distributed prefix sums: the bucket totals (one row per source and bucket,
   combined before the shuffle) are summed up along the source, and a
   document's own start is its bucket's start plus a running sum inside the
   bucket;
4. a source's budget is cut exactly: whole epochs first, then the documents in
   key order until the rest of the budget is used; the document at the cut
   gives only the words that are still missing.

Targets: the sources in code point order (null last) weigh ``weights``,
repeating, and share the sum of all sizes. A target stops at ``max_epochs``
times its source's size; the excess goes to the others by weight until none is
above. The fixed point is found without iterating: in the order of
size / weight the stopped sources are a prefix, so a running sum over the
source table (one row per source) finds where it ends.

Cases: a null text has size 0 and takes 0 words; a null or empty source is a
source of its own; a source without words has target 0; equal ids are ordered
by size, and rows that agree in both are interchangeable; an empty table gives
no rows; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import broadcast_if_bounded, save, text_of, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
# Rows that one bucket of a source should hold at most, about.
BUCKET_ROWS = 20_000


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """Of the id; without one of the text, so that rows without an id spread as well."""
    missing = F.concat(F.lit("null:"), F.md5(text))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), missing)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    # Sources with a small cap for their weight stop first.
    order = [F.col("cap").cast("double") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = (
        s.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # This source does not stop if its share of what is left fits.
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
    )
    # The first source that fits fixes the level of all that follow.
    s = s.withColumn("level", F.min(F.when(F.col("fits"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "left", "open"))).over(all_rows))
    stopped = F.col("level").isNull() | (
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]) < F.struct("level.o0", "level.o1", "level.o2")
    )
    share = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.open")
    return s.select("source", "source_size", F.when(stopped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, key, source) for every row of
    ``docs`` (doc_id, text, source)."""
    rows = save(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), text_of(), seed).alias("key")
        ),
        "mix",
    )
    digits = max(0, math.ceil(math.log(max(1, rows.count()) / BUCKET_ROWS, 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket")
    starts = buckets.select(
        "source", "bucket", (F.sum("bucket_size").over(along) - F.col("bucket_size")).alias("bucket_start")
    )
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    # Budgets in whole words: epochs of the whole source, then a rest to cut.
    plan = starts.join(by_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "source_size", "target",
        F.floor("target").alias("budget"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.withColumn("local", F.sum("size").over(inside) - F.col("size"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rest = F.expr("budget % greatest(source_size, 1)") - F.col("bucket_start") - F.col("local")
    epochs = F.expr("budget div greatest(source_size, 1)")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "key", "source"
    )


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed rows: every document as often as it is taken whole, and the
    words of the cut document up to the cut. ``plan`` has (doc_id, source, size,
    taken). Documents of which nothing is taken go; the columns stay."""
    # Rows with id, source and size in common follow one another in the plan, so they take
    # the same, but for the one such group of a source that its cut may fall into.
    group = [F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_words")]
    per_group = plan.groupBy(*group).agg(
        F.sum("taken").alias("__mix_sum"), F.count("*").alias("__mix_n"),
        F.min("taken").alias("__mix_t"), F.max("taken").alias("__mix_max"),
    )
    per_group = save(per_group.where("__mix_sum > 0"), "taken")
    sized = docs.withColumn("__mix_size", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_id")) & F.col("source").eqNullSafe(F.col("__mix_source"))
    same = same & (F.col("__mix_size") == F.col("__mix_words"))
    joined = sized.join(broadcast_if_bounded(per_group.where("__mix_t = __mix_max")), same)
    at_cut = per_group.where("__mix_t < __mix_max")
    if not at_cut.isEmpty():
        # One group a source: its rows in turn, by hash of the text, up to the cut.
        turn = Window.partitionBy("__mix_id", "__mix_source", "__mix_words").orderBy(F.xxhash64("text"))
        whole = F.expr("__mix_sum div (__mix_n * __mix_size) * __mix_size")
        rest = F.col("__mix_sum") - F.col("__mix_n") * whole - (F.row_number().over(turn) - 1) * F.col("__mix_size")
        dealt = whole + F.greatest(F.lit(0), F.least(F.col("__mix_size"), rest))
        cut_rows = sized.join(broadcast_if_bounded(at_cut), same).withColumn("__mix_t", dealt.cast("long"))
        joined = joined.unionByName(cut_rows)
    copies = F.expr("sequence(0L, cast(ceil(__mix_t / __mix_size) as long) - 1)")
    out = joined.where("__mix_t > 0 and __mix_size > 0").withColumn("__mix_copy", F.explode(copies))
    words = F.least(F.col("__mix_size"), F.col("__mix_t") - F.col("__mix_copy") * F.col("__mix_size")).cast("int")
    # A prefix of so many words, with the white space before each of them.
    pieces = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(pieces, 1, words), "")
    out = out.withColumn("__mix_text", F.when(words < F.col("__mix_size"), cut).otherwise(F.col("text")))
    kept = {"text": F.col("__mix_text"), "n_chars": F.char_length("__mix_text").cast("long")}
    return out.select(*[kept.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::BIGINT AS weight,
             3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source) AS i FROM w),
l AS (SELECT *, (SELECT sum(source_size) FROM s)::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT AS lft,
             (SELECT sum(weight) FROM w)::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT AS opn
      FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT lft, opn, i AS first_i FROM l WHERE lft * weight <= cap * opn ORDER BY i LIMIT 1),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.first_i IS NULL OR l.i < f.first_i THEN l.cap::DOUBLE
                  ELSE (f.lft * l.weight)::DOUBLE / f.opn END AS target
      FROM l LEFT JOIN f ON true),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start FROM d)
SELECT p.doc_id, p.size, t.source_size, t.target,
       ((floor(t.target)::BIGINT // greatest(t.source_size, 1)) * p.size
        + greatest(0, least(p.size, floor(t.target)::BIGINT % greatest(t.source_size, 1) - p.start)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
