"""Keyword search over an index of trigrams.

The search is for a literal piece of text anywhere in a row, so words are no help; but a
row that holds the keyword holds every three characters in a row of it. The index is
(trigram, id), stored in the order of the trigrams: a search reads the few files and row
groups of the keyword's trigrams, keeps the ids that have all of them, and
verifies the keyword literally in the rows of these ids. Up to ``FEW`` ids are looked up in
the stored rows (the filter reaches the pages of their files); the rows of more ids are
joined. Keywords of less than three characters scan the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.functions.expressions import clean_keyword, keyword_match, keyword_text

GRAM = 3
# Ids that are named in a filter; more are joined.
FEW = 1_000


def trigram_index(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(gram, key): the distinct trigrams of every row's searched text, in their order. A trigram
    that all rows share is cut into several ranges by the key."""
    grams = rows.select(key, keyword_text(*columns).alias("t")).where(F.length("t") >= GRAM).select(
        F.explode(F.expr(f"array_distinct(transform(sequence(1, length(t) - {GRAM - 1}), i -> substring(t, i, {GRAM})))")).alias("gram"), key
    )
    return grams.repartitionByRange("gram", key).sortWithinPartitions("gram", key)


def grams_of(keyword: str | None) -> list[str]:
    kw = clean_keyword(keyword)
    return sorted({kw[i : i + GRAM] for i in range(len(kw) - GRAM + 1)})


def search(rows: DataFrame, index: DataFrame, key: str, columns: Sequence[str], keyword: str | None) -> DataFrame:
    """The rows whose searched text holds the keyword (trimmed, in any case); all for an empty one.
    ``index``: the stored ``trigram_index`` of ``rows``; a null key is in no index and is scanned for."""
    match = keyword_match(keyword, *columns)
    grams = grams_of(keyword)
    if not grams:
        return rows.where(match)
    found = index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    ids = [r[0] for r in found.select(key).limit(FEW + 1).collect()]
    if len(ids) <= FEW:
        return rows.where((F.col(key).isin(ids) | F.col(key).isNull()) & match)
    return rows.join(found.select(key), key, "left_semi").where(match).unionByName(rows.where(F.col(key).isNull() & match))
