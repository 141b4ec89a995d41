"""Source divergence audit by chunk factorization.

Which sources of a language use its words differently, and which words set a source apart?
Every kept term has a smoothed share in a source and in the whole language; a
``pair`` row sums up the differences of two sources, a ``term`` row names a term that a
source has more often than its language. All arithmetic is in whole numbers.

The work is factored over chunks, runs between white space, which no term crosses:

1. ``chunk_docs``: a task counts the chunks of each document and sums up the documents
   by (language, chunk). What is shuffled are these sums, so a frequent chunk is as
   light as a rare one.
2. ``chunk_terms``: each globally distinct chunk is tokenized once.
3. ``term_bounds``: the documents of a term are the union of its chunks', so at least the most
   frequent chunk's number and at most the sum of all. These bounds decide most
   terms; of an *open* term every chunk lies in fewer than ``min_docs`` documents.
4. ``chunk_sums``: the chunks' occurrences by (language, source) meet the terms of those chunks that
   matter and are summed up by term; chunks of open terms bring their
   documents along, whose distinct numbers decide. The threshold is exact for every term.
5. Pairs: a term's counts in its language's sources become one vector, and a task adds up
   the differences of all sources; sources without the term have the smoothed share of 0.

Cases: null text, lang and source are read as the empty string, a language and source of
their own; rows are documents, also those of a repeated or null doc_id; a group
without terms has its pairs; a language without kept terms has pairs of value 0 and no
term rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import ascii_lower, save, text_parts

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
# Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16_000_000
# Bytes of text that are counted together; some 30 bytes of memory a byte.
COUNT_BYTES = 16_000_000
# Cells of the vectors that a task compares at once.
CELLS = 1_000_000


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def _numbered(values) -> tuple[np.ndarray, pa.Array]:
    """The number of each value among the distinct ones, and these."""
    coded = pc.dictionary_encode(values)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct numbers in order. Sorted in place: for many numbers a small part of the time
    of np.unique, which hashes them first if no counts are asked for."""
    keys.sort()
    return keys[np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))] if len(keys) else keys


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, chunk number) of every chunk in the texts, and the distinct chunks."""
    split = pc.ascii_split_whitespace(part.column("text"))
    row = np.repeat(np.arange(len(split), dtype=np.int64), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    chunk, chunks = _numbered(split.flatten())
    # The empty chunks before and after a text are none.
    empty = pc.index(chunks, pa.scalar("", chunks.type)).as_py()
    if empty >= 0:
        row, chunk = row[chunk != empty], chunk[chunk != empty]
    return row, chunk, chunks


def chunk_docs(docs: DataFrame) -> DataFrame:
    """(lang, chunk, docs): in how many documents of the language a chunk occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", COUNT_BYTES):
                row, chunk, chunks = _words(part)
                if not len(row):
                    continue
                lang, langs = _numbered(part.column("lang"))
                # Distinct (document, chunk) pairs first, then sums over the documents of a language.
                pairs = _distinct(row * np.int64(len(chunks)) + chunk)
                keys, n = np.unique(lang[pairs // len(chunks)] * np.int64(len(chunks)) + pairs % len(chunks), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(keys // len(chunks))), chunks.take(pa.array(keys % len(chunks))), pa.array(n.astype(np.int64))],
                    ["lang", "chunk", "docs"],
                )

    counted = _texts(docs, "lang", "text").mapInArrow(run, "lang string, chunk string, docs long")
    return counted.groupBy("lang", "chunk").agg(F.sum("docs").alias("docs"))


def _occurrences(docs: DataFrame, listed: pa.Array | None) -> DataFrame:
    """(lang, chunk, entries) from (lang, at, text), ``at`` being the source's number: one row for what a
    part of a task has of a chunk. An entry is a source with the occurrences, at * 2**32 + n, or,
    below 0, a document that has the chunk, -1 - row; documents only for the chunks of
    ``listed``, or for all if that is None. (A part's occurrences are less than 2**32, as a
    text's bytes are.)"""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in text_parts(batch, "text", COUNT_BYTES):
                if found := entries(part, first):
                    yield found
                first += part.num_rows

    def entries(part: pa.RecordBatch, first: int) -> pa.RecordBatch | None:
        row, chunk, chunks = _words(part)
        if not len(row):
            return None
        lang, langs = _numbered(part.column("lang"))
        source, sources = _numbered(part.column("at"))
        many, width = np.int64(len(chunks)), np.int64(len(sources))
        # By language, chunk and source.
        keys, n = np.unique((lang[row] * many + chunk) * width + source[row], return_counts=True)
        key, entry = keys // width, (sources.to_numpy().astype(np.int64)[keys % width] << 32) + n
        if shared.value is not None:
            wanted = pc.is_in(chunks, value_set=shared.value.cast(chunks.type)).to_numpy(zero_copy_only=False)
            row, chunk = row[wanted[chunk]], chunk[wanted[chunk]]
        pairs = _distinct(row * many + chunk)
        if len(pairs):
            row, chunk = pairs // many, pairs % many
            key, entry = np.concatenate([key, lang[row] * many + chunk]), np.concatenate([entry, -1 - (first + row)])
            order = np.argsort(key, kind="stable")
            key, entry = key[order], entry[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(entry))
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(key[starts] // many)), chunks.take(pa.array(key[starts] % many)), lists], ["lang", "chunk", "entries"]
        )

    return docs.mapInArrow(run, "lang string, chunk string, entries array<long>")


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk, term, k) from (chunk), distinct: a chunk's terms and how often it has them."""
    terms = F.regexp_extract_all(ascii_lower(F.col("chunk")), F.lit(TERM), F.lit(0))
    found = chunks.select("chunk", terms.alias("terms")).where("size(terms) > 0")
    single = found.where("size(terms) = 1").select("chunk", F.col("terms")[0].alias("term"), F.lit(1).cast("long").alias("k"))
    several = found.where("size(terms) > 1").select("chunk", F.explode("terms").alias("term"))
    return single.unionByName(several.groupBy("chunk", "term").agg(F.count("*").alias("k")))


def chunk_term_docs(by_lang: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, chunk, docs, term, k): the terms joined back to the chunks of each language. Both
    sides have few rows a chunk, so a task hashes its share of one and sorts neither."""
    return by_lang.join(terms.hint("shuffle_hash"), "chunk")


def term_bounds(joined: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, open) of the terms that may lie in ``min_docs`` documents of the language, from
    ``chunk_term_docs``. A term that is not open surely does."""
    bounds = joined.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most"))
    return bounds.where(F.col("most") >= min_docs).select("lang", "term", (F.col("least") < min_docs).alias("open"))


def source_numbers(docs: DataFrame) -> DataFrame:
    """(lang, source, at): the sources of each language, numbered from 0 in their order."""
    turn = Window.partitionBy("lang").orderBy("source")
    return _texts(docs, "lang", "source").distinct().withColumn("at", F.row_number().over(turn) - 1)


def chunk_sums(docs: DataFrame, groups: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(lang, at, term, row, n): the occurrences of a term in each group (row null), and
    the documents of open terms (one row each, at and n null). ``groups`` and ``dictionary`` are
    stored tables: (lang, source, at), (lang, chunk, term, k, open)."""
    open_ = dictionary.where("open").select("chunk").distinct()
    listed = pa.array([r[0] for r in open_.collect()], pa.string()) if _bytes(open_) <= BROADCAST_BYTES else None
    rows = _texts(docs, "lang", "source", "text").join(_hinted(groups), ["lang", "source"]).select("lang", "at", "text")
    found = _occurrences(rows, listed).join(_hinted(dictionary, "shuffle_hash"), ["lang", "chunk"])
    flat = found.select("lang", "term", "k", "open", F.explode("entries").alias("e")).where("e >= 0 or open")
    flat = flat.selectExpr(
        "lang", "if(e >= 0, cast(shiftright(e, 32) as int), null) as at", "term", "if(e < 0, -1 - e, null) as row",
        "if(e >= 0, (e & 4294967295L) * k, null) as n",
    )
    return flat.groupBy("lang", "at", "term", "row").agg(F.sum("n").alias("n"))


def _bytes(df: DataFrame) -> int:
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return df.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(64)).cast("long"))).first()[0] or 0


def _hinted(df: DataFrame, else_: str | None = None) -> DataFrame:
    """A stored table of texts, broadcast if its bytes are few; else left to a shuffle join, or hinted to one."""
    if _bytes(df) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint(else_) if else_ else df


def _share(count: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(UNIT * (count + smooth) / (total + smooth * terms)), in whole numbers."""
    up = (count + smooth).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", up, (total + smooth * terms).cast("decimal(20,0)")) + 1


def _differences(vectors: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums of |p - q| over the terms of each language, for all pairs
    of its sources. ``vectors``: (lang, base, at, p): ``base`` has the share of a count of 0 for every
    source of the language, ``at`` and ``p`` those with another share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, langs = _numbered(batch.column("lang"))
            for k in range(len(langs)):
                own = batch.filter(pa.array(lang == k))
                size = len(own.column("base")[0])
                step = max(1, CELLS // max(1, size))
                for i in range(0, own.num_rows, step):
                    some = own.slice(i, step)
                    shares = some.column("base").flatten().to_numpy().reshape(some.num_rows, size).copy()
                    rows = np.repeat(np.arange(some.num_rows), some.column("at").value_lengths().to_numpy(zero_copy_only=False))
                    shares[rows, some.column("at").flatten().to_numpy()] = some.column("p").flatten().to_numpy()
                    for a in range(size):
                        value = np.abs(shares - shares[:, a : a + 1]).sum(0)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([langs[k].as_py()] * size, pa.string()), pa.array(np.full(size, a, np.int32)),
                             pa.array(np.arange(size, dtype=np.int32)), pa.array(value)], ["lang", "a", "b", "value"],
                        )

    sums = vectors.mapInArrow(run, "lang string, a int, b int, value long")
    return sums.where("a <> b").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, smooth: int = SMOOTH) -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says, for ``docs`` (lang, source, text)."""
    by_lang = save(chunk_docs(docs), "chunk-docs")
    terms = save(chunk_terms(by_lang.select("chunk").distinct()), "chunk-terms")
    joined = save(chunk_term_docs(by_lang, terms), "chunk-term-docs")
    bounds = save(term_bounds(joined, min_docs), "bounds")
    dictionary = joined.join(_hinted(bounds), ["lang", "term"])
    dictionary = save(dictionary.select("lang", "chunk", "term", "k", "open"), "dictionary")
    groups = save(source_numbers(docs), "sources")
    sums = save(chunk_sums(docs, groups, dictionary), "sums")
    many = sums.where("row is not null").groupBy("lang", "term").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    kept = save(bounds.where("not open").select("lang", "term").unionByName(many.select("lang", "term")), "terms")
    n = sums.where("row is null").select("lang", "at", "term", "n").join(_hinted(kept), ["lang", "term"])
    n = save(n, "occurrences")

    # Groups and languages: small tables beside the terms.
    totals = n.groupBy("lang", "at").agg(F.sum("n").alias("total"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = groups.join(totals, ["lang", "at"], "left").join(v, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"), "at"
    )
    groups = save(groups, "groups")
    p = _share(F.col("n"), F.col("total"), F.col("v"), smooth)
    shares = n.join(_hinted(groups), ["lang", "at"]).select("lang", "source", "term", "at", "n", p.alias("p"))

    # Term rows: the group's share against its language's.
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("v").alias("v"))
    of_lang = n.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(_hinted(save(whole, "languages")), "lang")
    of_lang = of_lang.select("lang", "term", _share(F.col("n"), F.col("total"), F.col("v"), smooth).alias("q"))
    more = shares.join(of_lang, ["lang", "term"]).where("n > 0 and p > q")
    term_rows = more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    term_rows = term_rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    # Pair rows: one vector a term, as long as the language has sources.
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"), smooth)).otherwise(F.lit(0).cast("long"))
    bases = groups.where("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", zero.alias("p")))).alias("all"))
    bases = save(bases.select("lang", F.col("all.p").alias("base")), "bases")
    by_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("all"))
    small = (groups.count() * 8) <= BROADCAST_BYTES
    vectors = by_term.join(F.broadcast(bases) if small else bases, "lang")
    sums = save(_differences(vectors.select("lang", "base", F.col("all.at").alias("at"), F.col("all.p").alias("p"))), "differences")
    a = groups.select("lang", F.col("at").alias("a"), "source")
    b = groups.select("lang", F.col("at").alias("b"), F.col("source").alias("item"))
    pairs = a.join(b, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(first))

    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", pairs), ("term", term_rows))]
    return parts[0].unionByName(parts[1])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT g.lang, g.source, k.term, coalesce(sum(t.n), 0)::HUGEINT AS n
      FROM g JOIN k USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY ALL),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS nn FROM c GROUP BY ALL),
lt AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
ln AS (SELECT *, sum(n) OVER (PARTITION BY lang)::HUGEINT AS nn FROM lt),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 5)) // (gn.nn + 5 * v.v) AS p
      FROM c JOIN gn USING (lang, source) JOIN v USING (lang)),
q AS (SELECT ln.lang, ln.term, 1 + (1000000000::HUGEINT * (ln.n + 5)) // (ln.nn + 5 * v.v) AS q FROM ln JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
                  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) x
       ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
tm AS (SELECT p.lang, p.source, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
un AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term', item, value FROM tm)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM un)
WHERE part = 'pair' OR rank <= 50
"""
