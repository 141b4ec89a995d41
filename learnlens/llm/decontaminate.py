"""Benchmark decontamination by a broadcast hash set of test n-grams.

1. ``windows``: every item of the benchmark becomes its windows, runs of ``N`` normalised
   words (an item of fewer words is one window), with the ids of the items;
2. the windows' words get numbers, and a window the polynomial hash of its numbers; the
   hashes are one sorted array a window length, broadcast to the tasks;
3. ``scan``: a task reads whole texts, numbers the words (0: in no window), hashes every
   run without a 0, looks the hashes up and *verifies* a hit number by number;
4. ``clean`` removes the hit spans, or the documents.

The texts never leave their task: the scan is one narrow stage without a shuffle.

Bound of the broadcast: a block of windows has at most ``BLOCK_BYTES`` bytes of words.
A larger benchmark is cut into blocks by hash; the texts are scanned once a block, the
hits are kept by the text's digest, merged, and joined back to all rows (equal texts
have equal hits), so any benchmark gives the result of a single scan.

A word is a run of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased.
A word is hit if it lies inside any occurrence of a window.

Cases: a null or empty text has no words and no hits; an item without words has no
window; rows of equal item_id are one item; rows with a null item_id are together one
item, listed last as the empty string; an empty benchmark hits nothing; repeated
documents are judged each by itself; an empty table gives no rows; other columns are
not read by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnlens.llm.common import ascii_lower, save, text_parts

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of window words that one broadcast holds at most (one window more at the end).
BLOCK_BYTES = 16_000_000
MARK = ""
TEXT = "__text"

# A-Z to a-z; every byte that belongs to no word to a space. Bytes of characters beyond
# ASCII stay, so bytes can be cut like characters.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_RUN = re.compile(rb"[^ ]+")
SPAN = ("first", "last", "start", "end")
SPANS = f"array<struct<{','.join(f'`{x}`:bigint' for x in SPAN)}>>"
HITS = f"n_words long, n_hit long, items array<string>, spans {SPANS}"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item, words) for every distinct window of every item; item is null for a null id."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.expr(f"sequence(1, greatest(size(all) - {n - 1}, 1))")
    w = w.withColumn("start", F.explode(starts))
    return w.select("item", F.slice("all", F.col("start"), F.lit(n)).alias("words")).distinct()


class WindowSet:
    """Windows by length: sorted hashes, the windows' word numbers and their items."""

    def __init__(self, rows: list[tuple[str | None, list[str]]]):
        self.number: dict[bytes, int] = {}
        by_window: dict[tuple[int, ...], set[str | None]] = {}
        for item, words in rows:
            ids = tuple(self.number.setdefault(w.encode(), len(self.number) + 1) for w in words)
            by_window.setdefault(ids, set()).add(item)
        self.tables = []
        for length in sorted({len(w) for w in by_window}):
            own = [w for w in by_window if len(w) == length]
            ids = np.array(own, np.uint64)
            # Another multiplier if two windows share a hash, so a hash has one window to verify.
            for multiplier in range(0x9E3779B97F4A7C15, 2**64, 2):
                hashes = self.hashes(ids.T, multiplier)
                if len(np.unique(hashes)) == len(own):
                    break
            order = np.argsort(hashes)
            items = [sorted(by_window[own[i]], key=lambda x: (x is None, x)) for i in order]
            self.tables.append((length, multiplier, hashes[order], ids[order], items))

    @staticmethod
    def hashes(columns, multiplier: int) -> np.ndarray:
        h, m = np.uint64(0), np.uint64(multiplier)
        for c in columns:
            h = (h ^ c) * m
            h = h ^ (h >> np.uint64(29))
        return h

    def find(self, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
        """(length, places, window of each place, items of the windows) for each length.

        ``numbers`` has a 0 between two texts, so no run crosses from one into the next."""
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        for length, multiplier, hashes, ids, items in self.tables:
            if len(numbers) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            h = self.hashes((numbers[at + i] for i in range(length)), multiplier)
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[found] == h
            at, found = at[hit], found[hit]
            same = np.ones(len(at), bool)
            for i in range(length):
                same &= numbers[at + i] == ids[found, i]
            yield length, at[same], found[same], items


def _spans(raw: bytes, plain: bytes, first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, given by their first and last word, with their code point places. Ends are exclusive."""
    at = np.array([m.span() for m in _RUN.finditer(plain)], np.int64)
    # Code points before each byte: all bytes but the following ones of a character.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    ends = zip(first.tolist(), (last + 1).tolist(), before[at[first, 0]].tolist(), before[at[last, 1]].tolist())
    return [dict(zip(SPAN, x)) for x in ends]


def _judge(raws: list[bytes], window_set: WindowSet) -> Iterator[tuple]:
    """(n_words, n_hit, items, spans) for each text."""
    get = window_set.number.get
    plains = [raw.translate(_PLAIN) for raw in raws]
    words = [[get(w, 0) for w in plain.split()] for plain in plains]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    numbers = np.zeros(starts[-1], np.uint64)
    for start, w in zip(starts, words):
        numbers[start : start + len(w)] = w
    edge = np.zeros(len(numbers) + 1, np.int64)
    items: dict[int, set] = {}
    for length, at, found, owners in window_set.find(numbers):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        text = np.searchsorted(starts, at, side="right") - 1
        for t, f in np.unique(np.stack([text, found]), axis=1).T.tolist():
            items.setdefault(t, set()).update(owners[f])
    covered = np.cumsum(edge[:-1]) > 0
    for t, raw in enumerate(raws):
        if t not in items:
            yield int(sizes[t]), 0, [], []
            continue
        hit = covered[starts[t] : starts[t] + sizes[t]]
        turn = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1
        yield int(sizes[t]), int(hit.sum()), list(items[t]), _spans(raw, plains[t], first, last)


def _scan_block(rows: DataFrame, block: list[tuple[str | None, list[str]]]) -> DataFrame:
    """``rows`` with the columns of HITS in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(WindowSet(block))
    kept = [c for c in rows.columns if c != TEXT]
    hit_type = pa.list_(pa.struct([(x, pa.int64()) for x in SPAN]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, TEXT):
                raws = [x or b"" for x in part.column(TEXT).cast(pa.binary()).to_pylist()]
                judged = list(zip(*_judge(raws, shared.value)))
                types = (pa.int64(), pa.int64(), pa.list_(pa.string()), hit_type)
                arrays = [pa.array(list(x), t) for x, t in zip(judged, types)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], *arrays], [*kept, "n_words", "n_hit", "items", "spans"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != TEXT)
    return rows.mapInArrow(run, f"{schema}, {HITS}" if kept else HITS)


def _blocks(items: DataFrame, n: int, block_bytes: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The windows in blocks of bounded bytes, one at a time on the driver."""
    w = save(windows(items, n).select("item", "words", F.octet_length(F.concat_ws(" ", "words")).alias("bytes")), "windows")
    total = w.agg(F.sum("bytes")).first()[0] or 0
    count = -(-total // block_bytes)
    for k in range(count):
        own = w.where(F.pmod(F.xxhash64("item", "words"), F.lit(count)) == k)
        yield [(r.item, r.words) for r in own.select("item", "words").collect()]


def scan(docs: DataFrame, items: DataFrame, n: int = N, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and HITS for every row of ``docs``: number of words, of hit words, the ids
    of the items with occurring windows, the hit runs of words as spans of code points."""
    rows = docs.select(*keep, F.col("text").alias(TEXT))
    blocks = _blocks(items, n, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _scan_block(rows, first)
    # Over one block: hits by the text's digest, merged over the blocks.
    digest = F.sha2(F.coalesce(TEXT, F.lit("")), 256)
    keyed = rows.select(digest.alias("digest"), TEXT)
    found = []
    block: list | None = first
    while block is not None:
        hits = _scan_block(keyed, block).where("n_hit > 0").dropDuplicates(["digest"])
        found.append(save(hits, "hits"))
        block, second = second, next(blocks, None)
    hits = reduce(DataFrame.unionByName, found)
    # As many rows a text as there are blocks; runs that touch or overlap become one.
    merged = hits.groupBy("digest").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    none = f"cast(array() as {SPANS})"
    merged = merged.withColumn("spans", F.expr(f"""
        aggregate(spans, {none}, (done, s) -> CASE
          WHEN size(done) > 0 AND s.first <= element_at(done, -1).last
          THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
            'first', element_at(done, -1).first, 'last', greatest(element_at(done, -1).last, s.last),
            'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
          ELSE concat(done, array(s)) END)"""))
    joined = rows.withColumn("__digest", digest).join(
        merged.select(F.col("digest").alias("__digest"), "items", "spans"), "__digest", "left"
    )
    n_words = F.coalesce(F.size(words_of(F.col(TEXT))), F.lit(0)).cast("long")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])
    return joined.select(
        *keep, n_words.alias("n_words"), F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce("spans", F.expr(none)).alias("spans"),
    )


def clean(docs: DataFrame, items: DataFrame, how: str = "spans", n: int = N, mark: str = MARK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the hit spans replaced by ``mark`` (how="spans"), or without the
    documents that have a hit (how="documents"). The columns stay; ``n_chars`` follows the text."""
    if how not in ("spans", "documents"):
        raise ValueError(f"how is spans or documents, not {how!r}")
    # All columns go through under names that cannot clash.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    held = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(docs.columns, names)]).withColumn("text", F.col(names[at]))
    hit = scan(held, items, n, block_bytes, tuple(names))
    if how == "documents":
        return hit.where("n_hit = 0").select(*[F.col(x).alias(c) for c, x in zip(docs.columns, names)])
    text = F.col(names[at])
    # What lies between the spans: from the end of each (or the start) to the start of the next (or the end).
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.char_length(text).cast("long")))
    between = F.zip_with(starts, ends, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    cleaned = F.when(F.size("spans") == 0, text).otherwise(F.array_join(between, mark))
    kept = {"text": cleaned}
    if "n_chars" in docs.columns:
        n_chars = F.col(names[docs.columns.index("n_chars")])
        kind = dict(docs.dtypes)["n_chars"]
        kept["n_chars"] = F.when(F.size("spans") == 0, n_chars).otherwise(F.char_length(cleaned).cast(kind))
    return hit.select(*[kept.get(c, F.col(x)).alias(c) for c, x in zip(docs.columns, names)])


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns: ids sorted as strings (a null id last), joined and hashed."""
    ids = F.transform(
        F.array_sort(F.transform("items", lambda x: F.struct(x.isNull().alias("null"), F.coalesce(x, F.lit("")).alias("id")))),
        lambda x: x["id"],
    )
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
lens AS (SELECT DISTINCT n FROM win),
run AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, run.n, i, item_id FROM run JOIN win ON run.n = win.n AND run.s = win.s),
words AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
