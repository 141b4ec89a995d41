"""Target-distribution importance resampling over hashed runs of words.

Every run of 1 to ``n`` consecutive words is a feature; its bucket is the CRC-32 of its
UTF-8 bytes modulo ``BUCKETS``. A document's weight says how much more likely its
buckets are in the target (``benchmark``) than in the corpus; Gumbel noise from the
hash of its id turns the weights into a draw without replacement of a share of them.

The scan is an Aho-Corasick automaton over the words between delimiters:

1. A text is normalised byte by byte: A-Z lower-cased, every byte of no word a space.
2. The dictionary holds distinct words with a space on both sides; a word's payload is
   its CRC-32 and its length. Neighbouring words share their space, so a single
   scan emits the payloads of all of a text's words in order.
3. ``compose``: the CRC of a run follows from the CRCs and lengths of its parts alone
   (appending a part of k bytes is a linear map of the CRC, tabulated by k), so adjacent
   payloads compose to the buckets of longer runs, and no run is ever spelled out.

The dictionary is a cache of a task, of ``DICTIONARY_BYTES`` at most: words that a scan
finds between two matches are hashed directly, and enter it when seen twice; a full
one starts anew. What comes out depends on the words alone.

Buckets of a document are stored once (``features``); counts (``BUCKETS`` rows) and weights
read that table and not the texts. The draw takes no global sort: a histogram of the
scores (its rows are bounded by the range of the scores) gives the score at the cut, and
positions follow from range partitions and offsets (``learnlens.operators.ranking``).

Cases: a null text has no words; a document without words has weight 0 and takes part
in the draw only if ``min_words`` is 0; a null id hashes as the text ``null`` and loses
ties; rows that agree in score and id are interchangeable, and each has its own rank; an
empty target or corpus leaves the smoothing alone; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.llm.common import save, text_parts
from learnlens.operators.ranking import with_position

WORDS = 1
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
# Bytes of words in a task's dictionary; at some 50 bytes of automaton a byte.
DICTIONARY_BYTES = 1_000_000

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_GAPS = re.compile(b"  +")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """Four tables by byte of a CRC: what it becomes when ``length`` zero bytes follow."""
    if length not in _SHIFTS:
        if len(_SHIFTS) > 1_000:
            _SHIFTS.clear()
        # Images of the 32 single bits, by doubling: the map of 2k bytes is that of k bytes twice.
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        power, out = (bits >> np.uint32(8)) ^ _TABLE[bits & 0xFF], bits
        for k in range(max(1, length.bit_length())):
            if length >> k & 1:
                out = _linear(power, out)
            power = _linear(power, power)
        byte = np.arange(256, dtype=np.uint32)
        _SHIFTS[length] = np.stack([_linear(out, byte << np.uint32(8 * i)) for i in range(4)])
    return _SHIFTS[length]


def _linear(images: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with these images of the bits, at every x."""
    out = np.zeros_like(x)
    for i in range(32):
        out ^= np.where(x >> np.uint32(i) & np.uint32(1), images[i], np.uint32(0))
    return out


def compose(crc: np.ndarray, more: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of two texts in a row from their CRCs and the second's length in bytes."""
    out = np.empty_like(crc)
    for length in np.unique(lengths).tolist():
        at = lengths == length
        t, c = _shift(length), crc[at]
        out[at] = t[0, c & 0xFF] ^ t[1, c >> 8 & 0xFF] ^ t[2, c >> 16 & 0xFF] ^ t[3, c >> 24]
    return out ^ more


class WordDictionary:
    """The automaton over delimited words, with the payloads of every word of a scanned text."""

    def __init__(self, limit: int = DICTIONARY_BYTES):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        # Payloads by the number that the automaton stores for a word: CRC, bytes, characters.
        self.payload = np.empty((0, 3), np.int64)
        self.size = 0
        self.once: set[str] = set()
        self.twice: set[str] = set()
        self.waiting = 0

    @staticmethod
    def _payload(word: str) -> tuple[int, int, int]:
        raw = word.encode("utf-8", "surrogateescape")
        return zlib.crc32(raw), len(raw), len(word)

    def _learn(self, words: list[str]) -> None:
        """Words seen twice enter when they are many against the dictionary, so all rebuilds
        together cost about as much as the last one."""
        for w in words:
            if w not in self.once:
                self.once.add(w)
                self.waiting += len(w)
            else:
                self.twice.add(w)
        if 2 * len(self.twice) < max(1_000, len(self.payload)):
            if self.waiting > self.limit:
                self.once, self.waiting = set(self.twice), sum(map(len, self.twice))
                if self.waiting > self.limit // 2:
                    self._clear()
            return
        new = sorted(self.twice)
        if self.size + sum(map(len, new)) > self.limit:
            self._clear()
            while sum(map(len, new)) > self.limit // 2:
                new = new[::2] if len(new) > 1 else []
        for i, w in enumerate(new, start=len(self.payload)):
            self.automaton.add_word(f" {w} ", i)
        self.payload = np.concatenate([self.payload, np.array([self._payload(w) for w in new], np.int64).reshape(-1, 3)])
        self.size += sum(map(len, new))
        self.once, self.twice, self.waiting = set(), set(), 0
        if new:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> np.ndarray:
        """(CRC, bytes) of each word of a text in order, as two rows."""
        plain = _GAPS.sub(b" ", b" " + raw.translate(_PLAIN) + b" ").decode("utf-8", "surrogateescape")
        if len(plain) < 3:
            return np.empty((2, 0), np.int64)
        if len(self.payload):
            found = np.fromiter(chain.from_iterable(self.automaton.iter(plain)), np.int64).reshape(-1, 2)
        else:
            found = np.empty((0, 2), np.int64)
        payload = self.payload[found[:, 1]]
        # Between the spaces of two matches in a row lie words that the dictionary lacks.
        ends = np.concatenate([found[:, 0], [len(plain) - 1]])
        starts = np.concatenate([[0], found[:, 0]])
        lefts = ends - np.concatenate([payload[:, 2] + 1, [0]])
        gaps = np.flatnonzero(lefts > starts)
        if not len(gaps):
            return payload[:, :2].T
        at, more, unknown = [], [], []
        for g, start, left in zip(gaps.tolist(), starts[gaps].tolist(), lefts[gaps].tolist()):
            words = plain[start + 1 : left].split(" ")
            unknown += words
            at += [g] * len(words)
            more += map(self._payload, words)
        out = np.insert(payload, at, np.array(more, np.int64), axis=0)
        self._learn(unknown)
        return out[:, :2].T


def buckets_of(payloads: np.ndarray, n: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all runs of 1 to ``n`` words, from the words' payloads."""
    crc, size = payloads[0].astype(np.uint32), payloads[1]
    run, out = crc, [crc % buckets]
    space = np.full(1, zlib.crc32(b" "), np.uint32)
    for k in range(1, n):
        if k >= len(crc):
            break
        joint = compose(run[:-1], np.broadcast_to(space, len(run) - 1), np.ones(len(run) - 1, np.int64))
        run = compose(joint, crc[k:], size[k:])
        out.append(run % buckets)
    return np.concatenate(out).astype(np.int32)


def features(texts: DataFrame, n: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(the columns beside ``text``, n_words, buckets) for every row: one bucket for each feature."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordDictionary()
        for batch in batches:
            for part in text_parts(batch, "text"):
                payloads = [words.scan(x or b"") for x in part.column("text").cast(pa.binary()).to_pylist()]
                own = [buckets_of(p, n, buckets) for p in payloads]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))
                n_words = pa.array([p.shape[1] for p in payloads], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], n_words, lists], [*kept, "n_words", "buckets"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{schema}n_words long, buckets array<int>")


def counts(featured: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A bucket's gain: 1000 times the log of its smoothed share in the target over that in the source."""
    s, t = (c.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")) for c in (source, target))
    both = source.select("bucket", F.col("n").alias("s")).join(target.select("bucket", F.col("n").alias("t")), "bucket", "full")
    all_s, all_t = s.first()[0], t.first()[0]
    # Products of doubles: whole numbers of two counts may pass a long's range.
    plus = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    ratio = (plus("t") * F.lit(float(all_s + buckets))) / (plus("s") * F.lit(float(all_t + buckets)))
    empty = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = empty.join(both, "bucket", "left").select("bucket", F.floor(F.lit(1000) * F.ln(ratio)).alias("gain"))
    out = np.zeros(buckets, np.int64)
    # As many rows as there are buckets, whatever the tables hold.
    for r in rows.collect():
        out[r.bucket] = r.gain
    return out


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``featured`` with n_features and weight, the floored mean of the gains, for its buckets."""
    shared = featured.sparkSession.sparkContext.broadcast(gain)
    kept = [c for c in featured.columns if c != "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            sizes = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            sums = np.concatenate([[0], np.cumsum(shared.value[lists.flatten().to_numpy()])])
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            mean = total // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sizes), pa.array(mean)], [*kept, "n_features", "weight"]
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in featured.schema if f.name != "buckets")
    return featured.mapInArrow(run, f"{schema}n_features long, weight long")


def draw(weighted: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``weighted`` (doc_id, n_words, weight, ...) with score and rank; rank is null for rows that are not drawn."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    rows = weighted.withColumn("score", F.col("weight") + noise)
    # Whoever is below the score of the last row drawn gets no rank and is not sorted.
    by_score = save(rows.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")), "scores")
    n = by_score.agg(F.sum("n")).first()[0] or 0
    take = percent * n // 100
    if not take:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    above = by_score.withColumn("to", F.expr("sum(n) over (order by score desc)"))
    least = above.where(F.col("to") >= take).agg(F.max("score")).first()[0]
    fit = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = with_position(rows.where(fit), order, "rank", is_stored=True)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return ranked.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS,
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``
    (doc_id, text); rank counts the rows drawn from 1. ``target`` has the column text."""
    featured = save(features(docs.select("doc_id", "text"), n, buckets), "features")
    goal = save(features(target.select("text"), n, buckets), "target")
    gain = gains(counts(featured, buckets), counts(goal, buckets), buckets)
    weighted = save(weights(featured, gain), "weights")
    return draw(weighted, percent, min_words, seed).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


# CRC-32 is spelled out byte by byte, once a distinct word, with the table of its 256 steps.
ORACLE = r"""
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
src AS (SELECT 's' AS side, row_number() OVER () AS r, doc_id, text FROM documents
        UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
txt AS (SELECT side, r, doc_id,
               coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM src),
f AS (SELECT side, r, w, count(*)::BIGINT AS n FROM (SELECT side, r, unnest(w) AS w FROM txt) GROUP BY ALL),
dict AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM f),
crc AS (
  SELECT w, xor(list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::UBIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT % 10000 AS b
  FROM dict, tab),
n AS (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f JOIN crc USING (w) GROUP BY b),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM n),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS g FROM n, tot),
wt AS (SELECT r, sum(n)::BIGINT AS nf, sum(n * g)::BIGINT AS sg FROM f JOIN crc USING (w) JOIN gain USING (b) WHERE side = 's' GROUP BY r),
sc AS (
  SELECT doc_id, coalesce(nf, 0)::BIGINT AS n_features,
         coalesce((sg - ((sg % nf) + nf) % nf) // nf, 0)::BIGINT AS weight, len(w) AS n_words,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM txt LEFT JOIN wt USING (r) WHERE side = 's'),
fin AS (SELECT doc_id, n_features, weight, n_words,
               weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM sc),
elig AS (SELECT *, n_words >= 20 AS ok, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS rn,
                count(*) OVER (PARTITION BY n_words >= 20) AS many FROM fin)
SELECT doc_id, n_features, weight, score, CASE WHEN ok AND rn <= 10 * many // 100 THEN rn END::BIGINT AS rank FROM elig
"""
