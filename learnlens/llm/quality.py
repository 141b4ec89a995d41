"""Quality scores by co-training two classifiers on two views of a document.

Views: the *text* (its words; shares of kinds of characters, word and line repetition,
word lengths) and the *metadata* beside it (language, source, stated length,
and the page's host where a page of the same id exists). Each view has an
additive logistic model: a feature's value picks one of its quantile bins, or a
category its own weight, and the weights of the picked ones add up.

A document is bad if its label says so or says that it is toxic.

Words: in the labelled sample a word (hashed to ``WORDS`` buckets) leans to the good or the
bad documents by the log of its smoothed odds. A text is described by the words that
lean most to the bad side, their sum, and the mean of all. Labelled rows are described by the
words of the other ``FOLDS`` - 1 parts of the sample, so that no row is judged by itself.

Co-training: both models are fitted on the labelled rows. In each round each model
scores *all* unlabelled rows, in tasks, and hands those it is most sure of, good and bad
in the proportion of the labels and a share that grows by the round, as pseudo-labels to the
*other* model's training set; then both are fitted again. Labels held back from the
training calibrate each view (Platt scaling) and weigh the two calibrated views against each
other; the combined score is the probability of good quality for every document.

Bounds: a fit takes at most ``LABELLED`` labelled rows and ``PICKED`` of the rows that
were handed over, picked by the hash of the id. Bins are quantiles of all rows, categories are
counted over all rows, all unlabelled rows are scored in each round, and features and
scores cover every row and the whole text: one pass over the texts writes some thirty
numbers a row, and everything else reads these.

Cases: a null text is the empty text; null metadata are a category of their
own; of several labels of an id the lowest counts; a null mark says nothing, and a label of
two nulls is none; without labels of both kinds every document scores the share of good labels (1
without any); equal rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.llm.common import WORD, broadcast_if_bounded, save, text_parts, url_host

LABELLED, PICKED = 8_000, 4_000
ROUNDS, SHARE_PER_ROUND = 4, 0.05
SURE = 0.95
# Categories that occur in fewer rows share one weight.
LEAST = 20
# Buckets of words, parts of the sample, and documents that a word needs to count.
WORDS, FOLDS, SIGHTINGS = 1 << 20, 4, 3
# Steps of a margin by which the surest rows are found.
STEP, FAR = 0.01, 30.0
FIT_ROWS = 1_000
META = ("lang", "source", "host")
# Below even odds, since a good document lost costs more than a bad one kept.
KEEP_FROM = 0.3
BINS = 10

_WORD = re.compile(WORD)
_KINDS = np.zeros(256, np.int64)  # 0: other symbols
for _k, _chars in enumerate(
    (range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:'\"-()?", b"!", b"|", range(128, 256)), start=1
):
    _KINDS[list(_chars)] = _k
TEXT_FEATURES = (
    "symbols", "lower", "upper", "digits", "spaces", "line_ends", "other_space", "marks", "shouts", "bars", "beyond_ascii",
    "log_words", "word_chars", "different", "different_by_length", "top_word", "repeats", "different_lines", "line_words", "longest_word",
    "bad_words", "worst_words", "leaning",
)

# A-Z to a-z; every byte of no word to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_buckets(text: str | None) -> np.ndarray:
    """The buckets of the distinct words: runs of letters and characters beyond ASCII, A-Z in lower case."""
    words = set((text or "").encode("utf-8", "replace").translate(_PLAIN).split())
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % WORDS)


@dataclass
class Leaning:
    """How words lean: ``place`` of a bucket's column (0: unknown), and a row of weights for
    the whole sample and, after it, for the sample without each of its parts."""

    place: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, counts: pd.DataFrame, sizes: dict[tuple[int, int], int]) -> Leaning:
        """From (fold, y, bucket, n): documents with a word; and the documents by (fold, y)."""
        buckets = np.unique(counts["bucket"].to_numpy(np.int64))
        place = np.zeros(WORDS, np.int32)
        place[buckets] = np.arange(1, len(buckets) + 1)
        seen = np.zeros((FOLDS, 2, len(buckets) + 1))
        seen[counts["fold"].to_numpy(int), counts["y"].to_numpy(int), place[counts["bucket"].to_numpy(np.int64)]] = counts["n"]
        total = np.array([[sizes.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)], float)
        out = []
        for left_out in (None, *range(FOLDS)):
            kept = [f for f in range(FOLDS) if f != left_out]
            n, of = seen[kept].sum(0), np.maximum(total[kept].sum(0), 1)
            prior = of / of.sum()
            odds = np.log((n[1] + prior[1]) / of[1]) - np.log((n[0] + prior[0]) / of[0])
            # The fewer documents, the less it says; an unseen word says nothing.
            out.append(odds * n.sum(0) / (n.sum(0) + SIGHTINGS))
        return cls(place, np.array(out, np.float32))

    @classmethod
    def none(cls) -> Leaning:
        return cls(np.zeros(WORDS, np.int32), np.zeros((FOLDS + 1, 1), np.float32))

    def features(self, text: str | None, fold: int) -> list[float]:
        """``fold``: the row's part of the sample, or -1 for a row that is not in it."""
        v = np.sort(self.weights[fold + 1, self.place[word_buckets(text)]])
        return [float(np.log1p(-v[v < -1].sum())), float(v[:3].sum()), float(v.mean()) if len(v) else 0.0]


def text_features(text: str | None) -> list[float]:
    """Of the whole text; shares are of bytes, words or lines."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_KINDS[raw], minlength=11) / max(1, len(raw))
    words = _WORD.findall(text or "")
    n = max(1, len(words))
    counts = Counter(words)
    different = len(counts) / n
    lines = [x for x in (text or "").split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    return [
        *kinds, np.log1p(len(words)), len(raw) / n, different, different * np.log1p(n),
        max(counts.values(), default=0) / n, repeats, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        np.log1p(max(map(len, counts), default=0)),
    ]


@dataclass
class View:
    """An additive logistic model over numbers (by quantile bin) and categories."""

    numbers: int
    edges: list[np.ndarray] = field(default_factory=list)
    levels: list[dict[str, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    def picks(self, x: np.ndarray, c: list[list[str]]) -> np.ndarray:
        """The numbers of the weights that a row picks, one per feature."""
        out, at = [], 1
        for j, e in enumerate(self.edges):
            out.append(at + np.searchsorted(e, x[:, j], side="right"))
            at += len(e) + 1
        for known, values in zip(self.levels, c):
            out.append(at + np.array([known.get(v, 0) for v in values], np.int64))
            at += len(known) + 1
        self.width = at
        return np.array(out, np.int64).reshape(len(out), len(x)).T

    def fit(self, picks: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 15) -> None:
        """Newton's method on the penalised likelihood; rows are spread to columns a block at a time."""
        w = np.zeros(self.width)
        for _ in range(rounds):
            grad, second = l2 * w, l2 * np.eye(self.width)
            for i in range(0, len(y), FIT_ROWS):
                own = picks[i : i + FIT_ROWS]
                z = np.zeros((len(own), self.width))
                z[:, 0] = 1
                z[np.arange(len(own))[:, None], own] = 1
                p = _sigmoid(z @ w)
                grad += z.T @ (p - y[i : i + FIT_ROWS])
                second += (z * (p * (1 - p))[:, None]).T @ z
            step = np.linalg.solve(second, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def margin(self, picks: np.ndarray) -> np.ndarray:
        return self.weights[0] + self.weights[picks].sum(1)

    def calibrate(self, picks: np.ndarray, y: np.ndarray) -> None:
        self.scale = tuple(_logistic(self.margin(picks)[:, None], y))

    def calibrated(self, picks: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.margin(picks) + self.scale[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the constant of a small logistic regression."""
    # Platt's targets keep the fit finite when the classes part cleanly.
    good = (y.sum() + 1) / (y.sum() + 2)
    bad = 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, good, bad)
    z = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + l2 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, z.T @ (p - t) + l2 * w), -5, 5)
    return w


@dataclass
class CoTrained:
    text: View
    meta: View
    mix: np.ndarray  # weights of the two calibrated views, and a constant
    rounds: list[tuple[int, int]]  # pseudo-labels handed to the text and the metadata model
    constant: float | None = None

    def score(self, x: np.ndarray, m: np.ndarray, c: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.constant is not None:
            one = np.full(len(x), self.constant)
            return one, one, one
        a = self.text.calibrated(self.text.picks(x, []))
        b = self.meta.calibrated(self.meta.picks(m, c))
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def co_train(known: pd.DataFrame, text: View, meta: View, exchange, rounds: int = ROUNDS) -> CoTrained:
    """From rows with ``feats``, ``n_chars``, ``lang``, ``source``, ``host``, ``y`` (1: good) and
    ``held`` (kept back for calibration), and views with their bins and levels.

    ``exchange(text, meta, good share, share of all)`` lets both fitted views score all unlabelled
    rows and returns those that each is surest of, with its verdict as ``y``."""
    y_all = known["y"].to_numpy(float) if len(known) else np.empty(0)
    train = known[~known["held"]] if len(known) else known
    held = known[known["held"]] if len(known) else known
    if not len(known) or any(part["y"].nunique() < 2 for part in (train, held)):
        return CoTrained(text, meta, np.zeros(3), [], float(y_all.mean()) if len(y_all) else 1.0)
    y = train["y"].to_numpy(float)
    views = ((text, lambda p: text.picks(_numbers(p), [])), (meta, lambda p: meta.picks(_lengths(p), _categories(p))))
    # What each view has been given by the other one.
    given = [train.iloc[:0], train.iloc[:0]]
    log = []
    for r in range(rounds + 1):
        for (view, of), extra in zip(views, given):
            view.fit(np.vstack([of(train), of(extra)]), np.concatenate([y, extra["y"].to_numpy(float)]))
        if r < rounds:
            by_text, by_meta = exchange(text, meta, float(y.mean()), SHARE_PER_ROUND * (r + 1))
            given = [by_meta, by_text]
            log.append((len(by_meta), len(by_text)))
    t = held["y"].to_numpy(float)
    sides = []
    for view, of in views:
        view.calibrate(of(held), t)
        sides.append(view.calibrated(of(held)))
    return CoTrained(text, meta, _logistic(np.column_stack(sides), t), log)


def thresholds(counts: np.ndarray, good: float, share: float) -> tuple[float, float]:
    """Margins from which on a row is handed over as good, and up to which as bad: the surest
    ``share`` of all rows, in the labels' proportion, and sure enough. ``counts``: rows by step."""
    n = counts.sum() * share
    sure = np.log(SURE / (1 - SURE))
    from_top, from_below = np.cumsum(counts[::-1]), np.cumsum(counts)
    # Whole steps only, so that equal rows are treated alike.
    up = FAR - STEP * np.searchsorted(from_top, n * good, side="right")
    down = -FAR + STEP * np.searchsorted(from_below, n * (1 - good), side="right")
    return max(up, sure), min(down, -sure)


def steps(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((margin + FAR) / STEP), 0, round(2 * FAR / STEP) - 1).astype(np.int64)


def pick(step: np.ndarray, up: float, down: float) -> np.ndarray:
    """1 for rows handed over as good, 0 as bad, -1 for the rest, by their steps."""
    at = step * STEP - FAR
    return np.where(at >= up - STEP / 2, 1, np.where(at + STEP <= down + STEP / 2, 0, -1))


def _numbers(p: pd.DataFrame) -> np.ndarray:
    return np.array(p["feats"].tolist(), float).reshape(len(p), len(TEXT_FEATURES))


def _lengths(p: pd.DataFrame) -> np.ndarray:
    return np.log1p(np.maximum(p["n_chars"].to_numpy(float), 0))[:, None]


def _categories(p: pd.DataFrame) -> list[list[str]]:
    return [p[c].tolist() for c in META]


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, y, fold, held): at most ``most`` labelled ids of ``docs``, by the hash of the id."""
    toxic = F.coalesce(F.col("toxic") > 0, F.lit(False)) if "toxic" in labels.columns else F.lit(False)
    y = F.when(toxic, F.lit(0)).when(F.col("quality").isNotNull(), (F.col("quality") > 0).cast("int"))
    known = labels.select("doc_id", y.alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    known = save(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id")), "labelled")
    share = F.col("h").cast("double") / 2.0**64 + 0.5  # uniform in [0, 1)
    some = known.where(share < min(1.0, 1.1 * most / max(1, known.count()))).orderBy("h").limit(most)
    fold = F.pmod(F.shiftright("h", 8), F.lit(FOLDS)).cast("int")
    return save(some.select("doc_id", "y", fold.alias("fold"), (F.pmod("h", F.lit(4)) == 0).alias("held")), "sample")


def word_leaning(docs: DataFrame, sample: DataFrame) -> Leaning:
    """From the texts of the labelled sample, counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                found = [word_buckets(t) for t in part.column("text").to_pylist()]
                sizes = [len(f) for f in found]
                fold, y = (np.repeat(part.column(c).to_numpy(), sizes) for c in ("fold", "y"))
                columns = [pa.array(c.astype(np.int32)) for c in (fold, y, np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, ["fold", "y", "bucket"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("fold", "y", "text")
    counts = rows.mapInArrow(run, "fold int, y int, bucket int").groupBy("fold", "y", "bucket").agg(F.count("*").alias("n"))
    counts = save(counts, "words")
    # What occurs in a document or two says nothing; the rest is bounded by the sample.
    often = counts.groupBy("bucket").agg(F.sum("n").alias("all")).where(F.col("all") >= SIGHTINGS).select("bucket")
    sizes = {(r.fold, r.y): r["n"] for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    return Leaning.fit(counts.join(often, "bucket").toArrow().to_pandas(), sizes) if sizes else Leaning.none()


def features(docs: DataFrame, pages: DataFrame | None, sample: DataFrame) -> DataFrame:
    """(doc_id, feats, n_chars, lang, source, host, y, held) per row; one pass over the texts.
    y is null for rows out of the ``sample`` (``labelled_rows``)."""
    have = set(docs.columns)
    column = lambda c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)).alias(c) if c in have else F.lit(other).alias(c)
    typed = dict(docs.dtypes)["doc_id"]
    leaning = docs.sparkSession.sparkContext.broadcast(word_leaning(docs, sample))

    kept = ["doc_id", "n_chars", "lang", "source", "y", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch has a number of rows, whatever their length; a part of it bounds what they take in a worker.
            for part in text_parts(batch, "text"):
                texts, folds = (part.column(c).to_pylist() for c in ("text", "fold"))
                feats = np.array([[*text_features(t), *leaning.value.features(t, f)] for t, f in zip(texts, folds)], np.float32)
                ends = np.arange(0, feats.size + 1, feats.shape[1], dtype=np.int32)
                columns = [*(part.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(ends), pa.array(feats.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "feats"])

    rows = docs.select("doc_id", "text", column("n_chars", "double", -1.0), column("lang", "string", "null"), column("source", "string", "null"))
    rows = rows.join(F.broadcast(sample), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "n_chars", "lang", "source", F.coalesce("y", F.lit(-1)).alias("y"),
        F.coalesce("held", F.lit(False)).alias("held"), F.coalesce("fold", F.lit(-1)).alias("fold"), "text",
    )
    rows = rows.mapInArrow(run, "doc_id string, n_chars double, lang string, source string, y int, held boolean, feats array<float>")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast(typed)).withColumn("y", F.when(F.col("y") >= 0, F.col("y")))
    if pages is None:
        return rows.withColumn("host", F.lit("null"))
    # One host per id, so a page id that is repeated does not repeat documents.
    hosts = pages.groupBy(F.col("page_id").alias("doc_id")).agg(F.min(url_host(F.col("url"))).alias("host"))
    return save(rows, "features").join(hosts, "doc_id", "left").withColumn("host", F.coalesce("host", F.lit("null")))


def views_of(rows: DataFrame) -> tuple[View, View]:
    """Both views with bins and levels: quantiles of all rows; categories of the sample that
    occur ``LEAST`` times in all rows (one that no label has could learn nothing)."""
    q = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    numbers = [F.col("feats")[j] for j in range(len(TEXT_FEATURES))] + [F.log1p(F.greatest(F.col("n_chars"), F.lit(0.0)))]
    found = rows.agg(*[F.percentile_approx(c.cast("double"), q, 2_000).alias(f"q{j}") for j, c in enumerate(numbers)]).first()
    edges = [np.unique(np.array(e if e is not None else [], float)) for e in found]
    pairs = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(META)])))
    wanted = save(pairs(rows.where("y is not null")).distinct(), "levels")
    often = pairs(rows).join(F.broadcast(wanted), ["i", "v"]).groupBy("i", "v").count().where(F.col("count") >= LEAST).collect()
    levels = [{v: k for k, v in enumerate(sorted(r.v for r in often if r.i == i), start=1)} for i in range(len(META))]
    return View(len(TEXT_FEATURES), edges[:-1]), View(1, edges[-1:], levels)


def margins(b: pd.DataFrame, text: View, meta: View) -> list[np.ndarray]:
    return [text.margin(text.picks(_numbers(b), [])), meta.margin(meta.picks(_lengths(b), _categories(b)))]


def train(rows: DataFrame) -> CoTrained:
    """Fit on stored ``features``."""
    unlabelled = rows.where("y is null")
    context = rows.sparkSession.sparkContext
    text, meta = views_of(rows)
    many = round(2 * FAR / STEP)

    def exchange(text: View, meta: View, good: float, share: float) -> list[pd.DataFrame]:
        views = context.broadcast((text, meta))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, many), np.int64)
            for b in batches:
                for k, m in enumerate(margins(b, *views.value)):
                    total[k] += np.bincount(steps(m), minlength=many)
            k, at = np.nonzero(total)
            yield pd.DataFrame({"view": k, "step": at, "n": total[k, at]})

        found = unlabelled.mapInPandas(count, "view int, step int, n long").groupBy("view", "step").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros((2, many), np.int64)
        for r in found:
            counts[r.view, r.step] = r["n"]
        cuts = [thresholds(c, good, share) for c in counts]

        def hand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for k, (m, cut) in enumerate(zip(margins(b, *views.value), cuts)):
                    y = pick(steps(m), *cut)
                    yield b.assign(view=k, y=y)[y >= 0]

        columns = "h long, n_chars double, lang string, source string, host string, feats array<float>"
        handed = unlabelled.withColumn("h", F.xxhash64("doc_id", "n_chars", "feats")).select(*[c.split()[0] for c in columns.split(", ")])
        handed = handed.mapInPandas(hand, f"{columns}, view int, y int")
        wanted = F.lit(False)
        for k, (c, cut) in enumerate(zip(counts, cuts)):
            share_of = 1.1 * PICKED / max(1, int(c[pick(np.arange(many), *cut) >= 0].sum()))
            wanted = wanted | ((F.col("view") == k) & (F.col("h").cast("double") / 2.0**64 + 0.5 < min(1.0, share_of)))
        some = handed.where(wanted).toPandas().sort_values("h")
        return [some[some["view"] == k].head(PICKED) for k in (0, 1)]

    known = rows.where("y is not null").withColumn("h", F.xxhash64("doc_id", "n_chars", "feats")).drop("doc_id")
    return co_train(known.toPandas().sort_values("h"), text, meta, exchange)


def score(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) per row of ``docs``."""
    rows = save(features(docs, pages, labelled_rows(docs, labels)), "views")
    model = docs.sparkSession.sparkContext.broadcast(train(rows))
    typed = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t, m, s = model.value.score(_numbers(b), _lengths(b), _categories(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_score": t, "meta_score": m, "score": s, "keep": s >= KEEP_FROM})

    scored = rows.drop("y", "held").withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        run, "doc_id string, text_score double, meta_score double, score double, keep boolean"
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast(typed))


def keep_good(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` without the documents that score below ``KEEP_FROM``; an id
    that several rows share goes if none of its rows is good."""
    scored = score(docs, labels, pages)
    bad = scored.groupBy(F.col("doc_id").alias("__id")).agg(F.max("keep").alias("__keep")).where("not __keep").select("__id")
    bad = save(bad, "rejected")
    return docs.join(broadcast_if_bounded(bad), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
