"""Decontamination, importance resampling and the divergence audit against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnlens.llm import decontaminate, divergence, importance

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items long, spans string, digest int, n long, chunk string, `a.b` int"
EXTRA = (1, "s", 2, 3, "c", 4)
ITEMS = "item_id long, text string, words string, n int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def benchmark(spark, rows):
    return spark.createDataFrame([(*r, "w", 1) for r in rows], ITEMS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def random_texts(seed, count, vocabulary, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00", "  "]) for _ in range(r.randrange(most))) for _ in range(count)]


AWKWARD = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t.", "en", "a", 4), (None, "null id text here", "en", "a", 17),
    (None, "null id text here", "en", "a", 17), (4, "aé \U0001f389b c" * 20_000, "en", "b", 160_000), (5, "x" * 200_000, "en", "b", 200_000),
    (6, "same words in here again", "en", "a", 24), (6, "same words in here again", "en", "a", 24), (7, "Same WORDS, in here again", "en", None, 24),
]


# --- decontamination ---------------------------------------------------------


def plain_hits(text, items, n):
    own = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - n, 0) + 1 if w else 0):
            run = w[i : i + n]
            for j in range(len(own) - len(run) + 1):
                if own[j : j + len(run)] == run:
                    hit |= set(range(j, j + len(run)))
                    found.add(item if item is None else str(item))
    return len(own), hit, found


@pytest.fixture(scope="module")
def leaky():
    texts = random_texts(1, 60, ["a", "b", "c", "É", "Ab", "9"])
    items = [(i, t) for i, t in enumerate(random_texts(2, 25, ["a", "b", "c", "É", "AB", "9"], 9))]
    items += [(3, "b b c"), (None, "c É"), (None, "9 9 9 c"), (90, None), (91, ""), (92, "..")]
    return texts, items


@pytest.mark.parametrize("block_bytes", [10_000, 40])
def test_hits_against_plain_python(spark, leaky, block_bytes):
    """With a single block of windows, and with the many that a large benchmark needs."""
    texts, items = leaky
    docs = documents(spark, [*AWKWARD, *[(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)]])
    rows = decontaminate.scan(docs, benchmark(spark, items), n=3, block_bytes=block_bytes, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count()
    some = 0
    for r in rows:
        if len(r.text or "") > 10_000:
            continue
        n, hit, found = plain_hits(r.text, items, 3)
        assert (r.n_words, r.n_hit, set(r.items), len(r.items)) == (n, len(hit), found, len(found))
        places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))]
        runs = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i for i in sorted(hit) if i + 1 not in hit]
        assert [tuple(s) for s in r.spans] == [(a, b + 1, places[a][0], places[b][1]) for a, b in zip(runs, ends)]
        some += bool(hit)
    assert some > 30


def test_digest_of_items(spark, leaky):
    texts, items = leaky
    docs = documents(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)])
    for r in decontaminate.digest(decontaminate.scan(docs, benchmark(spark, items), n=3)).collect():
        found = plain_hits(texts[r.doc_id], items, 3)[2]
        ids = [*sorted(x for x in found if x is not None), *[""] * (None in found)]
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and r.n_items == len(ids)
        assert r.contaminated == bool(found)


@pytest.mark.parametrize("block_bytes", [10_000, 40])
def test_spans_and_documents_are_removed(spark, leaky, block_bytes):
    texts, items = leaky
    docs = documents(spark, [*AWKWARD, *[(100 + i, t, "en", "a", len(t)) for i, t in enumerate(texts)]])
    given = benchmark(spark, items)
    spans = decontaminate.clean(docs, given, n=3, mark="#", block_bytes=block_bytes)
    assert spans.schema == docs.schema and spans.count() == docs.count()
    left = {r.doc_id: r for r in spans.collect()}
    for i, t in enumerate(texts):
        hit = plain_hits(t, items, 3)[1]
        kept = [w for k, w in enumerate(words(t)) if k not in hit]
        assert words(left[100 + i].text) == kept
        assert left[100 + i].n_chars == len(left[100 + i].text)
        if not hit:
            assert left[100 + i].text == t
    assert left[1].text is None and left[5].text == "x" * 200_000
    whole = decontaminate.clean(docs, given, how="documents", n=3, block_bytes=block_bytes)
    clean = sorted(100 + i for i, t in enumerate(texts) if not plain_hits(t, items, 3)[1])
    assert sorted(r.doc_id for r in whole.collect() if (r.doc_id or 0) >= 100) == clean
    assert whole.columns == docs.columns
    with pytest.raises(ValueError):
        decontaminate.clean(docs, given, how="rows")


def test_nothing_to_scan_or_to_find(spark):
    docs, items = documents(spark, AWKWARD), benchmark(spark, [(1, "same words in here")])
    assert decontaminate.scan(documents(spark, []), items).collect() == []
    assert decontaminate.clean(documents(spark, []), items).collect() == []
    for none in (benchmark(spark, []), benchmark(spark, [(1, None), (2, "?")])):
        assert {r.n_hit for r in decontaminate.scan(docs, none).collect()} == {0}
    # Equal documents are judged each by itself, in any case of their letters.
    hit = [r.doc_id for r in decontaminate.scan(docs, items).collect() if r.n_hit == 4]
    assert sorted(hit) == [6, 6, 7]
    long = documents(spark, [(1, "w " * 300_000 + "same words in here", "en", "a", 0)])
    assert [r.n_hit for r in decontaminate.scan(long, items).collect()] == [4]


def test_windows_that_share_a_hash_are_verified(monkeypatch):
    """Only the low bits of the hash: a hit is one number by number."""
    whole = decontaminate.WindowSet.hashes
    monkeypatch.setattr(decontaminate.WindowSet, "hashes", staticmethod(lambda c, m: whole(c, m) & np.uint64(63)))
    known = decontaminate.WindowSet([("i", ["a", "b"]), ("j", ["b", "c"]), ("k", ["c", "c"])])
    text = random_texts(5, 1, ["a", "b", "c"], 2_000)[0]
    expected = plain_hits(text, [("i", "a b"), ("j", "b c"), ("k", "c c")], 2)
    n, n_hit, found, _ = next(iter(decontaminate._judge([text.encode()], known)))
    assert (n, n_hit, set(found)) == (expected[0], len(expected[1]), expected[2])


# --- importance resampling ---------------------------------------------------


def test_composed_hashes_are_those_of_the_runs():
    texts = random_texts(3, 40, ["a", "bb", "Éé", "Zebra", "0", "\U0001f389", "x" * 300], 30)
    dictionary = importance.WordDictionary(limit=40)
    for t in texts * 3:
        own = words(t)
        got = importance.buckets_of(dictionary.scan(t.encode()), 3, 10_000).tolist()
        runs = [" ".join(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]
        assert got == [zlib.crc32(x.encode()) % 10_000 for x in runs]


def test_dictionary_learns_restarts_and_never_changes_a_payload():
    r = random.Random(4)
    known = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 9))) for _ in range(6_000)]
    dictionary = importance.WordDictionary(limit=12_000)
    sizes = set()
    for i in range(60):
        text = " ".join(r.choice(known[100 * i :][:2_000] or known) for _ in range(2_000))
        got = dictionary.scan(text.encode())
        assert got.T.tolist() == [[zlib.crc32(w.encode()), len(w.encode())] for w in text.split(" ")]
        assert dictionary.size <= dictionary.limit
        sizes.add(len(dictionary.payload))
    assert max(sizes) > 500 and len(sizes) > 2


def plain_resample(docs, target, n, buckets, percent, min_words):
    def features(t):
        w = words(t)
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, w, f in own:
        weight = sum(gain(b) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(w), len(f), weight, score))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = defaultdict(list)
    for k, r in enumerate(fit[: percent * len(fit) // 100], start=1):
        ranks[r].append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks[r] else None) for r in rows), key=str)


@pytest.mark.parametrize("n,buckets,percent,min_words", [(1, 10_000, 10, 20), (3, 50, 40, 0), (2, 7, 100, 3)])
def test_resampling_against_plain_python(spark, n, buckets, percent, min_words):
    texts = random_texts(6, 120, ["a", "bb", "Éé", "Zebra", "0"])
    rows = [(*r[:2],) for r in AWKWARD if len(r[1] or "") < 1_000] + [(100 + i % 110, t) for i, t in enumerate(texts)]
    target = [None, "", *random_texts(7, 9, ["a", "bb", "yak"])]
    docs = documents(spark, [(*r, "en", "a", 0) for r in rows])
    given = benchmark(spark, list(enumerate(target)))
    got = importance.resample(docs, given, n, buckets, percent, min_words).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_resample(rows, target, n, buckets, percent, min_words)


def test_resampling_of_nothing_and_to_nothing(spark):
    docs, none = documents(spark, AWKWARD), benchmark(spark, [])
    assert importance.resample(documents(spark, []), none).collect() == []
    rows = importance.resample(docs, none, min_words=0, percent=50).collect()
    assert len(rows) == len(AWKWARD) and sorted(r.rank for r in rows if r.rank) == [1, 2, 3, 4, 5]
    assert {r.doc_id: r.n_features for r in rows}[4] == len(words(AWKWARD[5][1]))
    assert {r.rank for r in importance.resample(docs, none, percent=0).collect()} == {None}


def test_rows_of_one_id_and_text_are_ranked_apart(spark):
    docs = documents(spark, [(None, "w " * 30, "en", "a", 60)] * 500 + [(i, "v " * 30, "en", "a", 60) for i in range(500)])
    rows = importance.resample(docs, benchmark(spark, [(1, "w")]), percent=80).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 801))


# --- divergence audit --------------------------------------------------------


def plain_audit(rows, min_docs, top):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    docs, counts, groups = defaultdict(set), Counter(), {(lang, s) for _, lang, s in rows}
    for i, (t, lang, source) in enumerate(rows):
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t):
            docs[lang, lower(term)].add(i)
            counts[lang, source, lower(term)] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), d in docs.items() if g == lang and len(d) >= min_docs]
        sources = [s for g, s in groups if g == lang]
        v, total = len(kept), {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * v)  # noqa: E731, B023
        p = {s: {t: share(counts[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("min_docs,part_bytes,small", [(1, 8_000_000, 10**9), (4, 200, 10**9), (9, 1, 10**9), (9, 200, 0)])
def test_audit_against_plain_python(spark, monkeypatch, min_docs, part_bytes, small):
    """Terms in several chunks ("The", "the,") that only distinct documents decide among
    them; in parts of any size, and without any broadcast."""
    monkeypatch.setattr(divergence, "COUNT_BYTES", part_bytes)
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", small)
    vocabulary = ["the", "The", "the,", "a.b", "b-A", "É", "é", "x1y", "1", "...", "\U0001f389", "w w", "rare", "Rare!"]
    texts = random_texts(8, 150, vocabulary, 12)
    r = random.Random(9)
    rows = [(t, r.choice(["en", "de", "", None]), r.choice(["a", "b", "é", "", None])) for t in texts]
    rows += [(t, lang, s) for _, t, lang, s, _ in AWKWARD if len(t or "") < 1_000] + [(None, "xx", "only"), ("", "xx", "z")]
    docs = documents(spark, [(i % 50, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)])
    got = sorted(tuple(x) for x in divergence.audit(docs, min_docs, top=5).collect())
    assert got == plain_audit(rows, min_docs, 5)


def test_audit_of_nothing_and_of_a_long_text(spark):
    assert divergence.audit(documents(spark, [])).collect() == []
    long = "x" * 200_000 + " word" * 200_000
    docs = documents(spark, [(1, long, "en", "a", 0), (2, "word other", "en", "b", 0)])
    rows = [(r.part, r.item, r.value) for r in divergence.audit(docs, min_docs=2).where("source = 'b'").collect()]
    # A single kept term has the whole of both shares.
    assert rows == [("pair", "a", 0)]
    docs = documents(spark, [(1, "x" * 200_000, "en", "a", 0), (2, "word", "en", "b", 0)])
    terms = divergence.audit(docs, min_docs=1).where("part = 'term'").select("source", F.length("item")).collect()
    assert sorted(map(tuple, terms)) == [("a", 200_000), ("b", 4)]


def test_terms_decided_by_bounds_and_by_documents(spark):
    """"The" and "the" lie in the same 3 documents: 6 by the sum of chunks, 3 distinct."""
    rows = [("The the " + "often", "en", "a")] * 3 + [("often", "en", "b")] * 3
    docs = documents(spark, [(i, *x, 0) for i, x in enumerate(rows)])
    by_lang = divergence.chunk_docs(docs)
    terms = divergence.chunk_terms(by_lang.select("chunk").distinct())
    joined = divergence.chunk_term_docs(by_lang, terms)
    bounds = divergence.term_bounds(joined, 4)
    assert sorted(map(tuple, bounds.collect())) == [("en", "often", False), ("en", "the", True)]
    dictionary = joined.join(bounds, ["lang", "term"])
    sums = divergence.chunk_sums(docs, divergence.source_numbers(docs), dictionary.select("lang", "chunk", "term", "k", "open"))
    assert sums.where("row is not null").groupBy("term").count().collect() == [("the", 3)]
    counts = {(r["at"], r.term): r.n for r in sums.where("row is null").collect()}
    assert counts == {(0, "the"): 6, (0, "often"): 3, (1, "often"): 3}


def test_distinct_numbers_are_sorted_not_hashed():
    import time

    import numpy as np

    assert divergence._distinct(np.array([], np.int64)).tolist() == []
    assert divergence._distinct(np.array([7, -1, 7, 3, -1], np.int64)).tolist() == [-1, 3, 7]
    keys = np.random.default_rng(1).permutation(2_000_000).astype(np.int64) * 1_000_003

    def least(of):
        took = []
        for _ in range(3):
            some = keys.copy()
            began = time.perf_counter()
            of(some)
            took.append(time.perf_counter() - began)
        return min(took)

    assert least(divergence._distinct) < 6 * least(np.sort)  # hashing them took some 25 times a sort
