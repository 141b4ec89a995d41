"""The operators' own interfaces: small cases against brute force."""

from __future__ import annotations

import itertools
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnlens.llm import chat_format, common, jaccard_join, kmeans_tree, mixing, quality, resharding, secrets, url_filters
from learnlens.llm import sentencepiece_codec as sp
from learnlens.llm.common import connected_components
from learnlens.session import shared_root


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(200, 201), (201, 200), (202, 202)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {200: 200, 201: 200}
    assert got == expected


# --- URL filters


def test_mined_rules_are_pruned_and_decide(spark):
    rows, labels = [], []
    for i in range(200):
        spam = i % 4 == 0
        rows.append((i, f"https://{'win' if spam else 'news'}.a{i % 10}.com/{'x' if i % 3 else 'y'}/{i}"))
        labels.append((i, 0 if spam else 1, 0))
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = {r.rule: (r.verdict, r.confidence) for r in url_filters.mine(pages, labels).collect()}
    assert rules["sub:win"] == ("block", 1.0) and rules["sub:news"] == ("allow", 1.0)
    # What a shorter rule says as surely is left out.
    assert not [r for r in rules if "sub:win" in r and r != "sub:win"]
    new = spark.createDataFrame([(1, "http://win.other.com/"), (2, "http://news.other.com/"), (3, None), (4, "no url")], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages.unionByName(new.selectExpr("page_id + 1000 as page_id", "url")), labels).collect()}
    assert got[1001] == ("win.other.com", "/", None, "block") and got[1002][3] == "allow"
    assert got[1003] == got[1004] == ("", "", None, "allow")


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("http://example.net/en/?q", "example.net", "/en/", "example.net/en/", "allow"),
        ("http://www.example.com/de/1#f", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("x://y://org/fr/", "y:", "//org/fr/", None, "allow"),
        ("http://é.org/fr/", "é.org", "/fr/", "org/fr/", "allow"),
        ("http://net?x", "net", "", None, "allow"),
        ("\nhttp://net/\n", "net", "/\n", "net/", "block"),
    ],
)
def test_stated_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tuple(url_filters.judge(pages, none).first())[:5] == (1, host, path, rule, verdict)


# --- n-gram Jaccard join


def brute_components(texts: list[str]) -> list[int]:
    sets = [set(jaccard_join.shingles(t).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


def test_join_against_brute_force(spark, monkeypatch):
    """Near copies, a passage in every text, long lists, dense nodes and split groups."""
    monkeypatch.setattr(jaccard_join, "LONG", 5)
    monkeypatch.setattr(jaccard_join, "EXTRA", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(20)]
    base = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = word()
        texts.append(" ".join(words))
    for i in range(60):
        texts.append(" ".join(passage + [word() for _ in range(rng.randrange(2, 40))]))
    texts += ["A b", "a B", "a b c", "", " \n", "same\u00a0word", "x " * 50, "x " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == {i: (len(jaccard_join.shingles(t)), c) for i, (t, c) in enumerate(zip(texts, brute_components(texts)))}


@pytest.mark.parametrize("width,percent", [(5, 80), (2, 50), (4, 85)])
def test_join_at_other_settings(spark, monkeypatch, width, percent):
    """Sets of words in a row and their similarity, both by plain Python."""
    monkeypatch.setattr(jaccard_join, "LONG", 5)
    monkeypatch.setattr(jaccard_join, "EXTRA", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(15):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += ["a b c d", "A b c d", "a b", ""]
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in split]
    comp = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0:
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df, width, percent).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp))}


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in map(str, (files.apply(i) for i in range(files.size()))) if "shuffle_" in f}


def test_stored_tables_leave_no_shuffle_files(spark):
    """They would pile up until the driver collects garbage."""
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffle_files(spark)
    setting = spark.conf.get(key)
    saved = common.save(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(5, "count"), "grouped")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:  # removed in the background
        time.sleep(0.2)
    assert shuffle_files(spark) - before == set()
    assert saved.count() == 100 and spark.conf.get(key) == setting


@pytest.mark.parametrize("rows", [3, 400_000])
def test_join_keeps_the_tables_of_its_result_only(spark, monkeypatch, rows):
    """Also where its tables are too many rows to be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(jaccard_join, "LONG", 3)
    monkeypatch.setattr(jaccard_join, "EXTRA", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for copies in (1, 2, 5, 30):
        base = [word() for _ in range(50)]
        for _ in range(copies):
            words = list(base)
            words[rng.randrange(50)] = word()
            texts += [" ".join(words)] * rng.randrange(1, 3)
    texts += ["", " ".join(word() for _ in range(30))]
    folder = f"{shared_root(spark).removeprefix('file:')}/learnlens"
    tables = lambda: {f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if f.startswith("llm-")}
    before = tables()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()}
    assert got == {i: (len(jaccard_join.shingles(t)), c) for i, (t, c) in enumerate(zip(texts, brute_components(texts)))}
    assert sorted(f.rsplit("-", 1)[0] for f in tables() - before) == ["llm-components", "llm-linked", "llm-rows"]


def test_rows_that_may_be_among_many_keys(spark, monkeypatch):
    """All that are, by masks that are few whatever the number of keys, and hardly any other."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1_000)
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    keys = rows.where("id % 7 = 0")
    met = {r.id for r in common.maybe_among(rows, keys.unionByName(keys), "h").collect()}
    assert {i for i in range(20_000) if i % 7 == 0} <= met and len(met) < 2_858 + 1_500
    assert common.maybe_among(rows, keys, "h").columns == ["id", "h"]
    assert common.maybe_among(rows, keys.where("false"), "h").count() == 0


def test_search_with_two_sides():
    a, b, c = (np.arange(i, i + 40, dtype=np.uint64) for i in (0, 1, 2))
    assert jaccard_join.search([a, b, c], [0, 0, 0]) and len(jaccard_join.search([a, b, c], [0, 0, 0])) == 2
    assert {tuple(sorted(x)) for x in jaccard_join.search([a, b, c], [0, 0, 1])} <= {(0, 2), (1, 2)}
    assert jaccard_join.search([a], [0]) == []


def test_first_of_each_keeps_empty_texts_and_one_of_repeated_rows(spark):
    rows = [(3, "one two three four five", 1), (1, "One two three four five", 2), (1, "One two three four five", 2), (4, None, 3), (5, "", 4), (None, "other words here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h long")
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.h) for r in jaccard_join.first_of_each(df).collect())
    assert kept == sorted([(1, "One two three four five", 2), (4, None, 3), (5, "", 4), (-1, "other words here", 5)], key=lambda r: r[0])


# --- mixing


def test_rows_of_one_id_take_their_own_words(spark):
    from collections import Counter

    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    # Source a stops at three epochs; b's cut falls into the rows of id 7.
    own = [(1, "a", text("x", 10)), (1, "a", text("y", 990)), (None, "a", text("n", 5)), (None, "a", text("m", 50))]
    many = [(7, "b", text(f"k{i}_", 100)) for i in range(40)]
    docs = spark.createDataFrame([(*r, len(r[2])) for r in own + many], "doc_id long, source string, text string, n_chars long")
    rows = mixing.apply_mix(docs, mixing.mix(docs)).collect()
    assert Counter((r.doc_id, r.text) for r in rows if r.source == "a") == {(i, t): 3 for i, _, t in own}
    given = {t for _, _, t in many}
    got = [r.text for r in rows if r.source == "b"]
    assert sum(len(t.split()) for t in got) == 5055 - 3 * 1055 and len(set(got)) == len(got)
    cut = [t for t in got if t not in given]
    assert len(cut) == 1 and any(t.startswith(cut[0] + " ") for t in given)


# --- secrets


def test_ledger_scans_unseen_blobs_and_new_rule_versions_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    v1 = spark.createDataFrame([("a", 1, "token=abcdef1"), ("b", 1, "token=abcdef1"), ("c", 1, None)], "path string, version int, text string")
    assert sorted((r.path, len(r.spans)) for r in secrets.BlobLedger(spark, path).scan(v1).collect()) == [("a", 1), ("b", 1), ("c", 0)]
    ledger = secrets.BlobLedger(spark, path)
    assert ledger.scanned().count() == 2
    v2 = v1.unionByName(spark.createDataFrame([("a", 2, "AKIA" + "A" * 16)], "path string, version int, text string"))
    assert [len(r.spans) for r in ledger.scan(v2).orderBy("path", "version").collect()] == [1, 1, 1, 0]
    assert ledger.scanned().count() == 3
    # A rule with a new version reads all blobs again, and its old findings no longer count.
    changed = tuple(secrets.Rule("assign", r"token=\w+", version="2") if r.kind == "assign" else r for r in secrets.RULES)
    again = secrets.BlobLedger(spark, path, changed)
    out = again.scan(v2).orderBy("path", "version").collect()
    assert [[s.rule for s in r.spans] for r in out] == [["assign@2"], ["access@1"], ["assign@2"], []]
    assert sorted(len(r.rules) for r in again.scanned().collect()) == [1, 1, 1, 6, 6, 6]


def test_failing_matches_use_up_their_characters(spark):
    text = "é password=token:abcdefgh secret: 'abcdef' " + "a" * 23 + " " + "0" * 24 + " AKIAAKIA" + "B" * 12
    out = secrets.BlobLedger(spark).scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = [(s.kind, text[s.start : s.end]) for s in out.spans]
    assert found == [("assign", "secret: 'abcdef"), ("hex", "0" * 24), ("access", "AKIAAKIA" + "B" * 12)]


def test_redaction(spark):
    rows = [(1, "é token = abcdef0123456789abcdef0123456789 end", 99, 7), (2, "clean", 5, 8), (3, None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, blob long")
    out = {r.doc_id: tuple(r) for r in secrets.redact(df).collect()}
    assert out == {1: (1, "é <SECRET> end", 14, 7), 2: rows[1], 3: rows[2]}


# --- chat


def cheapest(roles, c=chat_format.Costs()):
    import heapq

    queue, seen = [(0, 0, "start")], set()
    while queue:
        cost, i, s = heapq.heappop(queue)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(roles) and s in chat_format.FINAL:
            return cost
        for t in chat_format.LEGAL[s]:
            heapq.heappush(queue, (cost + c.insert, i, t))
            if i < len(roles):
                heapq.heappush(queue, (cost + c.relabel * (t != roles[i]), i + 1, t))
        if i < len(roles) and s != "start":
            heapq.heappush(queue, (cost + c.merge + c.relabel * (s != roles[i]), i + 1, s))


def test_repair_is_the_cheapest(spark):
    rng = random.Random(2)
    kinds = ["system", "user", "assistant", "tool", None]
    convs = {c: [rng.choice(kinds) for _ in range(rng.randrange(1, 9))] for c in range(60)}
    convs[99] = [rng.choice(kinds) for _ in range(400)]  # split over partitions
    rows = [(c, t, r, f"t{t}.") for c, roles in convs.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.repair(df, long=100).toPandas()
    known = chat_format.Repair.known
    for c, roles in convs.items():
        g = out[out.conv_id == c].sort_values("position")
        assert g.cost.sum() == cheapest([known(r) for r in roles])
        assert g[g.turn.notna()].turn.astype(int).tolist() == list(range(len(roles)))


@pytest.mark.parametrize("partitions", [3, 8, 13])
def test_ties_do_not_depend_on_the_split(spark, partitions):
    """Costs with many equal repairs: short and long form give the same rows."""
    rng = random.Random(5)
    kinds = ["system", "user", "assistant", "tool", None]
    convs = {str(c): [rng.choice(kinds) for _ in range(rng.randrange(30, 90))] for c in range(48)}
    convs |= {None: [rng.choice(kinds) for _ in range(400)], "null": ["user"] * 60}
    rows = [(c, t // 2, r, f"t{t % 7}.") for c, roles in convs.items() for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for costs in (chat_format.Costs(1, 1, 1), chat_format.Costs(0, 0, 0)):
            short = chat_format.repair(df, costs, long=1_000).toPandas()
            long = chat_format.repair(df, costs, long=20).toPandas()
            assert set(short.conv_id) == set(convs) and len(short) == len(long)
            for c in convs:
                a, b = (x[x.conv_id.isna() if c is None else x.conv_id == c].sort_values("position") for x in (short, long))
                columns = ["turn", "role", "action", "cost", "piece"]
                assert a[columns].fillna("-").to_numpy().tolist() == b[columns].fillna("-").to_numpy().tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_very_long_texts_and_conversations(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", "x" * 100_000 if t < 4 else "y") for t in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    short, long = (chat_format.repair(df, long=n).orderBy("position").select("role", "action", "piece").collect() for n in (10_000, 100))
    assert short == long and sum(len(r.piece) for r in short) > 400_000


# --- SentencePiece


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(sp.load_vocabulary())


def test_viterbi_against_all_substrings(codec):
    vocabulary = {p: s for p, s, kind in sp.load_vocabulary() if kind == "text"}

    def best(part: str) -> float:
        top = [0.0]
        for end in range(1, len(part) + 1):
            ways = [top[a] + vocabulary[part[a:end]] for a in range(max(0, end - 60), end) if part[a:end] in vocabulary]
            ways += [] if part[end - 1] in vocabulary else [top[end - 1] + codec.unknown]
            top.append(max(ways))
        return top[-1]

    def score(ids) -> float:
        raw, total = b"", 0.0
        for i in ids:
            if i in codec.byte_ids.values():
                raw += codec.as_bytes[i]
                if not raw.decode("utf-8", "ignore"):
                    continue
                total, raw = total + codec.unknown, b""
            else:
                total += codec.scores[i]
        return total

    for text in ["Hello world", "straße  und\nÜber", "日本語のテキスト🎉x", "a" * 100, "\t", "naïve   " * 3]:
        part = sp.SPACE + text.replace(" ", sp.SPACE)
        assert score(codec.viterbi(part)) == pytest.approx(best(part))
        assert score(codec.encode(text).tolist()) == pytest.approx(best(part))


def test_round_trip(spark, codec):
    rng = random.Random(4)
    texts = [None, "", " ", "  x", "\n\n", "é" * 200, "a b" * 5000, "🎉\x00\x7f"]
    texts += ["".join(chr(rng.choice([32, 10, 65 + rng.randrange(50), 200, 0x4E2D, 0x1F600])) for _ in range(50)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = sp.encode(df)
    back = {r.doc_id: r.text for r in sp.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.round_trip for r in encoded.collect())
    # The mark of a space is the one character that does not come back.
    assert codec.decode(codec.encode("a\u2581b")) == "a b"


def test_searching_together_gives_the_same_as_alone(codec):
    words = ["▁the", "ing", "▁Straße", "aaaaaaa", "▁▁▁x", "zqxj", "▁" + "ab" * 15]
    codec.cache.clear()
    codec.search_many(words)
    for w in words:
        assert np.frombuffer(codec.cache[w], np.int32).tolist() == codec.viterbi(w)


def test_ids_are_the_librarys(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rng = random.Random(6)
    texts = ["the international", "", " \n\t ", "  a   b ", "x" * 20_000, "ab" * 3000, " " * 100, "naïve  日本語🎉", "\x00a\x7f", "a\u2581b", "<0x41><s>", "\ufeff\u0378"]
    marks = [32, 32, 10, 97, 101, 104, 116, 200, 0x2581, 0x4E2D, 0x1F600]
    texts += ["".join(chr(rng.choice([*marks, 65 + rng.randrange(50), rng.randrange(0x20, 0x500)])) for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in sp.encode(df).collect()} == dict(enumerate(library.encode(texts)))
    assert library.encode("the international", out_type=str) == ["▁the", "▁international"]


def merged(vocabulary: dict[str, tuple[int, float]], part: str) -> list[str]:
    """Plain merges: the best pair, the leftmost of equal ones, until none makes a piece."""
    now = list(part)
    while True:
        pairs = [(vocabulary[a + b][1], -i) for i, (a, b) in enumerate(zip(now, now[1:])) if a in vocabulary and b in vocabulary and a + b in vocabulary]
        if not pairs:
            return now
        i = -max(pairs)[1]
        now[i : i + 2] = [now[i] + now[i + 1]]


def test_one_pass_gives_the_pieces_of_merging():
    """Compatibility of neighbours, part by part and side by side, against merging."""
    codec = sp.MergeCodec(sp.load_vocabulary())
    vocabulary = {p: (i, s) for i, (p, s, kind) in enumerate(sp.load_vocabulary()) if kind == "text"}
    rng = random.Random(8)
    words = ["▁the", "ing", "▁Straße", "aaaaaaa", "▁▁▁▁▁x", "zqxj", "▁" + "ab" * 15, "▁", "\u0378a", "▁international", "▁" * 39]
    words += ["".join(rng.choice("abcdeghilmnorstuv'-é▁日\u0378") for _ in range(rng.randrange(1, 40))) for _ in range(1_500)]
    codec.search_many(list(dict.fromkeys(words)))
    for w in words:
        expected = [i for p in merged(vocabulary, w) for i in ([vocabulary[p][0]] if p in vocabulary else [codec.byte_ids[b] for b in p.encode()])]
        assert codec.viterbi(w) == expected
        assert np.frombuffer(codec.cache[w], np.int32).tolist() == expected


def test_only_one_piece_of_a_position_is_compatible():
    codec = sp.MergeCodec(sp.load_vocabulary())
    for part in ["▁international", "▁undeniably", "aaaaaaaaaa", "▁▁▁▁▁"]:
        for end in range(1, len(part) + 1):
            ways = 0
            for start in range(end):
                piece = next((i for i, p in enumerate(codec.as_bytes) if p.decode("utf-8", "replace").replace(" ", sp.SPACE) == part[start:end] and codec.made[i] < codec.never), None)
                if piece is not None:
                    before = codec.viterbi(part[:start])
                    ways += not before or codec._fits(before[-1], piece)
            assert ways == 1


# --- nearest neighbours


def test_tree_fitted_in_tasks_and_hot_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    x[500:1200] = x[500]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 4), (5002, [1.0, None, 1.0, 1.0]), (5003, [float("nan")] * 4), (5004, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = kmeans_tree.search(df, every=50, sample_bytes=64 * 8 * 4, leaf_rows=10).toPandas()
    hit = total = 0
    assert sorted(set(out.query_id)) == list(range(0, 2000, 50))
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        true = sorted((s, i) for i, s in enumerate(d) if i != q)[:10]
        hit, total = hit + len({i for _, i in true} & set(g.vec_id)), total + 10
        if 500 <= q < 1200:
            assert g.sort_values("rank").vec_id.tolist() == [i for _, i in true]
    assert hit >= 0.9 * total


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kmeans_tree.search(df).collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


# --- resharding


def test_flow_is_of_least_cost():
    rng = random.Random(1)
    for _ in range(30):
        n, m = rng.randrange(1, 4), rng.randrange(1, 4)
        supply = [rng.randrange(4) for _ in range(n)]
        capacity = [0] * m
        for _ in range(sum(supply)):
            capacity[rng.randrange(m)] += 1
        cost = [[rng.randrange(5) for _ in range(m)] for _ in range(n)]
        flow = resharding.min_cost_flow(supply, capacity, cost)
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        slots = [j for j, s in enumerate(capacity) for _ in range(s)]
        best = min(sum(cost[i][j] for i, j in zip(units, p)) for p in itertools.permutations(slots)) if len(slots) < 8 else None
        assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
        if best is not None:
            assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == best


def test_rewrite_of_affected_shards_only(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"text {i}", "extra") for i in range(400)], "doc_id long, text string, bucket string")
    sizes = [r.s for r in docs.groupBy(resharding.hashed_shard(3).alias("o")).agg(F.sum(resharding.row_size()).alias("s")).orderBy("o").collect()]
    # The first shard keeps its size; the second gives a part to a new one.
    capacities = [sizes[0], sizes[1] - 1000, sizes[2], 1000]
    path = str(tmp_path / "out")
    assert resharding.rewrite(docs, path, resharding.hashed_shard(3), 3, 4, capacities) == [1, 3]
    written = spark.read.parquet(path)
    got = {r.shard: r.s for r in written.groupBy("shard").agg(F.sum(resharding.row_size()).alias("s")).collect()}
    assert abs(got[3] - 1000) < 40 and got[1] + got[3] == sizes[1]
    assert set(written.columns) == {"doc_id", "text", "bucket", "key", "shard"}


def test_a_text_that_a_third_of_all_rows_share(spark, monkeypatch):
    """It is spread over buckets by its ids, and shards and slots are those of plain running sums."""
    import hashlib

    monkeypatch.setattr(resharding, "BUCKET_ROWS", 40)
    texts = {i: "same text" if i % 3 == 0 else None if i % 7 == 0 else f"text {i % 900}" for i in range(3_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.select(resharding.hashed_shard(4).alias("old"), resharding.row_key().alias("key"))
    buckets = resharding.with_bucket(rows, "old", 1).groupBy("old", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    assert max(r["n"] for r in buckets) < 160
    for _, own in itertools.groupby(sorted(buckets, key=lambda r: (r.old, r.bucket)), key=lambda r: r.old):
        ends = [(r.a, r.b) for r in own]
        assert all(b < a for (_, b), (a, _) in zip(ends, ends[1:]))
    got = {r.doc_id: r for r in resharding.reshard(docs, 4, 6).collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    key = {i: md5(t or "") + md5(str(i)) for i, t in texts.items()}
    size = {i: len(t or "") + 8 for i, t in texts.items()}
    old = {o: sorted((i for i in key if int(key[i][24:32], 16) % 4 == o), key=key.get) for o in range(4)}
    blocks = resharding._blocks(resharding.flow_plan([sum(size[i] for i in old[o]) for o in range(4)], resharding.even_capacities(sum(size.values()), 6)))
    for o, ids in old.items():
        at = 0
        for i in ids:
            assert got[i].shard == next(j for k, j, start, end in blocks if k == o and start <= at < end)
            at += size[i]
    for j in range(6):
        own = [i for i in got if got[i].shard == j]
        assert sorted(own, key=key.get) == sorted(own, key=lambda i: got[i].slot) and sorted(got[i].slot for i in own) == list(range(len(own)))


def test_rows_without_an_id_get_keys_of_their_texts(spark):
    docs = spark.createDataFrame([(None, f"w {i}", "s") for i in range(400)] + [(None, None, "s")] * 3, "doc_id long, text string, source string")
    plan = mixing.mix(docs)
    assert plan.select("key").distinct().count() == 401
    first = plan.select("key").where(F.col("size") > 0).groupBy(F.substring("key", 1, 1)).count().collect()
    assert len(first) == 16 and max(r["count"] for r in first) < 60


@pytest.mark.parametrize("seed", range(4))
def test_large_groups_against_all_pairs(spark, monkeypatch, seed):
    """Clusters, bridges between them and strays in groups of many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LEADERS", 3)
    rng = random.Random(seed)
    sets = []
    for base in range(rng.randrange(1, 4)):
        core = [f"{base}-{i}" for i in range(40)] + [f"all{i}" for i in range(30)]
        for _ in range(rng.choice([20, 90])):
            own = list(core)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(len(own))] = f"x{rng.random()}" if rng.random() < 0.7 else f"{rng.randrange(3)}-{rng.randrange(40)}"
            sets.append(own)
    hashed = [np.unique(np.array([hash(w) & (2**63 - 1) for w in s], np.uint64)) for s in sets]
    rows = [(i + 1, len(h), bytearray(h.tobytes())) for i, h in enumerate(hashed)]
    frame = spark.createDataFrame(rows, "node long, n long, s binary")
    groups = frame.select("node", F.lit(7).cast("long").alias("component"))
    found = {(r.a, r.b) for r in jaccard_join.links_in_groups(frame, groups, 80).collect()}
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
    true = {(i + 1, j + 1) for i in range(len(hashed)) for j in range(i) if linked(hashed[i], hashed[j])}
    assert all((max(p), min(p)) in true for p in found)

    def first(edges):
        up = {i + 1: i + 1 for i in range(len(hashed))}
        for _ in range(len(hashed)):
            before = dict(up)
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
            if up == before:
                return up

    assert first(found) == first(true)


def test_a_group_of_near_copies_is_sent_once(spark):
    rng = random.Random(1)
    core = rng.sample(range(2**62), 60)
    rows = []
    for i in range(6_000):
        own = [*core[:2], *(v if rng.random() > 0.04 else rng.randrange(2**62) for v in core[2:])] if i else core
        s = np.unique(np.array(own, np.uint64))
        rows.append((i + 1, len(s), bytearray(s.tobytes())))
    frame = spark.createDataFrame(rows, "node long, n long, s binary")
    sized = frame.select(F.lit(1).cast("long").alias("component"), "node", "s", F.lit(6_000).cast("long").alias("count"))
    assert jaccard_join.all_tasks(sized).count() == 36_000
    met = jaccard_join.leader_links(sized, 70)
    plan = met._jdf.queryExecution().executedPlan().toString()
    met = met.collect()
    # Six parts of a thousand nodes, and 16 leaders for each of them.
    assert "MapInPandas" in plan and len({r.a for r in met if r.main}) >= 5_700
    links = jaccard_join.links_in_groups(frame, frame.select("node", F.lit(1).cast("long").alias("component")), 70)
    groups = {r.component for r in connected_components(links).collect()}
    assert groups == {1}


def test_incomplete_components_raise(spark):
    from learnlens.llm.common import connected_components

    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError, match="2 rounds"):
        connected_components(chain, max_rounds=2)
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_spans_of_a_hot_blob_and_of_many_blobs(spark):
    rows = [(i, "token=abcdef0 rest" if i % 3 == 0 else f"text {i} password: secret{i:05d}" if i % 3 == 1 else f"clean {i}", None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert len(out) == 900 and out[0] == ("<SECRET> rest", 13) and out[1] == ("text 1 <SECRET>", 15) and out[2] == ("clean 2", None)


# --- quality


def local_exchange(pool):
    """All rows of a table in memory, sorted instead of counted by steps."""

    def exchange(text, meta, good, share):
        out = []
        for m in quality.margins(pool, text, meta):
            step = quality.steps(m)
            y = np.full(len(pool), -1)
            n, sure = len(pool) * share, np.log(quality.SURE / (1 - quality.SURE))
            for label, key, most in ((1, -step, n * good), (0, step, n * (1 - good))):
                # The surest steps that together hold at most so many rows.
                for k in np.unique(key):
                    # A step's edge away from the middle, against the least margin.
                    edge = -k * quality.STEP - quality.FAR if label else quality.FAR - (k + 1) * quality.STEP
                    if (key <= k).sum() <= most and edge >= sure - quality.STEP / 2:
                        y[key == k] = label
            out.append(pool.assign(y=y)[y >= 0])
        return out

    return exchange


def test_co_training_hands_pseudo_labels_to_the_other_view():
    import pandas as pd

    rng = np.random.default_rng(3)

    def rows(n, labelled):
        y = rng.integers(0, 2, n)
        feats = [list(rng.normal(3 * g, 1, len(quality.TEXT_FEATURES))) for g in y]
        out = pd.DataFrame({"feats": feats, "n_chars": rng.integers(1, 99, n), "lang": "en", "source": [f"s{g if rng.random() < 0.95 else 1 - g}" for g in y], "host": "null"})
        return out.assign(y=y, held=rng.random(n) < 0.3) if labelled else out

    known, pool = rows(200, True), rows(300, False)
    edges = [np.quantile([f[j] for f in pool["feats"]], np.linspace(0, 1, 11)[1:-1]) for j in range(len(quality.TEXT_FEATURES))]
    text, meta = quality.View(len(edges), edges), quality.View(1, [np.array([4.0])], [{"en": 1}, {"s0": 1, "s1": 2}, {"null": 1}])
    model = quality.co_train(known, text, meta, local_exchange(pool))
    assert model.rounds[-1][1] > model.rounds[0][1] > 0
    test = rows(300, True)
    _, _, s = model.score(quality._numbers(test), quality._lengths(test), quality._categories(test))
    assert ((s > 0.5) == test.y.to_numpy()).mean() > 0.95


def test_training_in_tasks_equals_training_in_memory(spark, monkeypatch):
    """The exchange over all rows by Spark, and the same over a table in memory."""
    from learnlens.llm.common import save, table

    sf = "/root/testdata/sf0.01"
    docs, labels, pages = (table(spark, sf, t) for t in ("documents", "labels", "pages"))
    rows = save(quality.features(docs, pages, quality.labelled_rows(docs, labels)), "views")
    model = quality.train(rows)
    local = rows.withColumn("h", F.xxhash64("doc_id", "n_chars", "feats")).toPandas().sort_values("h")
    known, pool = local[local.y.notna()], local[local.y.isna()].drop(columns=["y"])
    text, meta = quality.views_of(rows)
    plain = quality.co_train(known, text, meta, local_exchange(pool))
    assert plain.rounds == model.rounds and plain.rounds[-1][1] > 20
    for a, b in ((plain.text, model.text), (plain.meta, model.meta)):
        assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.scale, b.scale, atol=1e-6)
    assert np.allclose(plain.mix, model.mix, atol=1e-6)


def test_words_lean_and_no_row_judges_itself(spark):
    import pandas as pd

    rows = [(i, "common " + ("vile" if i % 5 == 0 else "fair") + f" only{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    sample = quality.labelled_rows(docs, labels)
    assert {r.doc_id: r.y for r in sample.collect()} == {i: int(i % 5 != 0) for i in range(300)}
    leaning = quality.word_leaning(docs, sample)
    lean = lambda w, f=-1: float(leaning.weights[f + 1, leaning.place[quality.word_buckets(w)]][0])
    assert lean("VILE!") < -3 < 0 < lean("fair") and lean("only7") == lean("unseen") == 0 and abs(lean("common")) < 0.1
    # A part's own documents do not count for it.
    counts = pd.DataFrame([(0, 0, 7, 9), (1, 1, 7, 9)], columns=["fold", "y", "bucket", "n"])
    parts = quality.Leaning.fit(counts, {(f, y): 10 for f in range(quality.FOLDS) for y in (0, 1)}).weights[:, 1]
    assert parts[1] > 0 > parts[2] and abs(parts[0]) < 0.1
    assert quality.Leaning.none().features(None, -1) == [0.0, 0.0, 0.0]


def test_thresholds_take_whole_steps():
    counts = np.zeros(round(2 * quality.FAR / quality.STEP), np.int64)
    counts[[0, 10, 5_000, 5_999]] = 5, 7, 80, 8
    # Of 100 rows: 12 and 88; 5 and 8 of 16 (7 more would be too many); none.
    for good, share, expected in ((0.88, 1.0, [0, 0, 1, 1]), (0.5, 0.16, [0, -1, -1, 1]), (0.5, 0.04, [-1, -1, -1, -1])):
        cut = quality.thresholds(counts, good, share)
        assert quality.pick(np.array([0, 10, 5_000, 5_999]), *cut).tolist() == expected
