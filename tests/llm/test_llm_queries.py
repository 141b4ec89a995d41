"""Each registered query over the whole test tables: against its SQL, or
against a plain version of the same contract."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import compare, duck

from pyspark.sql import functions as F

from learnlens.llm import chat_format, quality, queries, resharding, sentencepiece_codec

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    c = duck(SF)
    yield c
    c.close()


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, coalesce(text, '') AS text FROM documents ORDER BY doc_id").fetchall()


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    result = compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])
    assert result["ok"], result


def as_long(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def chained(values, kind: str) -> int:
    """The hash function of the DataFrame API: each value's hash seeds the next."""
    h = 42
    for v in values:
        raw = v.encode() if kind == "text" else int(v).to_bytes(8 if kind == "long" else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h


def order_minhash(text: str) -> dict[int, int]:
    words = [as_long(chained([w], "text")) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    grams = [words[i : i + 3] for i in range(max(len(words) - 2, min(len(words), 1)))]
    seen, bins = Counter(), {}
    for i, g in enumerate(grams):
        gram = as_long(chained(g, "long")) >> 24
        h = xxhash.xxh64_intdigest(seen[gram].to_bytes(4, "little"), seed=chained([gram], "long"))
        seen[gram] += 1
        bins.setdefault(as_long(h) >> 59, []).append((as_long(h) >> 24, i))
    out = {}
    for b, own in bins.items():
        least = sorted(own)[:2]
        out[b + 16] = chained([h for h, _ in sorted(least, key=lambda e: e[1])], "long") & 0xFFFFFFFF
    return out


def shown(fp: dict[int, int]) -> str:
    return "".join(f"{b:02x}{v:08x}" for b, v in sorted(fp.items()))


def alike(a: dict[int, int], b: dict[int, int]) -> float:
    return sum(a.get(k) == v for k, v in b.items()) / len(a.keys() | b.keys()) if a or b else 1.0


def test_order_minhash_query(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_order_minhash"](spark, SF).collect()}
    down = docs[::-1]
    assert len(rows) == len(docs)
    for (i, text), (_, after) in zip(down, down[1:] + down[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = order_minhash(text), order_minhash(edited), order_minhash(after)
        expected = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), alike(a, b), alike(a, c))
        assert tuple(rows[i])[1:] == expected


def test_quality_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality"](spark, sf).toPandas()
    ids = {i for (i,) in duck(sf).execute("SELECT doc_id FROM documents").fetchall()}
    assert set(rows.doc_id) == ids and len(rows) == len(ids)
    for c in ("score", "text_score", "meta_score"):
        assert rows[c].between(0, 1).all()
    assert (rows.keep == (rows.score >= quality.KEEP_FROM)).all()


def test_quality_of_held_out_labels(spark):
    """Trained on half of the labels, held against the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    scored = quality.score(docs, labels.where(half == 0), pages).select("doc_id", "keep")
    held = scored.join(labels.where(half == 1), "doc_id").toPandas()
    good, toxic, poor = (held[m].keep.mean() for m in ((held.quality == 1) & (held.toxic == 0), held.toxic == 1, (held.quality == 0) & (held.toxic == 0)))
    assert len(held) > 1_500 and good >= 0.985 and toxic <= 0.12 and poor <= 0.12


def test_chat_query(spark, con):
    rows = queries.QUERIES["op6_chat_format"](spark, SF).toPandas()
    given = con.execute("SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn").fetchall()
    assert sorted((int(c), int(t)) for c, t in rows[rows.turn.notna()][["conv_id", "turn"]].to_numpy()) == [(c, t) for c, t, _ in given]
    for conv, g in rows.sort_values("position").groupby("conv_id"):
        text = "".join(g.piece)
        roles = re.findall(r"<\|(system|user|assistant)\|>\n", text)
        state = "start"
        for r in roles:
            assert r in chat_format.LEGAL[state]
            state = r
        assert state in chat_format.FINAL and text.count("<|end|>\n") == len(roles)
        at = 0
        for c, _, t in given:
            if c == conv:
                at = text.index(t or "", at)


def test_sentencepiece_query(spark, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op7_sentencepiece"](spark, SF).collect()}
    codec = sentencepiece_codec.Codec(sentencepiece_codec.load_vocabulary())
    assert rows.keys() == {i for i, _ in docs}
    for i, text in docs:
        assert rows[i].round_trip and rows[i].n_pieces == len(rows[i].ids) and codec.decode(rows[i].ids) == text


def test_sentencepiece_query_gives_the_librarys_ids(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = {r.doc_id: r.ids for r in queries.QUERIES["op7_sentencepiece"](spark, SF).collect()}
    assert rows == {i: library.encode(text) for i, text in docs}


def test_nearest_neighbours_query(spark, con):
    rows = queries.QUERIES["op9_nearest_neighbours"](spark, "/root/testdata/sf0.01").toPandas()
    data = duck("/root/testdata/sf0.01").execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data], float)
    hit = total = 0
    assert sorted(set(rows.query_id)) == [i for i in ids if i % 100 == 0]
    for q, g in rows.sort_values("rank").groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g.vec_id)
        assert g.score.tolist() == [d[ids == v][0] for v in g.vec_id]
        assert list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))
        true = [v for _, v in sorted((s, v) for s, v in zip(d, ids) if v != q)[:10]]
        hit, total = hit + len(set(true) & set(g.vec_id)), total + 10
    assert hit >= 0.9 * total


def test_resharding_query(spark, docs):
    rows = queries.QUERIES["op10_resharding"](spark, SF).toPandas()
    texts = dict(docs)
    assert sorted(rows.doc_id) == sorted(texts)
    for r in rows.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "bytes")
    assert rows.grown_shard.isna().all()
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    # Every row's shard and slot from plain running sums over the old shards.
    key = {i: hashlib.md5(t.encode()).hexdigest() + hashlib.md5(str(i).encode()).hexdigest() for i, t in texts.items()}
    size = {i: len(t.encode()) + 8 for i, t in texts.items()}
    old = {}
    for i in sorted(key, key=key.get):
        old.setdefault(int(key[i][24:32], 16) % 16, []).append(i)
    have = [sum(size[i] for i in old.get(o, [])) for o in range(16)]
    blocks = resharding._blocks(resharding.flow_plan(have, resharding.even_capacities(sum(have), 24)))
    expected = {}
    for o, ids in old.items():
        at = 0
        for i in ids:
            expected[i] = next(j for k, j, start, end in blocks if k == o and start <= at < end)
            at += size[i]
    assert dict(zip(rows.doc_id, rows.shard)) == expected
    for j, g in rows.groupby("shard"):
        assert [i for _, i in sorted(zip(g.slot, g.doc_id))] == sorted((i for i in expected if expected[i] == j), key=key.get)
    even = rows["size"].sum() / 24
    sums = rows.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert (sums - even).abs().max() <= 2 * rows["size"].max()


def test_mix_keeps_to_its_targets(spark):
    rows = queries.QUERIES["op8_mixing"](spark, "/root/testdata/sf0.01").toPandas()
    source = dict(duck("/root/testdata/sf0.01").execute("SELECT doc_id, source FROM documents").fetchall())
    by = rows.assign(source=rows.doc_id.map(source)).groupby("source")
    assert (by.taken.sum() - by.target.first()).abs().max() < 1
    assert (rows.taken <= 3 * rows["size"]).all()
    assert abs(by.target.first().sum() - rows["size"].sum()) < 1e-6 * rows["size"].sum()
