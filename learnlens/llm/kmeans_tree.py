"""Approximate nearest neighbours by a hierarchical k-means tree.

Fit: k-means splits a bounded sample (``SAMPLE_BYTES``) into ``BRANCH`` parts,
and each part again, until a leaf stands for about as many rows as there are
leaves (``LEAF_ROWS`` at least). If the
sample is too small for that many leaves, each leaf's subtree is fitted by a
task from a bounded sample of the leaf's own rows, so the tree grows with the
table up to ``MAX_LEAVES``. The tree is broadcast.

Index: every row goes down to its nearest leaf.

Search: best bin first. A priority queue holds branches by the distance of
their centre; the nearest is opened, its children join the queue, and a leaf
that comes up is visited. How many leaves a query visits is calibrated: for a
bounded set of rows the true neighbours are found by brute force over the whole
table, and visits are widened until ``TARGET`` of them lie in visited leaves. A
query goes on until the visited leaves hold enough rows for k answers.

Work: rows of a leaf and the queries that visit it meet in blocks of bounded
size on both sides (a large leaf is salted). The nearest leaves are searched
first; the others then give only rows that are no farther than the k-th found
there. A window keeps the best k. Of rows with exactly the same vector only the k + 1
smallest ids are candidates: no others can be in any answer, so a hot vector is
a handful of rows.

Distances are Euclidean, in double precision, on the vectors as stored.

Cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers
take no part, nor do null ids and vectors of another length than the most
frequent one; ties go to the smaller id; a row repeated with its id and vector
counts once; ids repeated with different vectors are different candidates, none
of which answers a query of the same id; fewer than k others give what there is.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import save

K = 10
QUERY_EVERY = 100
BRANCH = 16
LEAF_ROWS = 100  # and the square root of the rows, if that is more
FIRST = 3  # leaves whose answers bound the other leaves'
MAX_LEAVES = 65_536
SAMPLE_BYTES = 16 << 20
SAMPLE_PER_LEAF = 8  # sampled rows that a leaf is fitted on at least
CALIBRATION = 200
TARGET = 0.95
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def lloyd(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres; fewer than ``k`` if there are fewer different points."""
    # Farthest-first start: deterministic, and never two equal centres.
    centers = [x[0]]
    gap = ((x - x[0]) ** 2).sum(1)
    while len(centers) < k and gap.max() > 0:
        centers.append(x[int(gap.argmax())])
        gap = np.minimum(gap, ((x - centers[-1]) ** 2).sum(1))
    c = np.array(centers)
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


@dataclass
class Tree:
    """Node i has ``centers[i]`` and ``children[i]``: a node's number, or
    ``-1 - leaf`` for a leaf. Node 0 is the root; without nodes, all is leaf 0."""

    centers: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0

    def grow(self, x: np.ndarray, leaf_size: int) -> int:
        """Add the subtree of ``x`` and return its number."""
        if len(x) > leaf_size:
            c = lloyd(x, min(BRANCH, max(2, math.ceil(len(x) / leaf_size))))
            if len(c) > 1:
                at = len(self.centers)
                self.centers.append(c)
                self.children.append([])
                near = nearest(x, c)
                self.children[at] = [self.grow(x[near == j], leaf_size) for j in range(len(c))]
                return at
        self.leaves += 1
        return -self.leaves

    def graft(self, parts: dict[int, Tree]) -> Tree:
        """The tree with some leaves replaced by trees of their own."""
        out = Tree()

        def copy(tree: Tree, at: int, deep: bool) -> int:
            if at < 0:
                own = parts.get(-1 - at) if deep else None
                if own is not None and own.centers:
                    return copy(own, 0, False)
                out.leaves += 1
                return -out.leaves
            new = len(out.centers)
            out.centers.append(tree.centers[at])
            out.children.append([])
            out.children[new] = [copy(tree, c, deep) for c in tree.children[at]]
            return new

        copy(self, 0 if self.centers else -1, True)
        return out

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centers and len(x) else []
        while todo:
            at, rows = todo.pop()
            near = nearest(x[rows], self.centers[at])
            for j, child in enumerate(self.children[at]):
                own = rows[near == j]
                if len(own) == 0:
                    continue
                if child < 0:
                    out[own] = -1 - child
                else:
                    todo.append((child, own))
        return out

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        if not self.centers:
            yield 0
            return
        queue = [(0.0, 0)]
        while queue:
            _, at = heapq.heappop(queue)
            if at < 0:
                yield -1 - at
                continue
            d = ((self.centers[at] - q) ** 2).sum(1)
            for distance, child in zip(d.tolist(), self.children[at]):
                heapq.heappush(queue, (distance, child))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) if len(v) else np.empty((0, 0))


def _top(q: np.ndarray, q_id: int, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of a block that have another id."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    other = np.flatnonzero(ids != q_id)
    if len(other) > k:
        far = np.partition(d[other], k - 1)[k - 1]
        other = other[d[other] <= far]
    other = other[np.lexsort((ids[other], d[other]))][:k]
    return other, d[other]


def valid(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda e: e != 0)


def prepare(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, h): valid rows once each, vectors as float64 bytes."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.coalesce(valid(F.col("embedding")), F.lit(False))
    )
    sizes = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("embedding") == (sizes.n if sizes else 0))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # + 0.0: the two zeros are one number
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [(np.asarray(e, np.float64) + 0.0).tobytes() for e in b["embedding"]]})

    return save(
        rows.mapInPandas(pack, "vec_id long, v binary").distinct().withColumn("h", F.xxhash64("vec_id", "v")), "vectors"
    )


def fit(rows: DataFrame, n: int, dim: int, sample_bytes: int = SAMPLE_BYTES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The tree for ``n`` rows of ``prepare``."""
    most = max(BRANCH, sample_bytes // (8 * dim))
    share = F.col("h").cast("double") / 2.0**64 + 0.5  # uniform in [0, 1)
    # About `most` rows by hash, and never more than a tenth over.
    some = rows.where(share < min(1.0, most / max(1, n))).select("vec_id", "v").limit(most + most // 10).toPandas()
    some = some.sort_values("vec_id")
    x = _matrix(some["v"])
    tree = Tree()
    wanted = min(MAX_LEAVES, max(1, n // max(leaf_rows, math.isqrt(n))))
    tree.grow(x, max(SAMPLE_PER_LEAF, len(x) // wanted)) if len(x) else None
    if tree.leaves * 2 > wanted or not tree.centers:
        return tree
    # Too few: fit each leaf's subtree where its rows are.
    sent = rows.sparkSession.sparkContext.broadcast(tree)
    placed = save(assign(rows, sent), "top-leaves")
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf
    each = max(1, wanted // tree.leaves)
    per_leaf = F.broadcast(
        rows.sparkSession.createDataFrame([(i, most / c) for i, c in counts.items()], "leaf int, keep double")
    )

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        own, x = Tree(), _matrix(pdf.sort_values("vec_id")["v"])
        own.grow(x, max(SAMPLE_PER_LEAF, len(x) // each))
        packed = [c.tobytes() for c in own.centers]
        return pd.DataFrame([{"leaf": pdf["leaf"].iloc[0], "centers": packed, "children": own.children, "leaves": own.leaves}])

    fitted = (
        placed.join(per_leaf, "leaf").where(share < F.col("keep"))
        .groupBy("leaf").applyInPandas(subtree, "leaf int, centers array<binary>, children array<array<int>>, leaves int")
    )
    parts = {}
    for r in fitted.collect():  # centres only: the tree itself, bounded by MAX_LEAVES
        parts[r.leaf] = Tree([np.frombuffer(c, np.float64).reshape(-1, dim) for c in r.centers], [list(c) for c in r.children], r.leaves)
    return tree.graft(parts)


def assign(rows: DataFrame, tree) -> DataFrame:
    """``rows`` with the leaf each one falls into; ``tree`` is a broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=tree.value.leaf_of(_matrix(b["v"])))

    return rows.mapInPandas(run, "vec_id long, v binary, h long, leaf int")


def calibrate(rows: DataFrame, tree, n: int, k: int, target: float, most: int = CALIBRATION) -> tuple[int, float]:
    """(leaves to visit, recall reached on the calibration rows)."""
    share = F.col("h").cast("double") / 2.0**64 + 0.5
    asked = rows.where(share < min(1.0, 2 * most / max(1, n))).orderBy("h").limit(most).select("vec_id", "v").toPandas()
    if not len(asked):
        return 1, 1.0
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value["vec_id"].to_numpy(), _matrix(sent.value["v"])
        for b in batches:
            x, own, leaf = _matrix(b["v"]), b["vec_id"].to_numpy(), b["leaf"].to_numpy()
            out: dict[str, list] = {"q": [], "score": [], "vec_id": [], "leaf": []}
            for i in range(len(q)):
                at, d = _top(q[i], ids[i], x, own, k)
                out["q"] += [i] * len(at)
                out["score"] += d.tolist()
                out["vec_id"] += own[at].tolist()
                out["leaf"] += leaf[at].tolist()
            yield pd.DataFrame(out)

    best = Window.partitionBy("q").orderBy("score", "vec_id")
    true = rows.mapInPandas(brute, "q int, score double, vec_id long, leaf int")
    true = true.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "leaf").toPandas()
    q = _matrix(asked["v"])
    ranks = []
    for i, group in true.groupby("q"):
        order = {leaf: r for r, leaf in enumerate(tree.value.visit(q[i]), start=1)}
        ranks += [order[x] for x in group["leaf"]]
    if not ranks:
        return 1, 1.0
    # Widen the visits leaf by leaf: each rank is where a true neighbour comes in.
    ranks.sort()
    need = ranks[min(len(ranks), math.ceil(target * len(ranks))) - 1]
    return need, sum(r <= need for r in ranks) / len(ranks)


def search(embeddings: DataFrame, every: int = QUERY_EVERY, k: int = K, target: float = TARGET, **fit_args) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose
    id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = prepare(embeddings)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = rows.select(F.octet_length("v").alias("b")).first().b // 8
    # Copies beyond the k + 1 smallest ids of a vector are in no answer.
    copies = Window.partitionBy("v").orderBy("vec_id")
    different = rows.withColumn("c", F.row_number().over(copies)).where(F.col("c") <= k + 1).drop("c")
    different = save(different, "candidates")
    m = different.count()
    tree = spark.sparkContext.broadcast(fit(different, m, dim, **fit_args))
    placed = save(assign(different, tree), "leaves")
    visits, _ = calibrate(placed, tree, m, k, target)
    counts = {r.leaf: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row per leaf
    held = spark.sparkContext.broadcast(counts)

    def best_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for vec_id, v in zip(b["vec_id"], b["v"]):
                seen = rows_seen = 0
                for leaf in tree.value.visit(np.frombuffer(v, np.float64)):
                    # The first leaves, until they hold k rows, give a bound for the others.
                    first = seen < FIRST or rows_seen <= k
                    seen += 1
                    if leaf in held.value:
                        rows_seen += held.value[leaf]
                        out.append((vec_id, v, leaf, first))
                    if seen >= visits and rows_seen > k:
                        break
            yield pd.DataFrame(out, columns=["vec_id", "v", "leaf", "first"])

    queries = rows.where(F.col("vec_id") % every == 0).repartition("vec_id")
    asked = queries.select("vec_id", "v").mapInPandas(best_bins, "vec_id long, v binary, leaf int, first boolean")
    asked = save(asked, "visits")
    # A query id with several vectors asks once for each of them.
    order = Window.partitionBy("query_id", "v").orderBy("score", "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = ranked(_meet(placed, asked.where("first").withColumn("bound", F.lit(float("inf"))), counts, k))
    first = save(first, "first-leaves")
    bound = first.groupBy(F.col("query_id").alias("vec_id"), "v").agg(
        F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound")
    )
    more = _meet(placed, asked.where("not first").join(bound, ["vec_id", "v"]), counts, k)
    return ranked(first.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")


def _meet(placed: DataFrame, asked: DataFrame, counts: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score, v): the k nearest rows, within the query's
    bound, of every block of every leaf that a query (vec_id, v, leaf, bound) visits."""
    spark = placed.sparkSession
    asked = save(asked, "asked")
    # Blocks of bounded size on both sides of a leaf.
    grid = [
        (r.leaf, math.ceil(counts[r.leaf] / BLOCK_ROWS), math.ceil(r["count"] / BLOCK_QUERIES))
        for r in asked.groupBy("leaf").count().collect()  # one row per leaf
    ]
    grid = F.broadcast(spark.createDataFrame(grid, "leaf int, nr int, nq int"))
    left = placed.join(grid, "leaf").select(
        "leaf", F.expr("pmod(h, nr)").cast("int").alias("rb"), F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), "vec_id", "v"
    )
    right = asked.join(grid, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0, nr - 1)")).alias("rb"), F.expr("pmod(xxhash64(vec_id, v), nq)").cast("int").alias("qb"),
        "vec_id", "v", "bound",
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(a["v"]), a["vec_id"].to_numpy()
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "v": []}
        for q_id, v, most in zip(b["vec_id"], b["v"], b["bound"]) if len(a) else ():
            at, d = _top(np.frombuffer(v, np.float64), q_id, x, ids, k)
            at, d = at[d <= most], d[d <= most]
            out["query_id"] += [q_id] * len(at)
            out["vec_id"] += ids[at].tolist()
            out["score"] += d.tolist()
            out["v"] += [v] * len(at)
        return pd.DataFrame(out)

    keys = ["leaf", "rb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score double, v binary"
    )
