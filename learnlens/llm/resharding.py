"""Resharding by minimum-cost flow: the fewest bytes move to new shards.

Input is a sharded data set: rows with an old shard. ``flow_plan`` solves the
transfer problem between the old shards' sizes and the new shards' capacities
(a byte that stays costs 0, a byte that moves costs 1 or what ``cost`` says) by
successive shortest paths; the graph has one node per shard, so its size is a
parameter and not the data's. The flow out of an old shard to each new shard is
a *block* of that shard.

``reshard`` turns blocks into rows without moving any row through one place:
within an old shard the rows are in the order of a key (the MD5 of the text, then of
the id, so equal texts lie side by side), a block is an interval of the running
byte count, and an interval's ends become *key* limits. They are found by a
distributed prefix sum: bucket totals by leading key digits first, then a
running sum inside the one bucket that each limit falls into. After that a
row's new shard is a comparison of its key with a few literals, evaluated in
the scan, and ``rewrite`` writes the affected shards in that one pass.

Law: ``bytes``. A block's end falls on a row's end, so a shard differs from
its capacity by less than one row for each of the blocks it gets. Equal texts
share an old shard (it is dealt by the text's MD5) and lie side by side, so a
group of copies is split only where a block ends inside it, and a hot group
larger than a shard can be held; its rows are summed up in buckets by the ids' hashes.

Cases: a null text counts as the empty text (size 8, CRC 0); equal ids with
equal texts are ordered arbitrarily, which no column shows but ``slot``; an
empty table gives no rows; other columns are rewritten as they are and may
have any name that does not begin with ``__rs_``.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import broadcast_if_bounded, save, text_of
from learnlens.session import scratch_path

OLD_SHARDS = 16
NEW_SHARDS = 24
ROW_BYTES = 8
# Rows that one key bucket of one shard should hold at most, about.
BUCKET_ROWS = 4_000


def row_size() -> Column:
    """UTF-8 bytes of the text and a fixed part for the row."""
    return (F.octet_length(text_of()) + ROW_BYTES).cast("long")


def row_key() -> Column:
    return F.concat(F.md5(text_of()), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def hashed_shard(n: int) -> Column:
    """A row's place in the old layout: the text's MD5 modulo ``n``."""
    return (F.conv(F.substring(F.md5(text_of()), 25, 8), 16, 10).cast("long") % n).cast("int")


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each source to each sink at the least total cost.

    Successive shortest paths with potentials (Dijkstra), integer units. The
    sums of ``supply`` and ``capacity`` must be equal.
    """
    if sum(supply) != sum(capacity):
        raise ValueError("supply and capacity must have the same sum")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    potential = [0] * (n + m)
    while any(left):
        dist: list[float] = [math.inf] * (n + m)
        came = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heapq.heappush(heap, (0, i))
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                edges = ((n + j, cost[u][j]) for j in range(m))
            else:
                edges = ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                nd = d + c + potential[u] - potential[v]
                if nd < dist[v]:
                    dist[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        end = min((n + j for j in range(m) if room[j]), key=lambda v: (dist[v] + potential[v], v))
        far = max(d for d in dist if d < math.inf)
        potential = [p + min(d, far) for p, d in zip(potential, dist)]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        units = min([left[path[0]], room[end - n], *(flow[v][u - n] for u, v in steps if u >= n)])
        for u, v in steps:
            if u < n:
                flow[u][v - n] += units
            else:
                flow[v][u - n] -= units
        left[path[0]] -= units
        room[end - n] -= units
    return flow


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def flow_plan(old: list[int], new: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Bytes from every old shard to every new one, moving the fewest bytes
    (or at the least cost, if the shards' distances differ)."""
    if cost is None:
        cost = [[int(i != j) for j in range(len(new))] for i in range(len(old))]
    return min_cost_flow(old, new, cost)


def _blocks(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old, new, start, end) byte intervals; what stays comes first."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, j, at, at + row[j]))
                at += row[j]
    return out


def _limits(rows: DataFrame, blocks: list[tuple[int, int, int, int]], digits: int) -> dict[tuple[int, int], str | None]:
    """For each block the key below which its rows lie (None: no limit above).

    ``rows``: (old, key, size, bucket). One row per block is collected.
    """
    spark = rows.sparkSession
    ends = [(i, j, end) for k, (i, j, _, end) in enumerate(blocks) if k + 1 < len(blocks) and blocks[k + 1][0] == i]
    if not ends:
        return {}
    cuts = F.broadcast(spark.createDataFrame(ends, "old int, new int, cut long"))  # at most one row per block
    along = Window.partitionBy("old").orderBy("bucket")
    totals = rows.groupBy("old", "bucket").agg(F.sum("size").alias("bytes"))
    totals = totals.withColumn("upto", F.sum("bytes").over(along)).withColumn("from", F.col("upto") - F.col("bytes"))
    hit = totals.join(cuts, "old").where("cut >= from and cut < upto").select("old", "bucket", "new", "cut", "from")
    inside = Window.partitionBy("old", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.join(F.broadcast(hit.select("old", "bucket").distinct()), ["old", "bucket"], "left_semi")
    near = near.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    # The first row that begins at or after the cut belongs to the next block.
    found = (
        near.join(F.broadcast(hit), ["old", "bucket"])
        .where("from + start >= cut")
        .groupBy("old", "new")
        .agg(F.min("key").alias("key"))
    )
    got = {(r.old, r.new): r.key for r in found.collect()}
    # No such row in its bucket: the next block begins with the next bucket.
    nexts = totals.withColumn("next", F.lead("bucket").over(along)).select("old", "bucket", "next")
    later = hit.join(nexts, ["old", "bucket"]).select("old", "new", "next").collect()
    got.update({(r.old, r.new): r.next for r in later if (r.old, r.new) not in got})
    return {(i, j): got.get((i, j)) for i, j, _ in ends}


def shard_column(
    blocks: list[tuple[int, int, int, int]], limits: dict[tuple[int, int], str | None], old: Column, key: Column
) -> Column:
    """The new shard of a row as comparisons with the blocks' key limits."""
    out = None
    for i in sorted({b[0] for b in blocks}):
        own = None
        for _, j, _, _ in (b for b in blocks if b[0] == i):
            limit = limits.get((i, j))
            if limit is None:
                own = F.lit(j) if own is None else own.otherwise(F.lit(j))
                break
            own = F.when(key < limit, F.lit(j)) if own is None else own.when(key < limit, F.lit(j))
        out = F.when(old == i, own) if out is None else out.when(old == i, own)
    return (out if out is not None else F.lit(None)).cast("int")


def with_bucket(rows: DataFrame, group: str, digits: int) -> DataFrame:
    """``rows`` (``group``, key, ...) with a bucket: parts of a group's rows in the order of the key.

    A bucket is named by the leading digits of the key. A text that more than
    ``BUCKET_ROWS`` rows of the group share would be in one of these whatever their number, so it has
    buckets of its own, named by digits of the ids' hashes too, and what follows it in
    its bucket is a bucket after them (``g`` comes after every digit)."""
    text = F.substring("key", 1, 32)
    hot = rows.groupBy(F.col(group).alias("__g"), text.alias("__t")).agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_ROWS)
    hot = save(hot, "hot")
    most = hot.agg(F.max("n")).first()[0]
    plain = F.substring("key", 1, digits)
    if most is None:
        return rows.withColumn("bucket", plain)
    more = 32 + max(1, math.ceil(math.log(most / BUCKET_ROWS, 16)))
    # A bucket has a few such texts at most, being of about as many rows itself.
    hot = hot.groupBy("__g", F.substring("__t", 1, digits).alias("__p")).agg(F.collect_list("__t").alias("__hot"))
    near = broadcast_if_bounded(save(hot, "hot-buckets"))
    joined = rows.join(near, (F.col(group) == F.col("__g")) & (plain == F.col("__p")), "left")
    before = F.array_max(F.filter("__hot", lambda h: h < text))
    bucket = (
        F.when(F.col("__hot").isNull(), plain)
        .when(F.array_contains("__hot", text), F.substring("key", 1, more))
        .otherwise(F.coalesce(F.concat(before, F.lit("g")), plain))
    )
    return joined.withColumn("bucket", bucket).drop("__g", "__p", "__hot")


def plan(docs: DataFrame, old: Column, n_old: int, n_new: int, capacities: list[int] | None = None):
    """(shard column over (__rs_old, __rs_key), blocks) for ``docs``."""
    rows = docs.select(old.alias("old"), row_key().alias("key"), row_size().alias("size"))
    rows = save(rows, "reshard")
    sizes = {r.old: (r.bytes, r.n) for r in rows.groupBy("old").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    have = [sizes.get(i, (0, 0))[0] for i in range(n_old)]
    digits = max(1, math.ceil(math.log(max([1, *(n for _, n in sizes.values())]) / BUCKET_ROWS, 16)))
    rows = with_bucket(rows, "old", digits)
    blocks = _blocks(flow_plan(have, capacities or even_capacities(sum(have), n_new)))
    limits = _limits(rows, blocks, digits)
    return shard_column(blocks, limits, F.col("__rs_old"), F.col("__rs_key")), blocks


def affected(blocks: list[tuple[int, int, int, int]], n_new: int) -> list[int]:
    """New shards whose files change: those that give or get bytes."""
    moved = [(i, j) for i, j, _, _ in blocks if i != j]
    return sorted({j for _, j in moved} | {i for i, _ in moved if i < n_new})


def rewrite(
    docs: DataFrame, path: str, old: Column, n_old: int, n_new: int, capacities: list[int] | None = None,
    everything: bool = False,
) -> list[int]:
    """Write the affected shards (or all of them) under ``path/shard=N`` in one
    pass over ``docs``; returns the shards written. The shards that are not
    affected hold the same rows as before, so their old files can stay."""
    shard, blocks = plan(docs, old, n_old, n_new, capacities)
    out = docs.withColumn("__rs_old", old).withColumn("__rs_key", row_key()).withColumn("shard", shard)
    which = list(range(n_new)) if everything else affected(blocks, n_new)
    if not everything:
        out = out.where(F.col("shard").isin(which))
    out.drop("__rs_old").withColumnRenamed("__rs_key", "key").write.partitionBy("shard").parquet(path)
    return which


def with_slots(files: DataFrame, digits: int) -> DataFrame:
    """The row's place in its shard (from 0, without gaps) in key order: rows
    per key bucket summed up along the shard, then a place inside the bucket."""
    files = with_bucket(files, "shard", digits)
    along = Window.partitionBy("shard").orderBy("bucket")
    counts = files.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select(
        F.col("shard").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(along) - F.col("n")).alias("from")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "doc_id")
    local = files.withColumn("at", F.row_number().over(inside) - 1)
    return local.join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn(
        "slot", (F.col("from") + F.col("at")).cast("long")
    )


def reshard(docs: DataFrame, n_old: int = OLD_SHARDS, n_new: int = NEW_SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), read back
    from the rewritten files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    docs = docs.select("doc_id", "text")
    if docs.isEmpty():
        return spark.createDataFrame(
            [], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
        )
    rewrite(docs, path, hashed_shard(n_old), n_old, n_new, everything=True)
    schema = "doc_id long, text string, key string, shard int"
    rows = save(
        spark.read.schema(schema).parquet(path).select(
            "doc_id", "key", "shard", row_size().alias("size"), F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32")
        ),
        "slots",
    )
    digits = max(1, math.ceil(math.log(rows.count() / n_new / BUCKET_ROWS, 16)))
    return with_slots(rows, digits).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
