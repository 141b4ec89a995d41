"""Chat formatting with a minimum-cost repair of the roles.

A legal conversation is a word of a small automaton: an optional system turn,
then user and assistant in turn, ending with the assistant. Each given turn
may be

- appended as it is (cost 0) or under another role (``relabel``),
- merged into the turn before it if that has its (new) role (``merge``),

and empty turns may be inserted before it or at the end where the automaton
asks for them (``insert`` each). Dynamic programming over the automaton's states finds
the cheapest repair; among equal ones the first in the order of ``ACTIONS``, the
earlier state first, wins.

Conversations of up to ``LONG`` turns are dealt out by id and repaired one by
one. Longer ones are split: a turn is a matrix over the states in the (min, +)
algebra and a conversation is the product of its turns, which is associative.
Their rows are range-partitioned by (conversation, turn); each partition multiplies
its turns to one matrix per conversation, and the matrices of a conversation (a few
per partition) give the least costs at every border. From these a partition
finds, for each state in which the conversation may leave it, the state in which the path
found by a whole search enters it; these maps, followed from the end, fix the states
at the borders, and each partition traces its own turns between them. Nothing
gathers a long conversation, and the repair does not depend on where the borders
lie (with costs whose sums are exact, as whole numbers are).

Rendering gives one row per given turn and per inserted turn, in order: the
piece of text that it adds. The pieces of a conversation, one after another,
are the rendered text: ``<|role|>\\n`` opens a turn, ``\\n`` joins merged texts,
and ``<|end|>\\n`` closes a turn.

Cases: a role is compared in lower case without white space around it; a null
or unknown role must be relabelled, at the usual cost; a null text is empty;
turns are ordered by turn (null first), role and the text's hash, so repeated
rows follow one another; a null conversation id is a conversation of its own; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnlens.llm.common import broadcast_if_bounded, save

ROLES = ("system", "user", "assistant")
# States: nothing yet, or the role of the last turn.
STATES = ("start", *ROLES)
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)
ACTIONS = ("append", "relabel", "merge", "relabel+merge")
INF = float("inf")
LONG = 10_000
GAP = 2 * (len(STATES) + 1)  # positions between two given turns
ORDER = ("conv", "at", "role", "h", "text")


@dataclass(frozen=True)
class Costs:
    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead from one state to another (none to itself)."""
    out = {}
    for s in range(len(STATES)):
        out[s, s] = ()
        queue = [s]
        for at in queue:
            for role in LEGAL[STATES[at]]:
                nxt = STATES.index(role)
                if (s, nxt) not in out:
                    out[s, nxt] = (*out[s, at], nxt)
                    queue.append(nxt)
    return out


PATHS = _paths()


class Repair:
    def __init__(self, costs: Costs = Costs()):
        n = len(STATES)
        self.costs = costs
        # For each given role (or None): the cheapest way from state to state,
        # as (cost, action, inserted states).
        self.ways = {}
        self.matrix = {}
        for role in (*ROLES, None):
            ways: dict[tuple[int, int], tuple] = {}
            for s in range(n):
                for t, new in enumerate(STATES[1:], start=1):
                    relabel = 0 if new == role else costs.relabel
                    options = []
                    if s == t:
                        options.append((relabel + costs.merge, "merge" if new == role else "relabel+merge", ()))
                    for before in range(n):
                        if new in LEGAL[STATES[before]] and (s, before) in PATHS:
                            empty = PATHS[s, before]
                            cost = relabel + costs.insert * len(empty)
                            options.append((cost, "append" if new == role else "relabel", empty))
                    if options:
                        ways[s, t] = min(options, key=lambda o: (o[0], ACTIONS.index(o[1]), o[2]))
            self.ways[role] = ways
            m = np.full((n, n), INF)
            for (s, t), (cost, _, _) in ways.items():
                m[s, t] = cost
            self.matrix[role] = m
        self.end = np.array([min((costs.insert * len(PATHS[s, STATES.index(f)]) for f in FINAL if (s, STATES.index(f)) in PATHS), default=INF) for s in range(n)])

    @staticmethod
    def known(role) -> str | None:
        role = role.strip().lower() if isinstance(role, str) else None
        return role if role in ROLES else None

    def product(self, roles: list[str | None]) -> np.ndarray:
        out = np.where(np.eye(len(STATES), dtype=bool), 0.0, INF)
        for r in roles:
            out = (out[:, :, None] + self.matrix[r][None, :, :]).min(1)
        return out

    def first_costs(self) -> list[float]:
        """Before the first turn only the start has a cost, of 0."""
        return [0.0 if i == 0 else INF for i in range(len(STATES))]

    def forward(self, role: str | None, best: list[float]) -> tuple[list[float], list[int]]:
        """Least costs after a turn, and the state before it for each; the smallest of equal ones."""
        n = len(STATES)
        new, came = [INF] * n, [-1] * n
        for (s, t), (cost, _, _) in self.ways[role].items():
            if best[s] + cost < new[t]:
                new[t], came[t] = best[s] + cost, s
        return new, came

    def trace(self, roles: list[str | None], best: list[float], end: int | None) -> tuple[list[tuple[int, str, tuple[int, ...]]], int, int]:
        """([(state, action, inserted before)] per turn, first state, last state) on the best
        way from the costs ``best`` before the turns to ``end``, or to the best end of all."""
        steps = []
        for r in roles:
            best, came = self.forward(r, best)
            steps.append(came)
        at = last = end if end is not None else self.best_end(best)
        out = []
        for r, came in zip(reversed(roles), reversed(steps)):
            s = came[at]
            _, action, empty = self.ways[r][s, at]
            out.append((at, action, empty))
            at = s
        return out[::-1], at, last

    def best_end(self, best) -> int:
        return int(np.argmin(np.array(best) + self.end))

    def closing(self, state: int) -> tuple[int, ...]:
        """Empty turns that end a conversation."""
        ends = [PATHS[state, STATES.index(f)] for f in FINAL if (state, STATES.index(f)) in PATHS]
        return min(ends, key=lambda p: (len(p), p))


def _spans(b: pd.DataFrame) -> list[tuple[int, int]]:
    """(first, end) row numbers of each run of equal (conv, part)."""
    conv, part = b["conv"].to_numpy(), b["part"].to_numpy()
    cuts = np.flatnonzero((conv[1:] != conv[:-1]) | (part[1:] != part[:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]))


def _rows(conversations: DataFrame) -> DataFrame:
    """Ids and turns also as text, which carries nulls and large numbers."""
    return conversations.select(
        # No id is the key of a missing one.
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("conv"), F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").alias("at"), F.col("turn").cast("string").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("h", F.xxhash64("text"))


def _render(rows: DataFrame, machine) -> DataFrame:
    """Pieces for sorted rows. Rows of a split conversation have the costs before their part, the
    state after it and whether the conversation ends there (``best``, ``leave``, ``closes``); else null."""

    def finish(r: Repair, g: pd.DataFrame) -> list[tuple]:
        c, out = r.costs, []
        conv_id, best, leave, closes = (g[x].iloc[0] for x in ("conv_id", "best", "leave", "closes"))
        split = best is not None
        path, enter, state = r.trace(
            [r.known(x) for x in g["role"]], list(best) if split else r.first_costs(), int(leave) if split else None
        )
        before, position = enter, 0
        for i, ((at, action, empty), turn, seq, text) in enumerate(zip(path, g["turn"], g["seq"], g["text"])):
            position = GAP * (i if seq < 0 else int(seq))
            merged = action.endswith("merge")
            close = "<|end|>\n" if before and not merged else ""
            for k, e in enumerate(empty):
                out.append((conv_id, None, position + k, STATES[e], "insert", c.insert, f"{close}<|{STATES[e]}|>\n"))
                close = "<|end|>\n"
            piece = f"\n{text}" if merged else f"{close}<|{STATES[at]}|>\n{text}"
            cost = (c.relabel if "relabel" in action else 0.0) + (c.merge if merged else 0.0)
            out.append((conv_id, turn, position + len(STATES), STATES[at], action, cost, piece))
            before = at
        if closes or not split:
            for k, e in enumerate(r.closing(state)):
                out.append((conv_id, None, position + len(STATES) + 1 + k, STATES[e], "insert", c.insert, f"<|end|>\n<|{STATES[e]}|>\n"))
            out[-1] = (*out[-1][:-1], out[-1][-1] + "<|end|>\n")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "turn", "position", "role", "action", "cost", "piece"]
        r, rest = machine.value, None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b])
            spans = _spans(b)
            # The last run may go on in the next batch.
            yield pd.DataFrame([x for i, j in spans[:-1] for x in finish(r, b.iloc[i:j])], columns=columns)
            rest = b.iloc[spans[-1][0] : spans[-1][1]] if len(b) else None
        if rest is not None:
            yield pd.DataFrame(finish(r, rest), columns=columns)

    return rows.select("conv", "part", "seq", "conv_id", "turn", "role", "text", "best", "leave", "closes").mapInPandas(
        run, "conv_id string, turn string, position long, role string, action string, cost double, piece string"
    )


def _repair_long(rows: DataFrame, machine) -> DataFrame:
    spark = rows.sparkSession
    # The text is part of the order, so rows that repeat a turn spread over partitions.
    dealt = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    # Stored, so that every pass sees the same borders.
    dealt = save(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "turns")

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = machine.value
        for b in batches:
            b = b.sort_values(["conv", "part", "seq"])
            found = []
            for i, j in _spans(b):
                g = b.iloc[i:j]
                m = r.product([r.known(x) for x in g["role"]])
                found.append((g["conv"].iloc[0], g["part"].iloc[0], g["seq"].iloc[0], m.ravel().tolist()))
            yield pd.DataFrame(found, columns=["conv", "part", "first", "m"])

    # A partition read in several batches gives several factors, put in order by their first rows.
    factors = dealt.select("conv", "part", "seq", "role").mapInPandas(
        multiply, "conv string, part int, first long, m array<double>"
    )

    def costs(g: pd.DataFrame) -> pd.DataFrame:
        """Least costs before each part of a conversation, and after it."""
        r, n = machine.value, len(STATES)
        g, best, out = g.sort_values("first"), np.array(r.first_costs()), {}
        for conv, part, m in zip(g["conv"], g["part"], g["m"]):
            before = out.get(part, (None, None, best.tolist()))[2]
            best = (best[:, None] + np.array(m).reshape(n, n)).min(0)
            out[part] = (conv, part, before, best.tolist())
        return pd.DataFrame(list(out.values()), columns=["conv", "part", "best", "after"])

    known = save(factors.groupBy("conv").applyInPandas(costs, "conv string, part int, best array<double>, after array<double>"), "costs")
    # A long conversation has LONG rows at least, so a partition has few parts.
    with_costs = dealt.join(broadcast_if_bounded(known.select("conv", "part", "best")), ["conv", "part"])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each state after a part (or the piece of it in a batch), the state before."""
        r, n = machine.value, len(STATES)
        at, best, came_from = None, None, None
        for b in batches:
            found = []
            for i, j in _spans(b):
                g = b.iloc[i:j]
                if at != (key := (g["conv"].iloc[0], int(g["part"].iloc[0]))):
                    if at is not None:
                        found.append((*at, came_from))
                    at, best, came_from = key, list(g["best"].iloc[0]), list(range(n))
                for role in g["role"]:
                    best, came = r.forward(r.known(role), best)
                    came_from = [came_from[c] if c >= 0 else -1 for c in came]
            yield pd.DataFrame(found, columns=["conv", "part", "enter"])
        if at is not None:
            yield pd.DataFrame([(*at, came_from)], columns=["conv", "part", "enter"])

    ordered = with_costs.repartition("part").sortWithinPartitions("part", "seq")
    maps = ordered.select("conv", "part", "seq", "role", "best").mapInPandas(entries, "conv string, part int, enter array<int>")

    def states(g: pd.DataFrame) -> pd.DataFrame:
        """Back from the best end: the state after each part."""
        r, out = machine.value, []
        g = g.sort_values("part", ascending=False)
        at, closes = r.best_end(g["after"].iloc[0]), True
        for conv, part, enter in zip(g["conv"], g["part"], g["enter"]):
            out.append((conv, part, at, closes))
            at, closes = int(enter[at]), False
        return pd.DataFrame(out, columns=["conv", "part", "leave", "closes"])

    leaves = known.join(save(maps, "entries"), ["conv", "part"]).groupBy("conv").applyInPandas(
        states, "conv string, part int, leave int, closes boolean"
    )
    done = with_costs.join(broadcast_if_bounded(save(leaves, "states")), ["conv", "part"])
    return _render(done.repartition("part").sortWithinPartitions("part", "seq"), machine)


def repair(conversations: DataFrame, costs: Costs = Costs(), long: int = LONG) -> DataFrame:
    """(conv_id, turn, position, role, action, cost, piece): one row per given
    turn and per inserted turn (turn null); ``position`` orders the rows of a
    conversation (with gaps), ``cost`` is the row's share of the repair's."""
    spark, typed = conversations.sparkSession, dict(conversations.dtypes)
    rows = _rows(conversations)
    machine = spark.sparkContext.broadcast(Repair(costs))
    many = save(rows.groupBy("conv").count().where(F.col("count") > long).select("conv"), "long")
    short = rows
    parts = []
    if not many.isEmpty():
        short = rows.join(broadcast_if_bounded(many), "conv", "left_anti")
        parts.append(_repair_long(rows.join(broadcast_if_bounded(many), "conv", "left_semi"), machine))
    short = short.repartition("conv").sortWithinPartitions(*ORDER)
    none = {"best": "array<double>", "leave": "int", "closes": "boolean"}
    short = short.withColumns({"part": F.lit(0), "seq": F.lit(-1).cast("long"), **{c: F.lit(None).cast(t) for c, t in none.items()}})
    parts.append(_render(short, machine))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return out.withColumns({c: F.col(c).cast(typed[c]) for c in ("conv_id", "turn")})


# The same repair of the default costs, turn by turn: best costs of the four states, then the states from the
# last turn back. Rows: the given turns, the user turns put before an assistant's, and what closes a conversation.
ORACLE = r"""
WITH RECURSIVE g AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, lower(trim(role)) AS r,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
f(conv_id, i, b, c) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [0.0, 1e15, 1e15, 1e15]::DOUBLE[], [-1, -1, -1]::INT[] FROM g
  UNION ALL
  SELECT g.conv_id, g.i,
         [1e15,
          list_min(x.s) + CASE WHEN g.r = 'system' THEN 0 ELSE 2 END,
          list_min(x.u) + CASE WHEN g.r = 'user' THEN 0 ELSE 2 END,
          list_min(x.a) + CASE WHEN g.r = 'assistant' THEN 0 ELSE 2 END]::DOUBLE[],
         [list_position(x.s, list_min(x.s)) - 1, list_position(x.u, list_min(x.u)) - 1, list_position(x.a, list_min(x.a)) - 1]::INT[]
  FROM f JOIN g ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.i = f.i + 1,
       LATERAL (SELECT [b[1], b[2] + 1] AS s, [b[1], b[2], b[3] + 1, b[4]] AS u, [b[1] + 3, b[2] + 3, b[3], b[4] + 1] AS a) x),
e AS (SELECT f.conv_id, f.i, list_position([b[1] + 6, b[2] + 6, b[3] + 3, b[4]], list_min([b[1] + 6, b[2] + 6, b[3] + 3, b[4]])) - 1 AS st
      FROM f JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i),
w(conv_id, i, st) AS (
  SELECT conv_id, i, st::INT FROM e
  UNION ALL
  SELECT w.conv_id, w.i - 1, f.c[w.st] FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE w.i > 0),
t AS (
  SELECT g.*, w.st, p.st AS s, ['system', 'user', 'assistant'][w.st] AS role, p.st = w.st AS merged, p.st < 2 AND w.st = 3 AS put,
         coalesce(g.r, '') <> ['system', 'user', 'assistant'][w.st] AS relabel
  FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = g.i
         JOIN w p ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.i = g.i - 1),
o AS (
  SELECT conv_id, turn, 10 * (i - 1) + 4 AS position, role,
         CASE WHEN merged AND relabel THEN 'relabel+merge' WHEN merged THEN 'merge' WHEN relabel THEN 'relabel' ELSE 'append' END AS action,
         (CASE WHEN relabel THEN 2.0 ELSE 0.0 END + CASE WHEN merged THEN 1.0 ELSE 0.0 END)::DOUBLE AS cost,
         CASE WHEN merged THEN chr(10) || text
              ELSE CASE WHEN s > 0 OR put THEN '<|end|>' || chr(10) ELSE '' END || '<|' || role || '|>' || chr(10) || text END
         || CASE WHEN i = n AND st = 3 THEN '<|end|>' || chr(10) ELSE '' END AS piece
  FROM t
  UNION ALL
  SELECT conv_id, NULL, 10 * (i - 1), 'user', 'insert', 3.0, CASE WHEN s > 0 THEN '<|end|>' || chr(10) ELSE '' END || '<|user|>' || chr(10)
  FROM t WHERE put
  UNION ALL
  SELECT conv_id, NULL, 10 * (i - 1) + 5 + k, ['user', 'assistant'][x], 'insert', 3.0,
         '<|end|>' || chr(10) || '<|' || ['user', 'assistant'][x] || '|>' || chr(10) || CASE WHEN x = 2 THEN '<|end|>' || chr(10) ELSE '' END
  FROM (SELECT *, unnest(CASE WHEN st = 1 THEN [0, 1] ELSE [0] END) AS k FROM t WHERE i = n AND st < 3),
       LATERAL (SELECT CASE WHEN st = 1 THEN k + 1 ELSE 2 END AS x))
SELECT conv_id, turn, position::BIGINT AS position, role, action, cost::DOUBLE AS cost, piece FROM o
"""
