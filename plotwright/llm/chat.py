"""Chat formatting with the cheapest repair of roles.

A legal conversation is an optional system turn, then user and assistant turns in turn, ended by the assistant.
Each turn of the input is kept, relabelled, merged into the turn before, or preceded by empty turns; every
choice has a cost, and dynamic programming over the automaton's states finds the cheapest legal outcome. Of
equal ones it takes the one whose states, read from the last turn back, come first in the order of ``STATES``; the
outcome thus depends on the conversation alone. The repaired sequence is then rendered.

A conversation may hold any share of all rows. Those over ``block`` turns are sorted by ranges, numbered by what
each range holds, and cut into blocks of as many turns. A block comes down to a 4 x 4 table of least costs between
states (min-plus matrices compose) and the order among equal ones. Tables are composed in a tree, ``FAN`` neighbours
to one, until a conversation has no more than that; those decide the states at their edges, then, back down the tree,
those below them. Each block then repairs and renders its own turns. So no task holds more of a conversation than
``FAN`` tables or one block, and no row grows with it; conversations of up to ``block`` turns are one row.

Defined results: turns are ordered by turn, then role, then text, null turn numbers last; a role is read
without case or outer white space and by its common aliases, null or unknown roles take any legal one at a low cost;
null text is empty; rows of a null conv_id form one conversation; repeated rows are turns of their own; an
empty table gives none. Markers in a text are broken up, so that no text can open a turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

STATES = ("start", "system", "user", "assistant")
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
#: Fixed costs.
KEEP, MERGE, RELABEL_UNKNOWN, INSERT, RELABEL, MERGE_OTHER = 0, 1, 1, 2, 3, 4
ACTIONS = ("keep", "merge", "insert", "relabel")
ALIASES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3, "ai": 3}
BLOCK = 256
#: Tables that are composed to one in the tree of a long conversation.
FAN = 256
FAR = 1 << 40

Move = tuple[int, int, tuple[int, ...], str]  # cost, new state, roles opened, action


def moves(state: int, role: int) -> list[Move]:
    """What may become of a turn of that role (0: unknown) after that state; two empty turns lead anywhere."""
    out: list[Move] = []
    if state and role in (state, 0):
        out.append((MERGE, state, (), "merge"))
    elif state:
        out.append((MERGE_OTHER, state, (), "merge"))
    for to in NEXT[state]:
        same = to == role
        out.append((KEEP if same else RELABEL if role else RELABEL_UNKNOWN, to, (to,), "keep" if same else "relabel"))
        for then in NEXT[to]:
            if then == role:
                out.append((INSERT, then, (to, then), "insert"))
            out += [(2 * INSERT, last, (to, then, last), "insert") for last in NEXT[then] if last == role]
    return sorted(out, key=lambda m: (m[0], ACTIONS.index(m[3]), m[1]))


MOVES = [[moves(s, r) for r in range(4)] for s in range(4)]


#: For each state and role the cheapest move to each new state, or None.
BEST = [[[next((m for m in MOVES[s][r] if m[1] == e), None) for e in range(4)] for r in range(4)] for s in range(4)]


def table(roles: list[int]) -> list[int]:
    """Least costs from each state (row) to each state through turns of these roles, FAR if there is no way; then, for each of these 16, its place among equal states at the end by the states on the way, read backwards."""
    costs, keys = [], []
    for start in range(4):
        now = [(0, 0) if s == start else (FAR, 0) for s in range(4)]
        for k, role in enumerate(roles):
            after = [(FAR, 0)] * 4
            for e in range(4):
                ways = [(now[s][0] + m[0], s << 2 * k | now[s][1]) for s in range(4) if now[s][0] < FAR and (m := BEST[s][role][e])]
                if ways:
                    after[e] = min(ways)
            now = after
        costs += [c for c, _ in now]
        keys += [k >> 2 for _, k in now]  # without the state at the start
    ranks = [0] * 16
    for e in range(4):
        order = sorted({keys[4 * s + e] for s in range(4)})
        for s in range(4):
            ranks[4 * s + e] = order.index(keys[4 * s + e])
    return costs + ranks


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """The cost of ending after that state, and the empty turns for it."""
    opened: tuple[int, ...] = ()
    while state != LAST:
        state = NEXT[state][-1]
        opened += (state,)
    return INSERT * len(opened), opened


def composed(tables: list[list[int]]) -> list[int]:
    """The table of all turns of these tables, one after the other."""
    whole = tables[0]
    for t in tables[1:]:
        # the state between for each start and end: by cost, then by the states of the later part read backwards, then itself
        ways = [min((min(whole[4 * s + m] + t[4 * m + e], FAR), t[16 + 4 * m + e], m) for m in range(4)) for s in range(4) for e in range(4)]
        keys = [(rank, m, whole[16 + 4 * (k // 4) + m]) for k, (_, rank, m) in enumerate(ways)]
        ranks = [sorted({keys[4 * s + k % 4] for s in range(4)}).index(keys[k]) for k in range(16)]
        whole = [cost for cost, _, _ in ways] + ranks
    return whole


def edges(tables: list[list[int]], first: int = 0, last: int | None = None) -> tuple[int, list[int]]:
    """The least cost from a state to another (to the end of the conversation if none is said), and the states before, between and after these tables on the way."""
    costs, back = [0 if s == first else FAR for s in range(4)], []
    for t in tables:
        best = [min((min(costs[s] + t[4 * s + e], FAR), t[16 + 4 * s + e], s) for s in range(4)) for e in range(4)]
        back.append([s for _, _, s in best])
        costs = [c for c, _, _ in best]
    total, state = min((costs[s] + closing(s)[0], s) for s in range(4) if costs[s] < FAR) if last is None else (costs[last], last)
    path = [state]
    for b in reversed(back):
        path.append(b[path[-1]])
    return total, path[::-1]


def repair(roles: list[int], first: int, last: int) -> list[Move]:
    """The cheapest moves that lead from one state to the other through turns of these roles."""
    behind = [[0 if s == first else FAR for s in range(4)]]
    for role in roles:
        behind.append([min((behind[-1][s] + m[0] for s in range(4) if (m := BEST[s][role][e])), default=FAR) for e in range(4)])
    out, state = [], last
    for k in range(len(roles) - 1, -1, -1):
        before = next(s for s in range(4) if (m := BEST[s][roles[k]][state]) and behind[k][s] + m[0] == behind[k + 1][state] < FAR)
        out.append(BEST[before][roles[k]][state])
        state = before
    return out[::-1]


def _opened(state: int, fresh: bool) -> str:
    return ("" if fresh else "<|end|>\n") + f"<|{STATES[state]}|>\n"


def render(roles: list[int], texts: list[str], first: int, last: int, ends: bool) -> tuple[str, str, list[int]]:
    """A block's part of the rendered conversation, of its roles' initials, and its counts of merges, relabels, insertions."""
    out, initials, counts, fresh = [], [], [0, 0, 0], first == 0
    for (_, _, opened, action), text in zip(repair(roles, first, last), texts):
        for state in opened:
            out.append(_opened(state, fresh))
            initials.append(STATES[state][0])
            fresh = False
        text = text.replace("<|", "< |")
        out.append(text if opened else f"\n\n{text}")
        counts[0] += action == "merge"
        counts[1] += action == "relabel"
        counts[2] += max(0, len(opened) - 1)
    if ends:
        for state in closing(last)[1]:
            out.append(_opened(state, fresh))
            initials.append(STATES[state][0])
            counts[2] += 1
            fresh = False
        out.append("<|end|>\n")
    return "".join(out), "".join(initials), counts


def _by_key(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], names: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of equal key in sorted batches."""
    rows = (row for batch in batches for row in zip(*(batch.column(n).to_pylist() for n in (*key, *names))))
    for k, own in groupby(rows, key=lambda r: r[: len(key)]):
        yield k, [r[len(key) :] for r in own]


def _runs(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], names: tuple[str, ...], of: Callable, schema: str) -> DataFrame:
    """of(key, rows) of each run of rows of equal key, in order; of gives rows of the schema."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
        types = [arrow[x.split()[1]] for x in schema.split(", ")]
        held: list[tuple] = []
        for k, rows in _by_key(batches, key, names):
            held += of(k, rows)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=fields)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names=fields)

    return df.repartition(*key).sortWithinPartitions(*key, *order).select(*key, *names).mapInArrow(step, schema)


def numbered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, said, text and more) with place, the number of turns of the conversation before.

    Equal turns are dealt by a number of their own, so that no range grows with their count.
    """
    keys = ["conv_id", "turn", "said", "text"]
    kept = turns.columns
    names = [*kept, "range", "within"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), "", 0
        for batch in batches:
            within = []
            for conv in batch.column("conv_id").to_pylist():
                n, last = n + 1 if conv == last else 0, conv
                within.append(n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([part] * len(within), pa.int32()), pa.array(within, pa.int64())], names=names)

    own = turns.withColumn("__equal", F.monotonically_increasing_id())
    ordered = own.repartitionByRange(*keys, "__equal").sortWithinPartitions(*keys, "__equal").drop("__equal")
    found = written(ordered.mapInArrow(count, turns.withColumns({"range": F.lit(0), "within": F.lit(0).cast("long")}).schema), "turns")
    sizes = found.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("conv_id").alias("p_id"), F.col("range").alias("p_range"), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    met = found.join(before, found["conv_id"].eqNullSafe(before["p_id"]) & (found["range"] == before["p_range"]))
    return met.select(*kept, (F.col("before") + F.col("within")).alias("place"))


def repaired(turns: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Per conversation and block of turns: n_turns, cost (of the conversation), merges, relabels, insertions, roles (initials) and rendered."""
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    own = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(FAR)).alias("turn"),
        F.coalesce(aliases[F.lower(F.trim("role"))], F.lit(0)).alias("role"), F.coalesce("role", F.lit("")).alias("said"), F.coalesce("text", F.lit("")).alias("text"),
    )
    sizes = own.groupBy(F.col("conv_id").alias("c_id")).agg(F.count("*").alias("n"))
    long = written(sizes.where(F.col("n") > block).select("c_id", "n"), "long")
    same = own["conv_id"].eqNullSafe(long["c_id"])
    short = own.join(long, same, "left_anti").select(*own.columns, F.lit(0).cast("long").alias("place"))
    most = long.agg(F.max("n")).first()[0]
    if most:
        short = short.union(numbered(own.join(long, same, "left_semi")))
    own = written(short.withColumn("block", F.floor(F.col("place") / block).cast("long")), "blocks")
    order = ("place", "turn", "said", "text")
    tables = _runs(own, ("conv_id", "block"), order, ("role",), lambda k, rows: [(*k, table([r for (r,) in rows]))], "conv_id long, block long, costs array<long>")

    levels, blocks = [tables], -(-(most or 1) // block)
    while blocks > fan:
        below = written(levels[-1].withColumn("up", F.floor(F.col("block") / fan).cast("long")), "tables")
        levels[-1] = below
        levels.append(_runs(below, ("conv_id", "up"), ("block",), ("costs",), lambda k, rows: [(*k, composed([t for (t,) in rows]))], "conv_id long, block long, costs array<long>"))
        blocks = -(-blocks // fan)

    def decide(key: tuple, rows: list[tuple]) -> list[tuple]:
        total, path = edges([t for _, t in rows])
        return [(key[0], b, path[i], path[i + 1], i == len(rows) - 1, total) for i, (b, _) in enumerate(rows)]

    def within(key: tuple, rows: list[tuple]) -> list[tuple]:
        _, _, first, last, ends, total = rows[0]
        _, path = edges([r[1] for r in rows], first, last)
        return [(key[0], r[0], path[i], path[i + 1], ends and i == len(rows) - 1, total) for i, r in enumerate(rows)]

    decided = "conv_id long, block long, first int, last int, ends boolean, cost long"
    plan = _runs(levels[-1], ("conv_id",), ("block",), ("block", "costs"), decide, decided)
    for below in reversed(levels[:-1]):
        p = plan.withColumnsRenamed({"conv_id": "p_id", "block": "p_block"})
        under = below.join(p, below["conv_id"].eqNullSafe(p["p_id"]) & (below["up"] == p["p_block"]))
        plan = _runs(under, ("conv_id", "up"), ("block",), ("block", "costs", "first", "last", "ends", "cost"), within, decided)
    p = plan.withColumnsRenamed({"conv_id": "p_id", "block": "p_block"})
    met = own.join(p, own["conv_id"].eqNullSafe(p["p_id"]) & (own["block"] == p["p_block"]))

    def write(key: tuple, rows: list[tuple]) -> list[tuple]:
        _, _, first, last, ends, cost = rows[0]
        text, initials, counts = render([r[0] for r in rows], [r[1] for r in rows], first, last, ends)
        return [(*key, len(rows), cost, *counts, initials, text)]

    return _runs(met, ("conv_id", "block"), order, ("role", "text", "first", "last", "ends", "cost"), write, "conv_id long, block long, n_turns long, cost long, merges long, relabels long, insertions long, roles string, rendered string")


def op5_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
