"""Repair of conversation structure: the cheapest edits to a legal order of roles, by the auction algorithm for shortest paths."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm._spark import ranked, settle

#: Rows of a conversation that one task has at once. Longer conversations are cut into blocks of so many.
BLOCK = 512

# Fixed values of the contract: what edits cost, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The first and the last may end it.
STATES, ACCEPTS = 4, (0, 3)
#: Where a new user or assistant leads from each state: only one of them is legal there.
NEXT, NEXT_ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEVER = math.inf

# A row's code: initial of its role (o: any other), in capitals if it is truncated, x if it has to go.


def arcs(codes: str, i: int, state: int, last: bool) -> list[tuple[str, int, int]]:
    """(edit, cost, node) of the arcs of a node of the lattice, by the edit's initial. Node 4 * i + state: i rows are done. After the last row there are
    insertions only if the conversation ends there, as those before a row belong to that row's block."""
    out = []
    if i < len(codes):
        code = codes[i]
        out.append(("D", DELETE, STATES * (i + 1) + state))
        out.append(("I", INSERT, STATES * i + NEXT[state]))
        if code != "x":
            more = TRUNCATED if code.isupper() else 0
            kept = _KEPT.get((state, code.lower()))
            if kept is not None:
                out.append(("K", KEEP + more, STATES * (i + 1) + kept))
            out.append(("R", REROLE + more, STATES * (i + 1) + NEXT[state]))
    elif last:
        out.append(("I", INSERT, STATES * i + NEXT[state]))
    return out


def auction(out_arcs: list[list[tuple[int, int]]], ends: list[float], origins: range) -> list[float]:
    """The prices of nodes at which the auction has converged for all origins: their distances to the one destination. Arcs (cost, node); a node below 0 is the
    destination, at the cost of ends[node]. Nodes from which no path leads there are priced NEVER at once: bids on them would rise for ever.

    A path starts at an origin. If the last node's price is below the least of cost and price over its arcs, it is raised to that and the path contracts by the
    node; else the path is extended along that arc. It ends at a node whose price has converged before, for prices hold for all origins. Origins go from the
    destination back, so a path contracts within a row of the lattice only, and the work is linear in its rows.
    """
    into: list[list[int]] = [[] for _ in out_arcs]
    live = [False] * len(out_arcs)
    for node, arcs_of in enumerate(out_arcs):
        for _, v in arcs_of:
            if v >= 0:
                into[v].append(node)
            elif ends[v] < NEVER:
                live[node] = True
    ahead = [n for n, x in enumerate(live) if x]
    while ahead:
        for node in into[ahead.pop()]:
            if not live[node]:
                live[node] = True
                ahead.append(node)

    price, done = [0.0 if x else NEVER for x in live], [not x for x in live]
    for origin in origins:
        path = [] if done[origin] else [origin]
        while path:
            node = path[-1]
            least, to = min((cost + (ends[v] if v < 0 else price[v]), v) for cost, v in out_arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            elif to < 0 or done[to]:
                for node in path:
                    done[node] = True
                path = []
            else:
                path.append(to)
    return price


def prices(codes: str, ends: list[float], last: bool) -> list[float]:
    """Distances of all nodes of a block of rows to the end, where ends are the distances from the states after it."""
    n = len(codes)
    graph = [[(c, v) for _, c, v in arcs(codes, i, s, last)] for i in range(n + 1) for s in range(STATES)]
    for s in range(STATES):
        graph[STATES * n + s].append((0, s - STATES))
    return auction(graph, ends, range(len(graph) - 1, -1, -1))


#: Distances from the states after all rows.
END = [0.0 if s in ACCEPTS else NEVER for s in range(STATES)]


def trace(codes: str, price: list[float], ends: list[float], last: bool, state: int) -> tuple[str, list[int], list[str], int]:
    """(edits, rows, roles, state at the end) of the path of tight arcs that takes the least initial at each node. rows: those that stay, from 1, and 0 for inserted ones;
    roles: the new ones, empty where the row's own stays."""
    edits, rows, roles, node = [], [], [], state
    while True:
        i, s = divmod(node, STATES)
        if i == len(codes) and price[node] == ends[s]:
            return "".join(edits), rows, roles, s
        edit, _, to = next(a for a in arcs(codes, i, s, last) if price[node] == a[1] + price[a[2]])
        edits.append(edit)
        if edit != "D":
            rows.append(0 if edit == "I" else i + 1)
            roles.append("" if edit == "K" else NEXT_ROLE[s])
        node = to


@functools.lru_cache(1 << 14)
def repaired(codes: str) -> tuple[int, str, list[int], list[str]]:
    """(cost, edits, rows, roles) of a whole conversation."""
    price = prices(codes, END, True)
    return int(price[0]), *trace(codes, price, END, True, 0)[:3]


_PLAN = "conv string, block long, cost long, edits string, rows array<int>, roles array<string>"


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [repaired(c) for c in b["codes"]]
        yield pd.DataFrame({"conv": b["conv"], "block": b["block"], **{c: [f[k] for f in found] for k, c in enumerate(("cost", "edits", "rows", "roles"))}})


def _crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What it costs to cross a block of rows, from each state before it to each after it; -1 for never."""
    for b in batches:
        costs = []
        for codes in b["codes"]:
            by_end = [prices(codes, [0.0 if s == e else NEVER for s in range(STATES)], False)[:STATES] for e in range(STATES)]
            costs.append([-1 if by_end[e][s] == NEVER else int(by_end[e][s]) for s in range(STATES) for e in range(STATES)])
        yield pd.DataFrame({"conv": b["conv"], "block": b["block"], "costs": costs})


def _ahead(blocks: pd.DataFrame) -> pd.DataFrame:
    """For the blocks of a conversation: distances from the states after each to its end. The blocks are a lattice with their costs as arcs: an auction again."""
    blocks = blocks.sort_values("block")
    graph: list[list[tuple[int, int]]] = []
    for k, costs in enumerate(blocks["costs"]):
        graph += [[(c, STATES * (k + 1) + e) for e, c in enumerate(costs[STATES * s : STATES * (s + 1)]) if c >= 0] for s in range(STATES)]
    graph += [[(0, s - STATES)] for s in range(STATES)]
    price = auction(graph, prices("", END, True), range(len(graph) - 1, -1, -1))
    after = [[int(p) for p in price[STATES * (k + 1) : STATES * (k + 2)]] for k in range(len(blocks))]
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "ahead": after, "last": blocks["block"] == blocks["block"].max(), "cost": int(price[0])})


_PATHS = "conv string, block long, cost long, to array<int>, plans array<struct<edits: string, rows: array<int>, roles: array<string>>>"


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each state before a block the state after it, and the edits between."""
    for b in batches:
        to, plans = [], []
        for codes, ahead, last in zip(b["codes"], b["ahead"], b["last"], strict=True):
            ends = END if last else [float(x) for x in ahead]
            price = prices(codes, ends, last)
            found = [trace(codes, price, ends, last, s) for s in range(STATES)]
            to.append([f[3] for f in found])
            plans.append([dict(zip(("edits", "rows", "roles"), f, strict=False)) for f in found])
        yield pd.DataFrame({"conv": b["conv"], "block": b["block"], "cost": b["cost"], "to": to, "plans": plans})


def _entered(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which the path enters each block of a conversation."""
    blocks, state, out = blocks.sort_values("block"), 0, []
    for to in blocks["to"]:
        out.append(state)
        state = int(to[state])
    return pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "state": out})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, of parts in order: the digest is carried from part to part."""
    conv, digest, begun = None, hashlib.sha256(), False

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [digest.hexdigest()]})

    for b in batches:
        for k in range(b.num_rows):
            name = b.column("conv")[k].as_py()
            if name != conv:
                if conv is not None:
                    yield told()
                conv, digest, begun = name, hashlib.sha256(), False
            if b.column("stay")[k].as_py():
                digest.update(b"\n" if begun else b"")
                digest.update(b.column("part")[k].as_buffer())
                begun = True
    if conv is not None:
        yield told()


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with nulls of role and text as one space, damaged by CRC-32 of `conv_id:turn` modulo 20 (nulls as one space):
    0 drops the row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes it the user's."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    return (
        conversations.select("conv_id", "turn", name[2].alias("role"), name[3].alias("text"), kind.alias("kind"))
        .where("kind != 0")
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("kind", "again")
    )


def _faults(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of conversations: (conv, block, held, codes, blank, duplicate, truncated, and what its first and last rows are)."""
    spaces = r"[^\x20\x09-\x0D]"
    rows = settle(rows, "repair-rows")
    rows = settle(ranked(rows, ["conv"], ["turn", "role", "text"]).withColumn("same", F.sha2(F.concat(F.octet_length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)), "repair-ranked")
    first = rows.groupBy("conv", "same").agg(F.min("at").alias("at")).select("conv", "at", F.lit(True).alias("first"))
    last_mark = F.regexp_like("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(~F.regexp_like("text", F.lit(spaces)), "blank").when(F.col("first").isNull(), "duplicate").when(~last_mark, "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    rows = rows.join(first, ["conv", "at"], "left").withColumns({"fault": fault, "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("o")})
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    held = F.array_sort(F.collect_list(F.struct("at", "turn", "role", "text", "initial", code.alias("code"))))
    counts = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    turns = F.size(F.array_distinct(F.expr("filter(held.turn, t -> t IS NOT NULL)"))).cast("long")
    joint = F.expr("size(filter(transform(sequence(0, size(held)), i -> concat(get(held.initial, i - 1), get(held.initial, i))), p -> p NOT IN ('su', 'ua', 'au')))")
    return (
        rows.groupBy("conv", F.floor(F.col("at") / block).alias("block"))
        .agg(held.alias("held"), *counts, F.min("turn").alias("least"), F.max("turn").alias("most"))
        .withColumns({"codes": F.array_join(F.col("held.code"), ""), "turns": turns, "illegal": joint.cast("long"), "first": F.element_at("held", 1), "final": F.element_at("held", -1)})
        .withColumns({c: F.struct(F.col(f"{c}.turn").alias("turn"), F.col(f"{c}.initial").alias("initial")) for c in ("first", "final")})
    )


def _lines(rows: Column, roles: Column) -> Column:
    """Repaired lines `role:text` of a block, joined."""
    role = lambda k, r: F.when(r != "", r).otherwise(F.element_at("held", k)["role"])
    line = lambda k, r: F.concat(F.when(k == 0, r).otherwise(role(F.greatest(k, F.lit(1)), r)), F.lit(":"), F.when(k == 0, "").otherwise(F.element_at("held", F.greatest(k, F.lit(1)))["text"]))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.zip_with(rows, roles, line), "\n"))


def repair(conversations: DataFrame, original: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of `original` (default: conversations), from the
    rows of conversations (conv_id, turn, role, text) by turn, nulls first.

    Blank rows and those whose role and text came before have to go (2), truncated ones go (2) or stay (5 more), a role is changed to user or assistant (1), an
    empty row of either is inserted (5), so that roles read `(s?(ua)+)?`. Rows done and the state of that pattern are the nodes of a lattice of whole costs; the
    auction algorithm finds the distance of each node to the end, the prices at which arcs are tight are those of all cheapest repairs, and the one whose
    initials come first in ASCII is traced.

    Rows of a conversation are numbered without one task for it, and cut into blocks. A conversation of one block is repaired in its row. Of longer ones each
    block gives what it costs to cross it from state to state (16 numbers); an auction over the blocks gives the distances after each, each block then traces its
    paths from all states, and the states in which blocks are entered follow from 4 numbers of each. Only these go to one task, and the digest, which
    has to pass over the repaired lines in order: it reads blocks one after another.

    Ties: rows of one turn go by role and text; equal rows are repeated rows. Nulls: role and text count as one space, a null turn comes first and has no gap, a null
    conv_id is a conversation. Conversations without rows: zeros, an empty audit, the digest of nothing. gaps is null where it leaves the range
    of a long. Empty table: no rows. Further columns are ignored.
    """
    name = F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))
    ids = (conversations if original is None else original).select("conv_id").distinct().withColumn("conv", name)
    rows = conversations.select(name.alias("conv"), "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    blocks = settle(_faults(rows, block), "repair-blocks")
    long = settle(blocks.where("block > 0").select("conv").distinct(), "repair-long")
    some = not long.isEmpty()
    single = blocks.join(long, "conv", "left_anti") if some else blocks
    plan = single.join(single.select("conv", "block", "codes").mapInPandas(_whole, _PLAN), ["conv", "block"])
    done = plan.select("conv", F.col("edits").alias("audit"), F.sha2(_lines(F.col("rows"), F.col("roles")), 256).alias("repaired_sha256"), "cost")
    if some:
        done = done.unionByName(_long(blocks.join(long, "conv", "left_semi")))

    seam = F.expr("LEAD(first) OVER (PARTITION BY conv ORDER BY block)")
    over = blocks.select("conv", "block", "blank", "duplicate", "truncated", "illegal", "turns", "least", "most", "final", seam.alias("then"))
    met = F.concat(F.col("final.initial"), F.col("then.initial"))
    counted = over.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.count_if(~met.isin("su", "ua", "au"))).alias("illegal"),
        (F.max("most").cast("decimal(38,0)") - F.min("least") + 1 - F.sum("turns") + F.count_if(F.col("final.turn") == F.col("then.turn"))).alias("gaps"),
    )
    gaps = F.when(F.col("gaps").isNull(), 0).otherwise(F.expr("try_cast(gaps AS BIGINT)"))
    out = ids.join(counted.withColumns({"gaps": gaps, "some": F.lit(True)}).join(done, "conv"), "conv", "left")
    numbers = [F.when(F.col("some"), F.col(c)).otherwise(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _long(blocks: DataFrame) -> DataFrame:
    """Conversations of several blocks."""
    codes = blocks.select("conv", "block", "codes")
    costs = settle(codes.mapInPandas(_crossed, "conv string, block long, costs array<int>"), "repair-costs")
    ahead = costs.groupBy("conv").applyInPandas(_ahead, "conv string, block long, ahead array<long>, last boolean, cost long")
    paths = settle(codes.join(ahead, ["conv", "block"]).mapInPandas(_paths, _PATHS), "repair-paths")
    entered = paths.select("conv", "block", "to").groupBy("conv").applyInPandas(_entered, "conv string, block long, state int")
    plan = paths.join(entered, ["conv", "block"]).select("conv", "block", "cost", F.col("plans")[F.col("state")].alias("plan"))
    plan = settle(plan.join(blocks.select("conv", "block", "held"), ["conv", "block"]).select(
        "conv", "block", "cost", F.col("plan.edits").alias("edits"), (F.size("plan.rows") > 0).alias("stay"), _lines(F.col("plan.rows"), F.col("plan.roles")).alias("part")
    ), "repair-parts")
    audits = plan.groupBy("conv").agg(F.array_join(F.expr("array_sort(collect_list(struct(block, edits))).edits"), "").alias("audit"), F.max("cost").alias("cost"))
    digests = plan.select("conv", "block", "stay", "part").repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_digests, "conv string, repaired_sha256 string")
    return audits.join(digests, "conv").select("conv", "audit", "repaired_sha256", "cost")
