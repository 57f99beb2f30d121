"""Similarity joins in distributed steps: nodes that share a key meet, exact links join them, components follow.

Nothing here emits all pairs of a group, and no group of unverified candidates grows beyond one key.
Keys whose nodes are the same are compared once.  First each node meets only the company of its most
shared key, in chunks of bounded size; that joins up large groups of near copies.  Then only keys
whose nodes are still apart are compared, and only pairs that are apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import discard, maybe_marked, stash
from lakesift.llm.words import pieces

#: Nodes that one unit of the first round holds, about; nodes and bytes of a unit's side in the second.
CHUNK, WIDE, WIDE_BYTES = 64, 512, 8 << 20


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root`` for every node that has an edge; equal roots mean connected.

    Contraction: each node moves to the neighbour (or itself) that comes first in hash order, edges
    follow, until none is left; then the moves are chained backwards.  Rounds grow with the logarithm
    of the longest chain.  All steps are joins and partial aggregates, so a hub with very many edges is no group in one task.
    """
    edges = stash(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min(first("b")).alias("best")).select("node", F.when(F.struct(F.xxhash64("node"), F.col("node")) < F.col("best"), F.col("node")).otherwise(F.col("best.x")).alias("up"))
        up = stash(up, "cc-up")
        # two jumps: to the neighbour's choice and that one's
        for _ in range(2):
            onward = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            further = stash(up.join(onward, "up").select("node", F.col("next").alias("up")), "cc-up")
            discard(up)
            up = further
        moves.append(up)
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(left, "a").join(right, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        fewer = stash(moved, "cc-edges")
        discard(edges)
        edges = fewer
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = moves[0].select("node", F.col("up").alias("root"))
    for up in moves[1:]:
        later = up.select(F.col("node").alias("root"), F.col("up").alias("next"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    out = stash(labels, "cc-labels")
    discard(edges, *moves)
    return out


def shared_members(keyed: DataFrame) -> DataFrame:
    """``key, node`` -> ``key, m, node``: the ``m`` nodes of each key that two or more share, once each.

    Of keys with the same nodes one stays (told by two 64-bit sums over their hashes).  Keys are counted with partial
    aggregates; only shared ones (and few that a table of marks takes for shared) are joined back, by a plain join that
    adaptive execution splits where a key is hot.
    """
    shared = stash(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("key"), "shared-keys")
    members = stash(maybe_marked(keyed, "key", shared).join(shared, "key").repartition("key", "node").distinct(), "shared-nodes")
    alike = members.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    units = alike.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    out = stash(members.join(units, "key"), "shared-members")
    discard(shared, members)
    return out


def _by_unit(link: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, items, a, b = None, {}, [], []

        def close() -> None:
            for x, y in link([(n, *v) for n, v in sorted(items.items())]) if len(items) > 1 else ():
                a.append(x)
                b.append(y)

        for batch in pieces(batches, "payload"):
            for u, node, comp, payload in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "comp", "payload")), strict=True):
                if u != unit:
                    close()
                    unit, items = u, {}
                items[node] = (comp, payload)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])
                a.clear()
                b.clear()
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return run


def _linked(units: DataFrame, payloads: DataFrame, link: Callable) -> DataFrame:
    whole = units.join(payloads, "node").select("unit", "node", "comp", "payload")
    return whole.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(link), "a string, b string")


def verified_links(members: DataFrame, payloads: DataFrame, link: Callable) -> DataFrame:
    """``key, m, node (string)`` and ``node, payload`` -> links ``a, b`` that connect just what all links between nodes that share a key connect.

    ``link`` gets a unit's ``(node, comp, payload)`` and yields links; it may leave out pairs with equal
    ``comp`` (not null) and pairs that its earlier links connect.

    First round: a node goes to the one of its keys that most nodes share.  A key's company is dealt into chunks by hash,
    each with the same two pivots.  Second round: keys whose nodes these links leave apart.  Nodes outside a
    key's largest part meet all its nodes, in units of a bounded number of nodes and bytes on either side.
    """
    unit = lambda *parts: F.concat_ws("/", F.col("key").cast("string"), *parts)
    chosen = members.groupBy("node").agg(F.max(F.struct("m", "key")).alias("best")).select("node", F.col("best.key").alias("key"))
    chosen = stash(chosen, "chosen")
    sizes = stash(chosen.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("p"), F.max("node").alias("q")).filter("n > 1"), "chosen-sizes")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int")
    everywhere = F.when(F.col("node").isin(F.col("p"), F.col("q")), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(chunk))
    first = chosen.join(sizes, "key").withColumn("at", F.explode(everywhere)).select(unit("at").alias("unit"), "node", F.lit(None).cast("string").alias("comp"))
    links = stash(_linked(first, payloads, link), "links")
    discard(chosen, sizes)

    found = components(links)
    parts = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    parts = stash(parts, "parts")
    apart = parts.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).filter("a <> z").select("key")
    apart = stash(parts.join(apart, "key").join(payloads.select("node", F.octet_length("payload").cast("long").alias("bytes")), "node"), "apart")
    by_part = apart.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    plan = by_part.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("all_n"), F.sum("bytes").alias("all_bytes"))
    wide = F.ceil(F.greatest(F.col("all_n") / WIDE, F.col("all_bytes") / WIDE_BYTES))
    plan = plan.select("key", "main", wide.cast("int").alias("wide"), F.ceil((F.col("all_n") - F.col("main_n")) * wide / F.col("all_n")).cast("int").alias("rests"))
    plan = stash(plan, "apart-plan")
    again = apart.join(plan, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("wide")).cast("int"))
    rest = F.pmod(F.xxhash64("node", F.lit(11)), F.col("rests")).cast("int")
    as_own = again.select("key", "node", "comp", F.col("own").alias("at"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("with"))
    as_rest = again.filter("comp <> main").withColumn("with", rest).select("key", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("at"), "with")
    second = as_own.unionByName(as_rest).distinct().select(unit("at", "with").alias("unit"), "node", "comp")
    out = stash(links.unionByName(_linked(second, payloads, link)), "links")
    discard(links, parts, apart, plan)
    return out


class Linker:
    """Union-find over a unit's items, by position; ``comp`` ties items from the start."""

    def __init__(self, comps: list[str | None]) -> None:
        self.up = list(range(len(comps)))
        seen: dict[str, int] = {}
        for i, c in enumerate(comps):
            if c is not None:
                self.join(i, seen.setdefault(c, i))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j
