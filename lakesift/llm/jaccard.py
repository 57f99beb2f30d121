"""N-gram Jaccard join by signature trees.

Texts become sets of word shingles.  A signature tree's nodes hold the OR of their sets' token bitmaps and
their range of sizes; a dual traversal leaves out pairs of nodes whose greatest possible overlap is too
small, and leaves compare whole sets.  At the root the bitmap is as wide as the token space and kept as rows,
one for each set bit of a set's signature: its rarest tokens, so many that two sets over the threshold must
share one of them.  A bit that two sets share is the root of a subtree, and subtrees are traversed in
parallel; below the roots, bitmaps are dense and as wide as the subtree's sets ask for.  The first traversal
has bitmaps and sizes alone: sets that it leaves without a possible partner never travel.

Rare means few occurrences in a table of SLOTS counters over all texts.  Any one order of tokens
gives the same links; this one keeps passages that many texts share out of signatures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.clusters import Linker, components, shared_members, verified_links
from lakesift.llm.common import discard, stash, unused
from lakesift.llm.words import Texts, mix, pieces

#: Bits of a dense bitmap: so many times the largest set of the tree, from the least to the most; those that travel are smaller.
SPREAD, LEAST_BITS, MOST_BITS = 8, 2048, 1 << 17
SENT_SPREAD, SENT_LEAST, SENT_MOST = 2, 256, 1 << 16
LEAF, FAN = 4, 4
#: Texts to be read again, at most, whose ids are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Sets of a subtree whose bitmaps one task holds; in larger subtrees all sets travel, in parts.
TRAVERSED = 2048
#: Counters of token occurrences, whatever the corpus; so many of them make a row.
SLOT_BITS, BLOCK_BITS = 21, 13

#: Sizes from one range's floor to the next grow by this, at least 1 / threshold.
RANGE = 1.5


def floors() -> np.ndarray:
    out = [2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RANGE)))
    return np.array(out, np.int64)


FLOORS = floors()


def shingle_sets(texts: list[str | None], width: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; with fewer words the whole sequence is one."""
    t = Texts(texts, lower)
    grams = t.shingles(width) if len(t.hash) else t.hash
    out = []
    for i in range(len(texts)):
        a, b = int(t.first[i]), int(t.first[i + 1])
        n = b - a
        if n >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n:
            short = np.uint64(n)
            for j in range(a, b):
                short = mix(np.array([short]) + t.hash[j : j + 1], j - a + 50)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identities(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    return tuple(np.array([mix(s, seed).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for seed in (21, 23))


def _profile(width: int, lower: bool):
    """A row for each text; at the task's end, rows of its counters (without an id's columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        names = ["id", "th", "n", "s1", "s2", "block", "counts"]
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width, lower)
            for s in sets:
                counts[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] += np.uint32(1)
            s1, s2 = identities(sets)
            none = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), *none], names=names)
        held = counts.reshape(-1, 1 << BLOCK_BITS)
        some = np.flatnonzero(held.any(1))
        rows = pa.array([np.minimum(held[i], 65535).astype(np.uint16).tobytes() for i in some], pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64()) for _ in range(5)], pa.array(some, pa.int32()), rows], names=names)

    return run


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of all tasks added up, as bytes: eight times their binary logarithm."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total.setdefault(block, np.zeros(1 << BLOCK_BITS, np.uint64))
            total[block] += np.frombuffer(counts, np.uint16)
    rows = [np.minimum(255, 8 * np.log2(1 + t.astype(float))).astype(np.uint8).tobytes() for t in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], names=["block", "weights"])


def token_weights(counters: DataFrame) -> Broadcast:
    """``block, counts`` rows -> one byte for each slot, 2 MB whatever the corpus."""
    out = np.zeros((1 << (SLOT_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for r in counters.repartition("block").mapInArrow(_weights, "block int, weights binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["weights"], np.uint8)
    return counters.sparkSession.sparkContext.broadcast(out.ravel())


def signature(s: np.ndarray, weights: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rarest tokens of a set, as bits of the root's bitmap: sets with ``den * overlap >= num * union``, if different, share one.

    Such sets have at least ``ceil(num * n / den)`` tokens in common, n being either's size; if all of them
    were behind the first ``n - ceil(num * n / den) + 1`` in one order of all tokens, too few would be left.
    A bit stands for a token and a range of sizes: a set has those of its own range and, where a larger
    partner can be there, of the next.  A set too small to be like a different one has none.
    """
    n = len(s)
    if n * (den - num) < num:
        return np.zeros(0, np.int64)
    first = n + num * n // -den + 1
    bits = weights[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(s, 3) >> np.uint64(8)
    bits = np.partition(bits, first - 1)[:first] if first < n else bits
    home = int(np.searchsorted(FLOORS, n, "right")) - 1
    ranges = (home, home + 1) if n * den >= FLOORS[home + 1] * num else (home,)
    return np.concatenate([mix(bits, 100 + r) for r in ranges]).view(np.int64)


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """Bytes of a bitmap; a narrower one is the OR of its parts."""
    b = np.zeros(width, np.uint8)
    b[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(b)


def wide_enough(n: int, spread: int, least: int, most: int) -> int:
    return min(most, max(least, 1 << (spread * n).bit_length()))


def _signatures(width: int, lower: bool, num: int, den: int, weights: Broadcast):
    """``node, keys, n, bits``; a set that a batch repeats comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width, lower)
            s1, _ = identities(sets)
            s1, at = np.unique(s1, return_index=True)
            keys = [signature(sets[i], weights.value, num, den) for i in at]
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            values = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            bits = pa.array([bitmap(sets[i], wide_enough(len(sets[i]), SENT_SPREAD, SENT_LEAST, SENT_MOST)).tobytes() for i in at], pa.binary())
            out = pa.RecordBatch.from_arrays([pa.array(s1), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array([len(sets[i]) for i in at], pa.int64()), bits], names=["node", "keys", "n", "bits"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return run


def _payloads(width: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), width, lower)
            s1, s2 = identities(sets)
            good = [len(s) == n and a == x and b == y for s, n, a, x, b, y in zip(sets, batch.column("n").to_pylist(), s1.tolist(), batch.column("s1").to_pylist(), s2.tolist(), batch.column("s2").to_pylist(), strict=True)]
            told = [batch.column(c) for c in ("s1", "s2", "n")]
            out = pa.RecordBatch.from_arrays([*told, pa.array([s.tobytes() for s in sets], pa.binary())], names=["s1", "s2", "n", "payload"])
            yield out.filter(pa.array(good, pa.bool_()))

    return run


class Tree:
    """A node over neighbouring sets: OR-ed bitmap, range of sizes, tokens that share a bit with another at most."""

    __slots__ = ("bits", "kids", "least", "most", "shared", "items")

    def __init__(self, items: list[int], bits: list[int], sizes: list[int]) -> None:
        self.items, self.kids, self.bits = items, [], 0
        if len(items) > LEAF:
            step = -(-len(items) // FAN)
            self.kids = [Tree(items[i : i + step], bits, sizes) for i in range(0, len(items), step)]
            for k in self.kids:
                self.bits |= k.bits
            self.least, self.most, self.shared = min(k.least for k in self.kids), max(k.most for k in self.kids), max(k.shared for k in self.kids)
        else:
            for i in items:
                self.bits |= bits[i]
            self.least, self.most = min(sizes[i] for i in items), max(sizes[i] for i in items)
            self.shared = max(sizes[i] - bits[i].bit_count() for i in items)

    def may_link(self, other: Tree, num: int, den: int) -> bool:
        """Whether the greatest possible overlap of a set here and a set there can reach the threshold."""
        if self.most * den < other.least * num or other.most * den < self.least * num:
            return False
        overlap = min(self.most, other.most, (self.bits & other.bits).bit_count() + min(self.shared, other.shared))
        return (num + den) * overlap >= num * (self.least + other.least)


def neighbours(sizes: list[int], least: list[int], num: int, den: int) -> list[int]:
    """An order for the leaves: sizes that may link, then the least token, which copies mostly share."""
    return sorted(range(len(sizes)), key=lambda i: (int(np.log(max(1, sizes[i])) / np.log(den / num)), least[i], sizes[i]))


def leaf_pairs(root: Tree, num: int, den: int) -> Iterator[tuple[list[int], list[int], bool]]:
    """The dual traversal: items of two leaves (or twice of one) whose sets may reach the threshold."""
    todo = [(root, root)]
    while todo:
        x, y = todo.pop()
        if not x.may_link(y, num, den):
            continue
        if not x.kids and not y.kids:
            yield x.items, y.items, x is y
        elif x is y:
            todo += [(a, b) for n, a in enumerate(x.kids) for b in x.kids[n:]]
        else:
            todo += [(a, b) for a in (x.kids or [x]) for b in (y.kids or [y])]


def possible(sizes: list[int], maps: list[bytes], num: int, den: int) -> list[bool]:
    """Of each set of a subtree, whether another one's bitmap and size leave an overlap that reaches the threshold."""
    width = min(map(len, maps))
    folded = [np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0).tobytes() for m in maps]
    bits = [int.from_bytes(f, "big") for f in folded]
    free = [n - b.bit_count() for n, b in zip(sizes, bits, strict=True)]
    live = [False] * len(sizes)
    for xs, ys, same in leaf_pairs(Tree(neighbours(sizes, bits, num, den), bits, sizes), num, den):
        for i in xs:
            for j in ys:
                if (same and i >= j) or (live[i] and live[j]) or sizes[i] * den < sizes[j] * num or sizes[j] * den < sizes[i] * num:
                    continue
                overlap = min(free[i], free[j]) + (bits[i] & bits[j]).bit_count()
                if (num + den) * overlap >= num * (sizes[i] + sizes[j]):
                    live[i] = live[j] = True
    return live


def _live(num: int, den: int):
    """Rows of subtrees, in order of ``key`` -> the rows that have a possible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, list] = ([], [])

        def close() -> None:
            for row, on in zip(held, possible([r[2] for r in held], [r[3] for r in held], num, den), strict=True):
                if on:
                    out[0].append(row[0])
                    out[1].append(row[1])

        for batch in pieces(batches, "bits"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n", "bits")), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "node"])
            out = ([], [])
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "node"])

    return run


def traversed(members: DataFrame, keyed: DataFrame, num: int, den: int) -> DataFrame:
    """``key, m, node`` without the nodes that have no possible partner at that key."""
    maps = keyed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    rows = members.filter(F.col("m") <= TRAVERSED).join(maps, "node").select("key", "node", "n", "bits")
    live = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_live(num, den), "key long, node long")
    live = stash(live.unionByName(members.filter(F.col("m") > TRAVERSED).select("key", "node")), "jaccard-live")
    sizes = live.groupBy("key").agg(F.count("*").alias("m"))
    out = stash(live.join(sizes, "key").select("key", "m", "node"), "jaccard-traversed")
    discard(live)
    return out


def tree_join(payloads: list[bytes], comps: list[str | None], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links by position that connect what all links connect."""
    raw = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes = [len(r) for r in raw]
    width = wide_enough(max(sizes), SPREAD, LEAST_BITS, MOST_BITS)
    bits = [int.from_bytes(bitmap(r, width).tobytes(), "big") for r in raw]
    free = [n - b.bit_count() for n, b in zip(sizes, bits, strict=True)]
    union = Linker(comps)
    for xs, ys, same in leaf_pairs(Tree(neighbours(sizes, [int(r[0]) if len(r) else 0 for r in raw], num, den), bits, sizes), num, den):
        for i in xs:
            for j in ys:
                if (same and i >= j) or 0 in (sizes[i], sizes[j]) or union.find(i) == union.find(j):
                    continue
                if (num + den) * (min(free[i], free[j]) + (bits[i] & bits[j]).bit_count()) < num * (sizes[i] + sizes[j]):
                    continue
                a, b = (raw[i], raw[j]) if sizes[i] < sizes[j] else (raw[j], raw[i])
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if den * both >= num * (sizes[i] + sizes[j] - both):
                    union.join(i, j)
                    yield i, j


def _link(num: int, den: int):
    def link(items: list[tuple]) -> Iterator[tuple[str, str]]:
        for i, j in tree_join([x[2] for x in items], [x[1] for x in items], num, den):
            yield items[i][0], items[j][0]

    return link


def join(docs: DataFrame, *, width=3, num=90, den=100, lower=True, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, n_shingles, component_id`` of every row; sets link when ``den * overlap >= num * union``.

    ``component_id`` is the smallest id that links reach from the row, itself included.  Null and
    empty texts have no shingles and link with nothing, so their component are themselves.  Rows with
    equal sets link, repeated rows too.  Null ids come out as they went in and never name a
    component that has another id.  An empty table gives no rows; other columns are ignored.
    Equality of sets is by two 64-bit sums of hashes, overlap by 64-bit hashes of shingles.
    """
    found = _joined(docs, width, num, den, lower, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _joined(docs: DataFrame, width: int, num: int, den: int, lower: bool, id_col: str, text_col: str) -> DataFrame:
    """``id, th, n, component`` of every row, ``th`` being a hash of its text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    told = stash(base.mapInArrow(_profile(width, lower), "id long, th long, n long, s1 long, s2 long, block int, counts binary"), "jaccard-profiles")
    seen = told.filter("block is null").select("id", "th", "n", "s1", "s2")
    weights = token_weights(told.filter("block is not null").select("block", "counts"))
    keyed = stash(base.select("text").mapInArrow(_signatures(width, lower, num, den, weights), "node long, keys array<long>, n long, bits binary"), "jaccard-signatures")
    shared = shared_members(keyed.select(F.explode("keys").alias("key"), "node"))
    members = traversed(shared, keyed, num, den)
    discard(keyed, shared)

    node = F.concat_ws("-", F.hex("s1"), F.hex("s2"), F.col("n")).alias("node")
    classes = stash(seen.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "th")).alias("some"), F.min("id").alias("least")), "jaccard-classes")
    active = stash(classes.join(members.select(F.col("node").alias("s1")).distinct(), "s1").select(F.col("some.id").alias("wid"), F.col("some.th").alias("wth"), "s1", "s2", "n"), "jaccard-active")
    wanted = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("text", "s1", "s2", "n")
    payloads = texts.mapInArrow(_payloads(width, lower), "s1 long, s2 long, n long, payload binary").groupBy("s1", "s2", "n").agg(F.first("payload").alias("payload"))
    payloads = stash(payloads.select(node, "payload"), "jaccard-sets")
    named = stash(members.withColumnRenamed("node", "s1").join(active.select("s1", node), "s1").select("key", "m", "node"), "jaccard-members")
    discard(members, active)
    links = verified_links(named, payloads, _link(num, den))
    discard(named, payloads)

    found = components(links)
    least = stash(classes.select(node, "least").join(found, "node").groupBy("root").agg(F.min("least").alias("component")), "jaccard-least")
    moved = stash(found.join(least, "root").select("node", "component"), "jaccard-moved")
    labels = classes.select("s1", "s2", "n", "least", node).join(moved, "node", "left").select("s1", "s2", "n", F.coalesce("component", "least").alias("component"))
    labels = stash(labels, "jaccard-labels")
    discard(links, found, least, moved, classes)
    whole = seen.filter("n > 0").join(labels, ["s1", "s2", "n"]).select("id", "th", "n", "component")
    alone = seen.filter("n = 0").select("id", "th", "n", F.col("id").alias("component"))
    return whole.unionByName(alone)


def keep_one(docs: DataFrame, *, width=5, num=80, den=100, lower=True, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all columns: one document of each group of near duplicates.

    Documents without words stay, null and empty texts among them, and so do rows without an id unless they are like one
    that has an id.  Of rows with one id only the one with the least hash of its text stays (of equal rows any one).
    An empty table stays empty; columns may have any names.
    """
    winner, win_th, twice, gid, th, row = unused(docs, "winner", "win_th", "twice", "gid", "th", "row")
    found = stash(_joined(docs, width, num, den, lower, id_col, text_col), "jaccard-found")
    winners = found.filter(F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias(winner), F.col("th").alias(win_th)).distinct()
    kept = docs.join(winners, F.col(id_col).eqNullSafe(F.col(winner)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(win_th)), "left_semi")
    again = stash(found.filter("id is not null").groupBy(F.col("id").alias(twice)).agg(F.count("*").alias("times")).filter("times > 1").select(twice), "jaccard-twice")
    if again.isEmpty():
        return kept
    hashed = F.struct(F.xxhash64(text_col).alias(th), *[F.col(c) for c in docs.columns])
    one = kept.join(again, F.col(id_col) == F.col(twice), "left_semi").groupBy(F.col(id_col).alias(gid)).agg(F.min(hashed).alias(row))
    return kept.join(again, F.col(id_col) == F.col(twice), "left_anti").unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
