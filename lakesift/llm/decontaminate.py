"""Benchmark decontamination by SimHash of item-sized windows.

Every window of a text that has as many words as a benchmark item and holds one of the items' shingles
gets a 64-bit SimHash (a window without any cannot be like an item).  Windows meet items of
their size in a multi-index of Hamming blocks: RADIUS + 1 blocks of bits, of which fingerprints
within RADIUS bits must agree on one.  Pairs within the radius are then compared by their whole
shingles, weighted by length.  Fingerprints count shingles alike, so a pair of similarity 0.8 is within the radius with
a probability only, of more than 0.99 (tests measure it).  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import BLANKS, stash, unused

WIDTH = 5
RADIUS = 19
#: Bits added up side by side in a long, and the count at which they would run into each other.
NARROW, WIDE = 4, 2
OVERFLOW = (1 << 16) - 1


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, BLANKS), lambda w: w != "")


def _at_each(w: Column, made) -> Column:
    """``made`` of the WIDTH words at each place; of all words where there are fewer, but some."""
    many = F.size(w)
    each = F.transform(F.sequence(F.lit(1), many - (WIDTH - 1)), lambda i: made(F.slice(w, i, WIDTH)))
    return F.when(many >= WIDTH, each).when(many > 0, F.array(made(w))).otherwise(F.filter(F.array(made(w)), lambda _: F.lit(False)))


def _hash_of(n: int):
    return lambda i: F.xxhash64(F.slice("w", i, n))


def shingles(w: Column) -> Column:
    return _at_each(w, F.xxhash64)


def weights(w: Column) -> Column:
    """A shingle weighs as many as its words' characters."""
    return _at_each(w, lambda s: F.char_length(F.array_join(s, "")).cast("long"))


def simhash(hashes: Column) -> Column:
    """Sign of each bit's majority.  A long adds up four bits, 16 bits apart; of very long texts two, 32 bits apart."""
    return F.when(F.size(hashes) <= OVERFLOW, _majority(hashes, NARROW)).otherwise(_majority(hashes, WIDE))


def _majority(hashes: Column, bits: int) -> Column:
    apart = 64 // bits
    spread = F.array(*[F.lit(sum((v >> j & 1) << (apart * j) for j in range(bits))).cast("long") for v in range(1 << bits)])
    out = F.lit(0).cast("long")
    for lane in range(64 // bits):
        total = F.aggregate(hashes, F.lit(0).cast("long"), _adder(spread, lane, bits))
        for j in range(bits):
            count = F.shiftrightunsigned(total, apart * j).bitwiseAND(F.lit((1 << apart) - 1))
            out = out.bitwiseOR(F.when(count * 2 > F.size(hashes), F.shiftleft(F.lit(1).cast("long"), bits * lane + j)).otherwise(F.lit(0).cast("long")))
    return out


def _adder(spread: Column, lane: int, bits: int):
    return lambda a, h: a + F.element_at(spread, (F.shiftrightunsigned(h, bits * lane).bitwiseAND(F.lit((1 << bits) - 1)) + 1).cast("int"))


def blocks(print_: Column, size: Column) -> Column:
    """Keys of the multi-index: size, block number and the block's bits."""
    cuts = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]
    one = [(size.cast("long") * (RADIUS + 1) + b) * 16 + F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for b, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.explode(F.array(*one))


def similarity(a: Column, a_weights: Column, b: Column, b_weights: Column) -> Column:
    """Weighted Jaccard of bags of shingles; a shingle's weight goes with its hash.

    Where neither side repeats a shingle, looking each up in the other side is enough; else repeats are counted.
    """
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, w: s + w)
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    in_both = total(F.zip_with(a, a_weights, lambda h, w: F.when(F.array_contains(b, h), w).otherwise(F.lit(0).cast("long"))))
    pairs = F.array_distinct(F.zip_with(a, a_weights, lambda h, w: F.struct(h.alias("h"), w.alias("w"))))
    repeats = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["w"] * F.least(count(a, x["h"]), count(b, x["h"])))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    shared = F.when(plain, in_both).otherwise(repeats)
    # the sum is worked out once, as the element of an array
    return F.transform(F.array(shared), lambda s: s / (total(a_weights) + total(b_weights) - s))[0]


def matches(docs: DataFrame, benchmark: DataFrame, *, least=0.8, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``<id_col>, <item_col>, window_start, window_words, distance, similarity``: one row per text and item found in it.

    A window is as many consecutive words as the item has, or the whole text where that is shorter; the row tells
    the best one, the first of several.  Words are lower-cased (A-Z).  Items of fewer than
    five words have one shingle, all of their words, and windows of as many words are found if equal.  Null and empty ones match nothing; repeated rows count once;
    rows with one id but different texts are matched each.  Empty tables give no rows; other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("w"))
    items = items.select("item", F.size("w").alias("size"), shingles(F.col("w")).alias("h"), weights(F.col("w")).alias("v")).filter("size > 0")
    items = stash(items.withColumn("print", simhash(F.col("h"))), "bench-items")
    short = sorted(r["size"] for r in items.filter(F.col("size") < WIDTH).select("size").distinct().collect())  # four sizes at most
    known = stash(items.select(F.explode("h").alias("h"), "size").distinct(), "bench-shingles")

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # words become a column before they are used many times, so that they are split once
    told = base.select("id", "th", words(F.col("text")).alias("w")).select("id", "th", F.posexplode(shingles(F.col("w"))).alias("pos", "h"))
    hits = told.join(known, "h").groupBy("id", "th", "size").agg(F.collect_set("pos").alias("places"))
    hits = stash(hits, "bench-hits")
    # the few texts that have any, once each
    wanted = hits.select(F.col("id").alias("wid"), F.col("th").alias("wth")).distinct()
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")), "left_semi").dropDuplicates(["id", "th"])
    texts = texts.select("id", "th", words(F.col("text")).alias("w")).select("id", "th", F.size("w").alias("n"), shingles(F.col("w")).alias("h"), weights(F.col("w")).alias("v"))
    texts = stash(texts, "bench-texts")

    key = lambda df: df.select(*[F.col(c).alias(f"r_{c}") if c in ("id", "th") else F.col(c) for c in df.columns])
    same = lambda: F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th"))
    span = F.greatest(F.lit(1), F.least("size", "n") - (WIDTH - 1))
    last = F.greatest(F.lit(0), F.col("n") - F.col("size"))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(F.lit(0), F.least(last, p - span + 1)), F.least(last, p)))))
    windows = hits.join(key(texts), same()).select("id", "th", "size", "n", "h", F.explode(starts).alias("start"), span.alias("span"))
    windows = windows.select("id", "th", "size", "start", "span", F.slice("h", F.col("start") + 1, F.col("span")).alias("wh"))
    windows = windows.select("id", "th", "size", "start", "span", simhash(F.col("wh")).alias("print"))
    windows = stash(windows, "bench-windows")

    left = windows.select("*", blocks(F.col("print"), F.col("size")).alias("block"))
    right = items.select("item", F.col("print").alias("item_print"), blocks(F.col("print"), F.col("size")).alias("block"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = left.join(right, "block").withColumn("distance", distance).filter(F.col("distance") <= RADIUS)
    near = stash(near.select("id", "th", "size", "start", "span", "item", "distance").distinct(), "bench-near")

    whole = items.select(F.col("item").alias("r_item"), F.col("size").alias("r_size"), F.col("h").alias("item_h"), F.col("v").alias("item_v"))
    # windows are cut out of their texts before items join, so that whole texts are not shuffled once for each window
    cut = lambda c: F.slice(c, F.col("start") + 1, F.col("span"))
    compared = near.join(key(texts), same()).select("id", "th", "item", "size", "start", "distance", F.least("size", "n").alias("window_words"), cut("h").alias("a"), cut("v").alias("av"))
    compared = compared.join(whole, F.col("item").eqNullSafe(F.col("r_item")) & (F.col("size") == F.col("r_size")))
    # an element of an array, so that the similarity is worked out once
    scored = F.array(similarity(F.col("a"), F.col("av"), F.col("item_h"), F.col("item_v")))
    compared = compared.select("id", "th", "item", "start", "distance", "window_words", F.explode(F.filter(scored, lambda x: x >= least)).alias("similarity"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), F.col("distance"), F.col("window_words")))
    found = compared.groupBy("id", "th", "item").agg(best.alias("b"))
    found = found.select("id", "item", (-F.col("b.back")).alias("window_start"), F.col("b.window_words").alias("window_words"), F.col("b.distance").alias("distance"), F.col("b.similarity").alias("similarity"), "th")
    for n in short:
        # in texts of five words or more; shorter ones are compared above
        each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), _hash_of(n))
        placed = base.select("id", "th", words(F.col("text")).alias("w")).filter(F.size("w") >= WIDTH).select("id", "th", F.posexplode(each).alias("pos", "h"))
        whole = items.filter(F.col("size") == n).select("item", F.col("h")[0].alias("h"))
        equal = placed.join(whole, "h").groupBy("id", "th", "item").agg(F.min("pos").alias("window_start"))
        found = found.unionByName(equal.select("id", "item", "window_start", F.lit(n).alias("window_words"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"), "th"))
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; of rows with one id (or without any) each is judged by its own text.
    Empty tables of either kind leave ``docs`` as it is.
    """
    bad_id, bad_th = unused(docs, "bad_id", "bad_th")
    bad = stash(matches(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col(id_col).alias(bad_id), F.col("th").alias(bad_th)).distinct(), "bench-bad")
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_col) == F.col(bad_th)), "left_anti")
