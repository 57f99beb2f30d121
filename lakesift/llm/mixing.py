"""Mixing sources to target weights by entropy balancing.

Each document gets a rate; each source's rates keep as near to 1 (in relative entropy) as its token
constraint allows.  The dual of that problem is convex with one multiplier per source, and its
solution tilts rates exponentially in a document's tokens: ``rate = min(cap, exp(lambda_s * x))`` with
``x = tokens / mean tokens of the source``.  Newton's steps on the dual run as aggregates over a
histogram of (source, size), which is exact since documents of one source and size share a rate.
Rates become whole copies by systematic rounding in order of size, so that a source's error stays
within a few documents whatever its size; a few copies more or less then bring it to its target as near
as exchanges of one or two documents can.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import discard, source_key, stash, unused, word_count

#: Newton's steps at most; it is an error if the worst source is not within ENOUGH of its target by then.
MAX_STEPS = 80
TOLERANCE, ENOUGH = 1e-9, 1e-6
#: Starting points tried for each source's systematic rounding; the one that comes nearest is used.
OFFSETS = 32
#: Exchanges of copies that a source gets, and the relative miss that needs none; pairs are tried for sources of up to so many sizes.
EXCHANGES, NEAR, PAIRED = 8, 1e-4, 64
#: Rows of one (source, size) that one task ranks, at most about.
RANKED = 4096


def source_targets(sources: DataFrame, cycle=(5.0, 2.0, 1.0), share=1.5, cap=2.0) -> DataFrame:
    """``skey, source_size`` -> with ``target``: ``share`` of all tokens dealt out by weight.

    Weights repeat ``cycle`` in the order of ``skey``.  A target stops at ``cap`` times its source's
    size and the rest goes to the others by weight (water filling).  One row per source meets in one
    task here, never more.
    """
    everything = Window.orderBy("skey")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), ((F.row_number().over(everything) - 1) % len(cycle) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "skey")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("spent", F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
        .withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("theta", (F.col("budget") - F.col("spent")) / F.col("left_w"))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("full", F.col("theta") >= F.col("ratio"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("pos", "theta"))).over(whole)["theta"])
    )
    return s.select("skey", "source_size", "n_docs", F.when(F.col("full"), F.col("most")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _rate(cap: float):
    """Rate of a document from its source's multiplier (null: all or nothing, in ``fixed``)."""
    return F.coalesce(F.col("fixed"), F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("size") / F.col("mean")))))


def balance(histogram: DataFrame, targets: DataFrame, cap=2.0) -> DataFrame:
    """Solve the dual: ``skey, size, cnt`` and targets -> ``skey, lam, mean, fixed``.

    Newton's step, held inside a bracket that each step narrows.  Sources whose target is nothing or
    all that the cap allows have no finite multiplier and get ``fixed`` rates.
    """
    mean = F.col("source_size") / F.col("n_docs")
    state = targets.select(
        "skey", "target", mean.alias("mean"),
        F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(float(cap))).alias("fixed"),
        F.lit(0.0).alias("lam"),
        F.when(F.col("target") < F.col("source_size"), F.lit(-1e6)).otherwise(F.lit(0.0)).alias("lo"),
        F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(math.log(cap) * mean).alias("hi"),
    )
    state = stash(state, "mix-state")
    x = F.col("size") / F.col("mean")
    for _ in range(MAX_STEPS):
        rate = _rate(cap)
        sums = (
            histogram.join(state.filter(F.col("fixed").isNull()), "skey")
            .groupBy("skey")
            .agg(F.sum(F.col("cnt") * x * rate).alias("got"), F.sum(F.when(rate < cap, F.col("cnt") * x * x * rate).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target") / F.col("mean")
        s = state.join(sums, "skey", "left").withColumn("gap", gap)
        s = s.withColumn("lo", F.when(F.col("gap") < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("gap") > 0, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("gap") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        off = F.abs(F.col("gap")) * F.col("mean") / F.col("target")
        s = s.select("skey", "target", "mean", "fixed", F.when(F.coalesce(off, F.lit(0.0)) <= TOLERANCE, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi", off.alias("off"))
        before, state = state, stash(s, "mix-state")
        discard(before)
        # one number comes back: the worst source's relative gap
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    else:
        if worst > ENOUGH:
            raise RuntimeError(f"the dual is {worst:.1e} off after {MAX_STEPS} steps")
    return state.select("skey", "lam", "mean", "fixed")


def rounded(rated: DataFrame) -> DataFrame:
    """``skey, size, cnt, target, whole, before, upto`` -> ``skey, size, cnt, target, total``: whole copies of each cell by systematic rounding."""
    tries = F.explode(F.array(*[F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)])).alias("u")
    total = (F.col("cnt") * F.col("whole") + F.floor(F.col("upto") + F.col("u")) - F.floor(F.col("before") + F.col("u"))).cast("long")
    offset = (
        rated.filter("size > 0").select("*", tries)
        .groupBy("skey", "u").agg(F.sum(F.col("size") * total).alias("got"), F.first("target").alias("target"))
        .groupBy("skey").agg(F.min_by("u", F.struct(F.abs(F.col("got") - F.col("target")), F.col("u"))).alias("u"))
    )
    return rated.join(offset, "skey", "left").withColumn("u", F.coalesce("u", F.lit(0.5))).select("skey", "size", "cnt", "target", total.alias("total"))


def exchanged(cells: DataFrame, cap=2.0) -> DataFrame:
    """``rounded`` cells with a few copies more or fewer, so that each source comes as near to its target as exchanges bring it.

    In each round a source that is off takes the move that leaves the least: a copy more or less of one document or, where it
    has few sizes, of two (a copy for a copy among them).  Moves and sums are by source; texts and rows take no part.
    """
    most = int(cap)
    for _ in range(EXCHANGES):
        off = cells.groupBy("skey").agg((F.first("target") - F.sum(F.col("size") * F.col("total"))).alias("off"), F.first("target").alias("t"), F.count("*").alias("sizes"))
        off = off.filter(F.abs("off") > NEAR * F.col("t"))
        steps = F.explode(F.filter(F.array(*[F.struct(F.lit(k).cast("long").alias("step"), possible.alias("ok")) for k, possible in ((1, F.col("total") < most * F.col("cnt")), (-1, F.col("total") > 0))]), lambda x: x["ok"]))
        moves = cells.filter("size > 0").join(off, "skey").select("skey", "off", "sizes", "size", steps.alias("move")).select("skey", "off", "sizes", "size", "move.step")
        one = moves.select("skey", "off", F.array(F.struct("size", "step")).alias("moves"), (F.col("size") * F.col("step")).alias("gain"))
        few = moves.filter(F.col("sizes") <= PAIRED)
        other = few.select("skey", F.col("size").alias("size2"), F.col("step").alias("step2"))
        two = few.join(other, "skey").filter("size < size2").select("skey", "off", F.array(F.struct("size", "step"), F.struct(F.col("size2").alias("size"), F.col("step2").alias("step"))).alias("moves"), (F.col("size") * F.col("step") + F.col("size2") * F.col("step2")).alias("gain"))
        left = F.abs(F.col("off") - F.col("gain"))
        best = one.unionByName(two).filter(left < F.abs("off")).groupBy("skey").agg(F.min_by("moves", F.struct(left, F.size("moves"), F.col("gain"), F.col("moves"))).alias("moves"))
        best = stash(best.select("skey", F.explode("moves").alias("m")).select("skey", "m.size", "m.step"), "mix-moves")
        if best.isEmpty():
            discard(best)
            break
        after = stash(cells.join(best, ["skey", "size"], "left").select("skey", "size", "cnt", "target", (F.col("total") + F.coalesce("step", F.lit(0))).alias("total")), "mix-copies")
        discard(best, cells)
        cells = after
    return cells


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    """A row's id, source, key of its source, size and hash, as columns."""
    size = F.coalesce(word_count(F.col(text_col)), F.lit(0)).cast("long")
    return [F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("skey"), size.alias("size"), F.xxhash64(F.col(id_col), size).alias("h")]


def _dealt(rows: DataFrame, sized: DataFrame, cycle, share, cap) -> DataFrame:
    """``rows`` (with ``sized``'s columns) -> with ``source_size, target, rate, copies``."""
    cells = stash(sized.groupBy("skey", "size").agg(F.count("*").alias("cnt")), "mix-cells")
    sources = cells.groupBy("skey").agg(F.sum(F.col("size") * F.col("cnt")).cast("long").alias("source_size"), F.sum("cnt").alias("n_docs"))
    targets = stash(source_targets(sources, cycle, share, cap), "mix-targets")
    solved = balance(cells.filter("size > 0"), targets, cap)

    # systematic rounding: a running sum of the fractions by size; where it passes a whole number, one copy more
    by_size = Window.partitionBy("skey").orderBy("size")
    rated = (
        cells.join(solved, "skey").join(targets, "skey")
        .withColumn("rate", _rate(cap))
        .withColumn("whole", F.floor("rate"))
        .withColumn("upto", F.sum(F.col("cnt") * (F.col("rate") - F.col("whole"))).over(by_size))
        .withColumn("before", F.coalesce(F.lag("upto").over(by_size), F.lit(0.0)))
    )
    rated = stash(rated.select("skey", "size", "cnt", "source_size", "target", "rate", "whole", "before", "upto"), "mix-rated")
    totals = exchanged(stash(rounded(rated), "mix-copies"), cap)

    # which rows of a (source, size) get the odd copies: ranked by hash, in parts that stay small however many alike there are
    parts = 1 << max(0, math.ceil(math.log2(max(1, sized.count() / RANKED))))
    part = F.pmod(F.col("h"), F.lit(parts)).alias("part")
    keys = ["skey", "size", "part"]
    ahead = Window.partitionBy("skey", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = sized.select("skey", "size", part).groupBy(*keys).agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    dealt = dealt.join(rated.select("skey", "size", "source_size", "target", "rate"), ["skey", "size"]).join(totals.select("skey", "size", "cnt", "total"), ["skey", "size"])
    ranked = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "id")))
    odd = (F.col("ahead") + F.col("rank") <= F.col("total") % F.col("cnt")).cast("long")
    return ranked.join(dealt, keys).withColumn("copies", F.expr("total div cnt") + odd)


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", cycle=(5.0, 2.0, 1.0), share=1.5, cap=2.0) -> DataFrame:
    """Copies of each document so that sources meet their targets.

    Returns ``<id_col>, source, size, source_size, target, rate, copies, taken``; one row per input
    row.  A null text has size 0; a null source is a source of its own, last in order; repeated rows
    count as often as they occur; of rows alike in all but their order either may get the odd copy.
    Documents of size 0 keep one copy unless their source's target is all or nothing.  An empty table
    gives no rows.  Other columns of ``docs`` are ignored, whatever their names.
    """
    sized = stash(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-docs")
    return _dealt(sized, sized, cycle, share, cap).select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", cycle=(5.0, 2.0, 1.0), share=1.5, cap=2.0) -> DataFrame:
    """``docs`` as mixed: each row as often as ``mix`` gives it copies, with ``copy`` from 1 and its ``rate``.

    Rows without copies go; each of several repeated rows has copies of its own, so that sources come out as in ``mix``.
    Null texts have size 0 and null sources are one; an empty table stays empty.  Where ``docs`` has a column
    ``rate`` or ``copy``, the new one has an underscore behind its name.
    """
    rate, copy = unused(docs, "rate", "copy")
    own = _sized(docs, id_col, text_col, source_col)
    sized = stash(docs.select(*own), "mix-docs")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *own).drop("source")
    dealt = _dealt(rows, sized, cycle, share, cap).filter("copies > 0")
    return dealt.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("rate").alias(rate), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy))
