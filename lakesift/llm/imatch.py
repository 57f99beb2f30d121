"""Document fingerprints by I-Match.

Terms whose document frequency lies in a band make the lexicon.  A text's terms that are in the
lexicon, sorted and distinct, are hashed once for each of several randomised parts of the lexicon;
the hashes side by side are the fingerprint.  Parts keep from a half to a 256th of the lexicon, so some
hold but few terms of a text whatever its length: the share of equal hashes tells how much two texts
have in common.  Only DataFrame functions are used.

A text without any term in the band, one of a very large group of copies for instance, has the hashes of all its terms.

Membership is looked up in a table of one bit for each of SLOTS hash slots, which goes out with the tasks, so that no term has to be
shuffled back to its text: a term belongs if its three slots are all set by terms in the band.  Another term is taken for
one of n in the band with a chance of about ``(3 n / SLOTS) ** 3``: 3 in 10 million for 10,000 terms, 4 in 10,000 for 100,000.  The lexicon
is bounded: no more terms than distinct terms a document on average, divided by LOW.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import BLANKS, WORD, stash

#: The band: least and greatest share of all documents that hold a term (two documents at least).
LOW, HIGH = 0.001, 0.25
SLOTS, SHIFTS = 1 << 22, (0, 21, 42)
#: A part keeps terms whose own byte of their MD5 is under this (of 256).
KEEP = (128, 32, 8, 4, 4, 2, 2, 2, 1, 1, 1, 1)
EMPTY = "-" * 8
NOTHING = "-".join([EMPTY] * len(KEEP))
#: Rows that one bucket of neighbouring ids holds, about, and buckets at most.
ROWS, BUCKETS = 64, 1 << 16


def terms(text: Column) -> Column:
    """Distinct words (runs of anything but ASCII blanks)."""
    return F.filter(F.array_distinct(F.split(text, BLANKS)), lambda w: w != "")


def lexicon(texts: DataFrame) -> DataFrame:
    """``text`` rows -> ``term, df`` of the terms in the band; counts are over all rows."""
    total = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counts.filter((F.col("df") >= max(2, math.ceil(LOW * total))) & (F.col("df") <= max(2.0, HIGH * total)))


def membership(texts: DataFrame) -> Column:
    """Bits of the slots, 64 to an element: set where a term in the band has the slot.

    A scalar subquery: as a literal its megabytes would stand in every text that the driver keeps of the plan.
    """
    hashes = lexicon(texts).select(F.xxhash64("term").alias("h")).toArrow().column("h").to_numpy().view(np.uint64)
    found = np.zeros(SLOTS >> 6, np.uint64)
    for shift in SHIFTS:
        at = (hashes >> np.uint64(shift)) & np.uint64(SLOTS - 1)
        np.bitwise_or.at(found, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    return texts.sparkSession.createDataFrame(pa.table({"bits": pa.array([found.view(np.int64)], pa.list_(pa.int64()))})).scalar()


def is_member(bits: Column, h: Column) -> Column:
    """Whether the slots of a term's hash are set; the later ones are looked at only where the first is."""

    def is_set(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(SLOTS - 1))
        some = F.get(bits, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftright", some, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return is_set(SHIFTS[0]) & is_set(SHIFTS[1]) & is_set(SHIFTS[2])


def _under(at: int, most: str):
    return lambda x: F.substring(x["m"], at, 2) < most


def fingerprint(text: Column, bits: Column) -> Column:
    """Hashes of the parts, joined by '-'; EMPTY for a part that keeps none of the text's terms.

    ``bits`` is a column that holds the subquery (which may not stand in a higher-order function itself) and is named but once,
    as ``text`` is, so that the optimizer puts it in place and rows do not carry it.

    A text none of whose terms are in the lexicon has parts of all its terms, and one whose few terms no part keeps
    has their hash in every part.
    """
    once = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  as the element of an array it is worked out once
    digested = lambda t: F.array_sort(F.transform(t, lambda x: F.struct(x.alias("t"), F.md5(x).alias("m"))))

    def parts(k: Column) -> Column:
        out = []
        for i, most in enumerate(KEEP):
            own = F.filter(k, _under(7 + 2 * i, f"{most:02x}"))
            hashed = F.substring(F.md5(F.array_join(F.transform(own, lambda x: x["t"]), " ")), 1, 8)
            out.append(F.when(F.size(own) > 0, hashed).otherwise(F.lit(EMPTY)))
        whole = F.substring(F.md5(F.array_join(F.transform(k, lambda x: x["t"]), " ")), 1, 8)
        return once(F.concat_ws("-", *out), lambda p: F.when((p == NOTHING) & (F.size(k) > 0), F.concat_ws("-", *[whole] * len(KEEP))).otherwise(p))

    members = lambda k: once(bits, lambda b: F.filter(k, lambda t: is_member(b, F.xxhash64(t))))
    return once(terms(text), lambda k: once(members(k), lambda own: once(digested(F.when(F.size(own) > 0, own).otherwise(k)), parts)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those that stand for terms on either side; 1 for equal fingerprints."""
    pairs = [(F.substring(a, 9 * k + 1, 8), F.substring(b, 9 * k + 1, 8)) for k in range(len(KEEP))]
    some, same = F.lit(0), F.lit(0)
    for x, y in pairs:
        some += ((x != EMPTY) | (y != EMPTY)).cast("int")
        same += ((x != EMPTY) & (x == y)).cast("int")
    return F.when(a == b, F.lit(1.0)).when(some == 0, F.lit(0.0)).otherwise(same.cast("double") / some)


def in_buckets(rows: DataFrame) -> DataFrame:
    """``id, text`` -> with ``bucket, ghost``: neighbours by id share a bucket of about ROWS rows.

    The first row of each bucket (by descending id, null last, then a hash of the text) also comes as a ghost at the
    end of the bucket before, and that of the first bucket at the end of the last, so that whoever follows
    a row is in its bucket.  Buckets come from the ids' range, cut evenly, and each cut again evenly by
    its count; their table has at most BUCKETS rows and some, and is broadcast.
    """
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("last", F.col("id").isNull()).withColumn("key", F.coalesce("id", "th"))
    narrow = rows.select("last", "key")
    ranges = {r["last"]: r for r in narrow.groupBy("last").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n")).collect()}
    total = sum(r["n"] for r in ranges.values())
    each = max(ROWS, -(-2 * total // BUCKETS))
    # first cut: even steps of each kind's range
    coarse = F.lit(None).cast("long")
    for last, r in ranges.items():
        step = max(1, -(-(r["z"] - r["a"] + 1) // max(1, r["n"] // each)))
        # by decimals, since a range of hashes passes what a long holds
        coarse = F.when(F.col("last") == last, F.floor((F.col("key").cast("decimal(20,0)") - F.lit(r["a"])) / F.lit(step)).cast("long")).otherwise(coarse)
    cells = narrow.withColumn("coarse", coarse).groupBy("last", "coarse").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count("*").alias("n"))
    span = F.col("z").cast("decimal(20,0)") - F.col("a") + 1
    cells = stash(cells.select("last", "coarse", "a", F.greatest(F.lit(1), F.ceil(span / F.ceil(F.col("n") / each))).cast("decimal(20,0)").alias("step")), "imatch-cells")
    fine = F.floor((F.col("key").cast("decimal(20,0)") - F.col("a")) / F.col("step")).cast("long").alias("fine")
    placed = narrow.withColumn("coarse", coarse).join(F.broadcast(cells), ["last", "coarse"]).select("last", "coarse", fine, "key")
    heads = placed.groupBy("last", "coarse", "fine").agg(F.max("key").alias("head"))
    order = Window.orderBy("last", F.desc("head"))
    heads = stash(heads.select("*", F.row_number().over(order).cast("long").alias("bucket")), "imatch-buckets")
    many = heads.count()
    before = F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(F.lit(many))
    joined = rows.withColumn("coarse", coarse).join(F.broadcast(cells), ["last", "coarse"]).withColumn("fine", fine).join(F.broadcast(heads), ["last", "coarse", "fine"])
    both = F.array(F.struct("bucket", F.lit(False).alias("ghost")), F.struct(before.alias("bucket"), F.lit(True).alias("ghost")))
    copies = F.when(F.col("key") == F.col("head"), both).otherwise(F.array(F.struct("bucket", F.lit(False).alias("ghost"))))
    return joined.select("id", "text", "th", "last", "key", F.explode(copies).alias("at")).select("id", "text", "th", "last", "key", "at.bucket", "at.ghost")


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last ``n_chars // 2`` code points replaced by as many (or all) first ones of the next
    document, by descending id; after the last comes the first.  A null text is empty.  Null ids come
    last, by a hash of their texts, as do rows with one id among themselves; repeated rows follow each other.
    Texts without words have the fingerprint of no terms.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = membership(rows.select("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    order = Window.partitionBy("bucket").orderBy("ghost", "last", F.desc("key"), "th")
    told = (
        in_buckets(rows)
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("edited", F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", "text"), half)))
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .withColumn("bits", bits)
        .withColumn("fingerprint", fingerprint(F.col("text"), F.col("bits")))
        .drop("text", "bits", "next_text")
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .filter("not ghost")
        .withColumn("bits", bits)
        .withColumn("edited_fingerprint", fingerprint(F.col("edited"), F.col("bits")))
    )
    return told.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def fingerprints_sql() -> str:
    """The same as DuckDB SQL over ``documents`` (ids without nulls or ties)."""
    words = lambda t: f"list_distinct(regexp_extract_all({t}, '{WORD}'))"
    part = lambda i: f"case when len(list_filter(kept, lambda x: substr(md5(x), {7 + 2 * i}, 2) < '{KEEP[i]:02x}')) > 0 then substr(md5(array_to_string(list_filter(kept, lambda x: substr(md5(x), {7 + 2 * i}, 2) < '{KEEP[i]:02x}'), ' ')), 1, 8) else '{EMPTY}' end"
    made = "concat_ws('-', " + ", ".join(part(i) for i in range(len(KEEP))) + ")"
    whole = "concat_ws('-', " + ", ".join(["substr(md5(array_to_string(kept, ' ')), 1, 8)"] * len(KEEP)) + ")"
    cut = lambda f, k: f"substr({f}, {9 * k + 1}, 8)"
    some = lambda a, b: " + ".join(f"({cut(a, k)} <> '{EMPTY}' or {cut(b, k)} <> '{EMPTY}')::int" for k in range(len(KEEP)))
    same = lambda a, b: " + ".join(f"({cut(a, k)} <> '{EMPTY}' and {cut(a, k)} = {cut(b, k)})::int" for k in range(len(KEEP)))
    like = lambda a, b: f"case when {a} = {b} then 1.0::double when ({some(a, b)}) = 0 then 0.0::double else ({same(a, b)})::double / ({some(a, b)}) end"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
n as (
    select *, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as next_text,
           coalesce(lead(doc_id) over (order by doc_id desc), first_value(doc_id) over (order by doc_id desc)) as next_id
    from d
),
e as (select *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) as edited from n),
counts as (select term, count(*) as df from (select unnest({words('text')}) as term from d) group by term),
lexicon as (
    select term from counts
    where df >= greatest(2, ceil({LOW} * (select count(*) from d))) and df <= greatest(2.0, {HIGH} * (select count(*) from d))
),
texts as (select doc_id, 0 as side, {words('text')} as all_terms from e union all select doc_id, 1, {words('edited')} from e),
held as (
    select t.doc_id, t.side, list_sort(list(t.term)) as kept
    from (select doc_id, side, unnest(all_terms) as term from texts) t join lexicon l on l.term = t.term group by all
),
chosen as (
    select t.doc_id, t.side, coalesce(kept, list_sort(all_terms)) as kept
    from texts t left join held h on h.doc_id = t.doc_id and h.side = t.side
),
parts as (select *, {made} as parted from chosen),
prints as (
    select doc_id, side, case when parted = '{NOTHING}' and len(kept) > 0 then {whole} else parted end as print from parts
)
select e.doc_id, cast(e.n as bigint) as n_chars, sha256(e.edited) as edited_sha256, p.print as fingerprint, q.print as edited_fingerprint,
       {like('p.print', 'q.print')} as near_edited, {like('p.print', 'r.print')} as near_next
from e join prints p on p.doc_id = e.doc_id and p.side = 0 join prints q on q.doc_id = e.doc_id and q.side = 1 join prints r on r.doc_id = e.next_id and r.side = 0"""
