"""Substring dedup by super-k-mer partitioning.

A window is 20 consecutive words of one text; its minimiser is the least hash of the word 5-grams
inside.  Consecutive windows with one minimiser are a super-k-mer and travel as one packed string to
the minimiser's bucket.  Equal windows have equal minimisers, so a bucket knows all about its windows:
counting its packed strings finds whole repeats, and where a bucket holds several different
strings, sorting their windows finds the rest.  Minimisers that occur once in the corpus cannot
belong to a repeated window; their super-k-mers stay at home.  So do those of texts that are whole copies of
an earlier one, all of whose windows start earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesift.llm.common import discard, stash
from lakesift.llm.words import Texts, mix, pieces

GRAM = 5
#: Different strings, and their bytes, that one task sorts as a bucket; larger buckets are dealt out by their windows' digests.
BUCKET, BUCKET_BYTES = 4096, 4 << 20


def super_kmers(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each super-k-mer of the batch: its text, first window (word number in the batch), windows, minimiser."""
    empty = np.zeros(0, np.int64)
    span = width - GRAM + 1
    if span < 1:
        raise ValueError(f"windows of {width} words have no {GRAM}-gram")
    total = len(t.hash)
    if total < width:
        return empty, empty, empty, empty
    value = mix(t.shingles(GRAM), 41)
    # sliding minimum with its leftmost place, by doubling
    low, at, have = value, np.arange(total), 1
    while have < span:
        step = min(have, span - have)
        other, there = low[step:], at[step:]
        less = other < low[: len(other)]
        low, at = np.where(less, other, low[: len(other)]), np.where(less, there, at[: len(other)])
        have += step
    windows = total - width + 1
    at = at[:windows]
    owner = np.searchsorted(t.first, np.arange(windows), "right") - 1
    valid = np.arange(windows) + width <= t.first[owner + 1]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(begin)
    number = np.cumsum(begin) - 1
    counts = np.bincount(number[valid], minlength=len(starts))
    return owner[starts], starts, counts, value[at[starts]].view(np.int64)


def _minimisers(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            owner, _, _, minimiser = super_kmers(Texts(batch.column("text").to_pylist()), width)
            offsets = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(np.bincount(owner, minlength=batch.num_rows), out=offsets[1:])
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(minimiser, pa.int64()))], names=["id", "th", "minis"])
            yield out.filter(pa.array(np.diff(offsets) > 0))

    return run


def _digest(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _cut(width: int):
    """Super-k-mers of the wanted minimisers; the packed string, with one blank between words, comes with its first occurrence in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, wanted = batch.column("text").to_pylist(), batch.column("wanted").to_pylist()
            t = Texts(texts)
            owner, start, count, mini = super_kmers(t, width)
            sets = [set(w) for w in wanted]
            words: tuple[int, list[bytes]] = (-1, [])
            seen: set[bytes] = set()
            rows: list[list] = [[], [], [], [], [], [], []]
            for o, s, n, m in zip(owner.tolist(), start.tolist(), count.tolist(), mini.tolist(), strict=True):
                if m in sets[o]:
                    if words[0] != o:
                        words = (o, texts[o].encode("utf-8", "surrogatepass").split())
                    a = s - int(t.first[o])
                    packed = b" ".join(words[1][a : a + n + width - 1])
                    for c, v in zip(rows, (o, a, n, m, *_digest(packed), None if packed in seen else packed), strict=True):
                        c.append(v)
                    seen.add(packed)
            pick = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pick), batch.column("th").take(pick), *(pa.array(c, pa.int64()) for c in rows[1:6]), pa.array(rows[6], pa.binary())],
                names=["id", "th", "start", "n", "mini", "h1", "h2", "packed"],
            )

    return run


def _places(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The string and the first word of each window of a batch of packed strings."""
    counts = np.diff(t.first) - width + 1
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + t.first[owner]


def _repeats(rows: list[tuple], width: int) -> Iterator[tuple]:
    """``(id, th, first word, after the last)`` of each window of whole buckets whose words also start earlier in its bucket.

    Rows are ``(mini, id, th, start, packed)``, one for each different string, at its first place.
    """
    mini, ids, ths, starts, packed = zip(*rows, strict=True)
    t = Texts([p.decode("utf-8", "surrogatepass") for p in packed])
    owner, at = _places(t, width)
    begin, end = t.start[at], t.end[at + width - 1]
    h = t.hash_of(begin, end)
    bucket = np.array(mini, np.int64)[owner]
    last = np.array([i is None for i in ids])[owner]
    id_, th = np.array([i or 0 for i in ids], np.int64)[owner], np.array(ths, np.int64)[owner]
    start = np.array(starts, np.int64)[owner] + at - t.first[owner]
    order = np.lexsort((start, th, id_, last, h, bucket))
    same = (bucket[order][1:] == bucket[order][:-1]) & (h[order][1:] == h[order][:-1])
    firsts: dict[bytes, tuple] = {}
    for k in np.flatnonzero(same).tolist():
        if not k or not same[k - 1]:
            firsts = {t.data[begin[order[k]] : end[order[k]]]: _place(order[k], last, id_, th, start)}
        i = order[k + 1]
        # equal hashes are no proof: the words decide
        place = _place(i, last, id_, th, start)
        if firsts.setdefault(t.data[begin[i] : end[i]], place) != place:
            yield None if last[i] else int(id_[i]), int(th[i]), int(start[i]), int(start[i]) + width


def _place(i: int, *columns: np.ndarray) -> tuple:
    return tuple(c[i] for c in columns)


def _buckets(width: int):
    """Rows in order of ``mini`` -> ranges of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def ranges(rows: list[tuple]) -> pa.RecordBatch:
            found = list(zip(*_repeats(rows, width), strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["id", "th", "a", "b"])

        for batch in pieces(batches, "packed"):
            held += zip(*(batch.column(c).to_pylist() for c in ("mini", "id", "th", "start", "packed")), strict=True)
            # the last bucket may go on in the next batch
            whole = len(held)
            while whole and held[whole - 1][0] == held[-1][0]:
                whole -= 1
            if whole:
                yield ranges(held[:whole])
                held = held[whole:]
        if held:
            yield ranges(held)

    return run


def _windows(width: int):
    """Each window's digest and place, for strings of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "packed"):
            t = Texts([p.decode("utf-8", "surrogatepass") for p in batch.column("packed").to_pylist()])
            owner, at = _places(t, width)
            digests = np.array([_digest(t.data[a:b]) for a, b in zip(t.start[at].tolist(), t.end[at + width - 1].tolist(), strict=True)], np.int64).reshape(-1, 2)
            start = np.array(batch.column("start").to_pylist(), np.int64)[owner] + at - t.first[owner]
            pick = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), batch.column("id").take(pick), batch.column("th").take(pick), pa.array(start)], names=["w1", "w2", "id", "th", "start"])

    return run


def _results(width: int):
    """Words, removed words and the digest of what is left; a range that ends at -1 is the whole of a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                left = words
                if ranges and len(words) >= width:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        gone[r["a"]] += 1
                        gone[r["b"]] -= 1
                    left = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g] if all(r["b"] >= 0 for r in ranges) else []
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    return run


def whole_copies(base: DataFrame) -> DataFrame:
    """``id, th`` of the rows of ``id, text, th`` whose text is that of a smaller id (null last), told by 128 bits of hashes."""
    own = stash(base.filter("text is not null").select("id", "th", F.xxhash64(F.lit(1), "text").alias("th2")), "super-hashes")
    place = F.struct(F.col("id").isNull().alias("last"), "id")
    firsts = own.groupBy("th", "th2").agg(F.min(place).alias("first"), F.max(place).alias("end")).filter("first <> end").select("th", "th2", "first")
    copies = stash(own.join(firsts, ["th", "th2"]).filter(place != F.col("first")).select("id", "th").distinct(), "super-copies")
    discard(own)
    return copies


def dedup(docs: DataFrame, *, width=20, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, n_words, n_removed, kept_sha256`` of every row.

    A word goes if a window of ``width`` words that covers it has a word sequence that also starts earlier:
    in a smaller id (null last), or earlier in the same text.  Windows are judged on the input.  Null texts
    have no words; texts under ``width`` words lose nothing.  Rows with one id (or without any) but different texts
    are ordered by a hash of the text; repeated rows count as one and get equal results.  An empty table gives no rows;
    other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    is_row = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    copies = whole_copies(base)
    told = base.mapInArrow(_minimisers(width), "id long, th long, minis array<long>")
    told = stash(told.join(copies, is_row(told, copies), "left_anti"), "super-minimisers")
    shared = told.select(F.explode("minis").alias("mini")).groupBy("mini").agg(F.count("*").alias("times")).filter("times > 1").select("mini")
    shared = stash(shared, "super-shared")  # so that the join's sides are plain shuffles, which adaptive execution splits where a minimiser is hot
    wanted = told.select("id", "th", F.explode("minis").alias("mini")).join(shared, "mini").groupBy(F.col("id").alias("wid"), F.col("th").alias("wth")).agg(F.collect_set("mini").alias("wanted"))
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("id", "th", "text", "wanted")
    cut = stash(texts.mapInArrow(_cut(width), "id long, th long, start long, n long, mini long, h1 long, h2 long, packed binary"), "super-cut")
    discard(told, shared)

    # each different string at its first place, in its minimiser's bucket
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "start")
    strings = cut.groupBy("mini", "h1", "h2").agg(F.min(place).alias("at"), F.max(place).alias("end"), F.first("packed", ignorenulls=True).alias("packed"))
    strings = stash(strings.select("mini", "h1", "h2", "at.id", "at.th", "at.start", "at", (F.col("at") != F.col("end")).alias("again"), "packed"), "super-strings")
    buckets = strings.groupBy("mini").agg(F.count("*").alias("strings"), F.sum(F.octet_length("packed")).alias("bytes")).filter("strings > 1")
    buckets = stash(buckets.select("mini", ((F.col("strings") > BUCKET) | (F.col("bytes") > BUCKET_BYTES)).alias("large")), "super-buckets")
    ranged = "id long, th long, a long, b long"

    # whole strings that occur earlier
    twice = strings.filter("again").select("mini", "h1", "h2", F.col("at").alias("first"))
    again = cut.drop("packed").join(twice, ["mini", "h1", "h2"]).filter(place != F.col("first"))
    again = again.select("id", "th", F.col("start").alias("a"), (F.col("start") + F.col("n") + F.lit(width - 1)).alias("b"))
    # windows of different strings: the number keeps a bucket's rows together and in order
    number = F.row_number().over(Window.partitionBy("mini").orderBy("h1", "h2"))
    several = strings.select("mini", "h1", "h2", "id", "th", "start", "packed").join(buckets.filter("not large").select("mini"), "mini").withColumn("number", number).filter("number > 0")
    sorted_ = several.select("mini", "id", "th", "start", "packed").mapInArrow(_buckets(width), ranged)
    # and of buckets too large for a task
    windows = strings.select("mini", "id", "th", "start", "packed").join(buckets.filter("large").select("mini"), "mini").mapInArrow(_windows(width), "w1 long, w2 long, id long, th long, start long")
    windows = stash(windows, "super-windows")
    least = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("end")).filter("first <> end").select("w1", "w2", "first")
    later = windows.join(least, ["w1", "w2"]).filter(place != F.col("first"))
    later = later.select("id", "th", F.col("start").alias("a"), (F.col("start") + F.lit(width)).alias("b"))

    whole = copies.select("id", "th", F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    found = again.unionByName(sorted_).unionByName(later).unionByName(whole)
    ranges = stash(found.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "super-ranges")
    discard(copies, cut, strings, buckets, windows)
    judged = base.join(ranges, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left").select("id", "text", "ranges")
    return judged.mapInArrow(_results(width), "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
