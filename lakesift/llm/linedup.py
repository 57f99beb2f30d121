"""Line dedup: a segment-partition edit join over all lines.

A line of l characters is split into threshold + 1 segments.  A line within the threshold of it, of l to
l + threshold characters, holds one of these segments unchanged and near its place, so longer
lines probe the substrings that can be it: the index is aware of length, segment number and
place.  Lines that share a key are candidates; banded bit-parallel edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.clusters import Linker, components, shared_members, verified_links
from lakesift.llm.common import discard, maybe_marked, stash, unused
from lakesift.llm.words import mix, pieces, powers

#: Shortest line for a threshold of so many edits; shorter lines than all have only exact copies.
LEAST_FOR = {1: 20, 2: 40}
BLANKS = " \t\n\r\x0b\x0c"


def threshold(chars: int) -> int:
    return max((k for k, least in LEAST_FOR.items() if chars >= least), default=0)


def lines_of(text: str | None) -> list[str]:
    """Lines without blanks around; null has none."""
    return [x.strip(BLANKS) for x in text.split("\n")] if text is not None else []


def line_hash(line: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def segment_keys(lines: list[str]) -> list[np.ndarray]:
    """Keys of each line, such that lines within the smaller of their thresholds have one in common."""
    n = np.array([len(x) for x in lines], np.int64)
    begin = np.zeros(len(lines) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    there, back = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points) * there[: len(points)], out=total[1:])
    begin = begin[:-1]
    who, keys = [], []
    lasts = sorted(LEAST_FOR)
    for k in lasts:
        least = LEAST_FOR[k]
        above = min((LEAST_FOR[j] for j in lasts if j > k), default=1 << 60)
        for delta in range(k + 1):
            target = n - delta
            rows = np.flatnonzero((target >= least) & (target < above))
            m = target[rows]
            base, longer = m // (k + 1), m % (k + 1)
            for i in range(1, k + 2):
                # the last `longer` segments have one character more
                more = np.maximum(0, i - 1 - (k + 1 - longer))
                place = (i - 1) * base + more
                length = base + (i > k + 1 - longer)
                for shift in range(max(1 - i, delta - (k + 1 - i)), min(i - 1, delta + (k + 1 - i)) + 1):
                    at = place + shift
                    ok = np.flatnonzero((at >= 0) & (at + length <= n[rows]))
                    a = begin[rows[ok]] + at[ok]
                    h = (total[a + length[ok]] - total[a]) * back[a]
                    who.append(rows[ok])
                    keys.append(mix(h + mix((m[ok] * 64 + i * 8 + k).astype(np.uint64), 31), 33))
    if not who or not len(lines):
        return [np.zeros(0, np.int64)] * len(lines)
    who, keys = np.concatenate(who), np.concatenate(keys).view(np.int64)
    order = np.argsort(who, kind="stable")
    return np.split(keys[order], np.cumsum(np.bincount(who, minlength=len(lines)))[:-1])


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: one word of 2k + 1 bits for each number of edits, along the diagonal."""
    if abs(len(a) - len(b)) > k:
        return False
    most, i = min(len(a), len(b)), 0
    while i < most and a[i] == b[i]:
        i += 1
    a, b, most, i = a[i:], b[i:], most - i, 0
    while i < most and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return max(len(a), len(b)) <= k
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + k)
    full = (1 << (2 * k + 1)) - 1
    # bit t of state[d]: after j of b, j + t - k of a are matched with d edits
    state = [1 << k]
    for _ in range(k):
        state.append((state[-1] | state[-1] << 1) & full)
    for j, c in enumerate(b):
        same = places.get(c, 0) >> j & full
        new = [state[0] & same]
        for d in range(1, k + 1):
            new.append(state[d] & same | state[d - 1] | state[d - 1] >> 1 | new[d - 1] << 1 & full)
        if not any(new):
            return False
        state = new
    return any(s >> (len(a) - len(b) + k) & 1 for s in state)


def edit_links(items: list[tuple]) -> Iterator[tuple[str, str]]:
    """Links between lines of a unit, in order of length so that only lines near in length are compared."""
    lines = sorted(((x[2].decode("utf-8", "surrogatepass"), x[0], x[1]) for x in items), key=lambda x: len(x[0]))
    union = Linker([x[2] for x in lines])
    limit = [threshold(len(x[0])) for x in lines]
    for j, (b, nb, _) in enumerate(lines):
        for i in range(j - 1, -1, -1):
            if len(b) - len(lines[i][0]) > limit[i]:
                if len(b) - len(lines[i][0]) > max(LEAST_FOR):
                    break
                continue
            if union.find(i) != union.find(j) and within(lines[i][0], b, limit[i]):
                union.join(i, j)
                yield lines[i][1], nb


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line that is not blank; a line's keys come with its first occurrence in the batch."""
    for batch in pieces(batches):
        row, pos, line_at, lines = [], [], [], {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            for p, line in enumerate(lines_of(text)):
                if line:
                    row.append(i)
                    pos.append(p)
                    line_at.append(lines.setdefault(line, len(lines)))
        at = np.array(line_at, np.int64)
        hashes = np.array([line_hash(x) for x in lines], np.int64).reshape(-1, 2)
        first = np.zeros(len(at), bool)
        first[np.unique(at, return_index=True)[1]] = True
        keys = segment_keys(list(lines))
        own = [keys[j] if f else keys[j][:0] for j, f in zip(line_at, first.tolist(), strict=True)]
        offsets = np.zeros(len(own) + 1, np.int32)
        np.cumsum([len(k) for k in own], out=offsets[1:])
        values = pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64())
        sizes = np.array([len(x) for x in lines], np.int64)
        owner = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(owner), batch.column("th").take(owner), pa.array(pos, pa.int64()), pa.array(hashes[at, 0]), pa.array(hashes[at, 1]), pa.array(sizes[at]), pa.ListArray.from_arrays(pa.array(offsets), values)],
            names=["id", "th", "pos", "h1", "h2", "n", "keys"],
        )


def _lines_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        out: list[list] = [[], []]
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = lines_of(text)
            for w in wanted:
                if w["pos"] < len(lines) and line_hash(lines[w["pos"]]) == (w["h1"], w["h2"]):
                    for c, v in zip(out, (w["node"], lines[w["pos"]].encode("utf-8", "surrogatepass")), strict=True):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary())], names=["node", "payload"])


def classes(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per line that is not blank: ``<id_col>, line_no, n_chars, first_id, first_line, class_lines, class_docs, repeated``.

    Lines are equal or within their thresholds' edits, directly or through others, when in one class;
    the class is named by its first line (smallest id, null last, then line number), and every other line of it
    is ``repeated``.  ``class_docs`` counts distinct ids.  Null, empty and blank texts give no rows, nor does an empty table.
    Of rows with one id (or without any) lines come in the order of a hash of their texts, so repeated rows repeat their lines' rows.
    Other columns are ignored.  A line's identity is its 128-bit hash; edit distance is taken on whole lines.
    """
    found = _classified(docs, id_col, text_col)
    names = {"id": id_col, "pos": "line_no", "n": "n_chars"}
    return found.drop("th", "first_th").withColumnsRenamed(names)


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, pos, n, first_id, first_line, class_lines, class_docs, repeated, first_th`` of every line, ``th`` being a hash of its text."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    seen = stash(base.mapInArrow(_occurrences, "id long, th long, pos long, h1 long, h2 long, n long, keys array<long>"), "lines")
    shared = shared_members(seen.select(F.explode("keys").alias("key"), F.col("h1").alias("node")))
    seen = seen.drop("keys")

    # one occurrence of each candidate line brings its text
    place = F.struct(F.col("id").isNull().alias("last"), "id", "th", "pos")
    node = F.concat_ws("-", F.hex("h1"), F.hex("h2"))
    nodes = shared.select(F.col("node").alias("h1")).distinct()
    active = maybe_marked(seen, "h1", nodes).join(nodes, "h1").groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("at"))
    active = stash(active.select("h1", "h2", "at", node.alias("node")), "lines-active")
    wanted = active.groupBy(F.col("at.id").alias("wid"), F.col("at.th").alias("wth")).agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), "h1", "h2", "node")).alias("wanted"))
    base = maybe_marked(base, "th", active.select("at.th").distinct())
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("text", "wanted")
    payloads = stash(texts.mapInArrow(_lines_wanted, "node string, payload binary").groupBy("node").agg(F.first("payload").alias("payload")), "lines-texts")
    named = stash(shared.withColumnRenamed("node", "h1").join(active.select("h1", "node"), "h1").select("key", "m", "node"), "lines-members")
    links = verified_links(named, payloads, edit_links)
    discard(shared, payloads, named)

    found = components(links)
    roots = active.select(F.col("node").alias("root"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    moved = stash(active.join(found, "node").join(roots, "root").select("h1", "h2", "c1", "c2"), "lines-moved")
    own = seen.join(moved, ["h1", "h2"], "left").select("id", "th", "pos", "n", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2"))
    own = stash(own, "lines-classes")
    discard(links, found, active, moved)
    per_doc = own.groupBy("c1", "c2", "id").agg(F.min(F.struct("th", "pos")).alias("at"), F.count("*").alias("lines"))
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("at.th").alias("th"), F.col("at.pos").alias("pos"))
    whole = per_doc.groupBy("c1", "c2").agg(F.min(first).alias("first"), F.sum("lines").alias("class_lines"), F.count("*").alias("class_docs")).filter("class_lines > 1")
    joined = own.join(stash(whole, "lines-firsts"), ["c1", "c2"], "left")
    first_id = F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id"))
    first_line, first_th = F.coalesce("first.pos", "pos"), F.coalesce("first.th", "th")
    return joined.select(
        "id", "th", "pos", "n", first_id.alias("first_id"), first_line.alias("first_line"),
        F.coalesce("class_lines", F.lit(1)).alias("class_lines"), F.coalesce("class_docs", F.lit(1)).alias("class_docs"),
        (~(first_id.eqNullSafe(F.col("id")) & (first_th == F.col("th")) & (first_line == F.col("pos")))).alias("repeated"), first_th.alias("first_th"),
    )


def whole_copies(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``copy_id, copy_th, copy_of`` of the rows whose text equals that of a smaller id (null last), by SHA-256; ``copy_th`` is a hash of the text."""
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("copy_id"), F.xxhash64(text).alias("copy_th"), F.sha2(text, 256).alias("digest")).filter("digest is not null")
    place = F.struct(F.col("copy_id").isNull().alias("last"), F.col("copy_id").alias("id"))
    firsts = own.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    copies = own.join(stash(firsts.select("digest", "first"), "lines-copied"), "digest").filter(~F.col("first.id").eqNullSafe(F.col("copy_id")))
    return copies.groupBy("copy_id", "copy_th").agg(F.min("first.id").alias("copy_of"))


def drop_lines(docs: DataFrame, *, min_docs=1, min_chars=20, id_col="doc_id", text_col="text", chars_col="n_chars") -> DataFrame:
    """``docs`` with repeated lines taken out of the texts: columns and rows stay, texts and lengths change.

    A line goes if its class occurs in ``min_docs`` documents or more, it has ``min_chars`` characters or more
    and is not the first of its class, however much of its document goes with it.  A text equal to that of a smaller id
    loses the lines that the smaller one loses, so that the two stay equal, for document-level deduplication to see.
    A text that holds nothing else ends empty.  Null and empty texts stay as they are, an empty table stays empty,
    of rows with one id (or without any) each loses its own lines, and repeated rows lose the same; columns may have any names.
    """
    gone_id, gone_th, gone_lines = unused(docs, "gone_id", "gone_th", "gone")
    lines = _classified(docs, id_col, text_col).filter((F.col("class_lines") > 1) & (F.col("class_docs") >= min_docs) & (F.col("n") >= min_chars))
    copies = stash(whole_copies(docs, id_col=id_col, text_col=text_col).withColumn("copy", F.lit(True)), "lines-copies")
    lines = lines.join(copies, F.col("id").eqNullSafe(F.col("copy_id")) & (F.col("th") == F.col("copy_th")), "left")
    stands_for = F.when(F.col("copy"), F.col("copy_of")).otherwise(F.col("id"))
    gone = lines.filter(~(F.col("first_id").eqNullSafe(stands_for) & (F.col("first_th") == F.col("th")) & (F.col("first_line") == F.col("pos"))))
    gone = stash(gone.groupBy(F.col("id").alias(gone_id), F.col("th").alias(gone_th)).agg(F.collect_set(F.col("pos").cast("int")).alias(gone_lines)), "lines-gone")
    discard(copies)
    text, some = F.col(text_col), F.col(gone_lines).isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(gone_lines), i)), "\n")
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text.cast("string")) == F.col(gone_th))
    joined = docs.join(gone, same, "left").withColumn(text_col, F.when(some, kept).otherwise(text))
    if chars_col in docs.columns:
        joined = joined.withColumn(chars_col, F.when(some, F.char_length(text).cast("long")).otherwise(F.col(chars_col)))
    return joined.select(*docs.columns)
