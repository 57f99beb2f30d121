"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in numpy, a batch at a time.  Trees are grown on the driver from a
bounded sample of labelled rows; they end up as flat arrays (feature, threshold, children, value) that
each Arrow batch walks level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesift.llm.words import Texts, pieces

#: Labelled rows to learn from, at most: those whose ids hash lowest.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 80, 5, 64, 0.15, 1.0, 10

_KIND = np.zeros(256, np.int64)  # 0: other
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4  # punctuation of prose
_KIND[[35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 5  # symbols
_KIND[[9, 10, 11, 12, 13, 32]] = 6
_KIND[128:] = 7

NAMES = (
    "log_words", "log_bytes", "word_mean", "word_std", "long_words", "short_words", "upper", "digits", "prose_marks", "symbols", "blanks", "non_ascii",
    "upper_start", "symbol_end", "no_letter", "distinct_words", "top_word", "distinct_trigrams", "log_lines", "line_mean", "repeated_lines", "bare_line_ends",
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(h: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the count of the commonest, of each row."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, owner[starts], runs)
    return np.bincount(owner[starts], minlength=rows).astype(float), most


def statistics(texts: list[str | None]) -> np.ndarray:
    """Rows of NAMES; null and empty texts have zeros (and one empty line)."""
    t, rows = Texts(texts), len(texts)
    data = t.bytes
    kind = _KIND[data]
    sizes = np.diff(t.bounds) - 1.0
    words = np.diff(t.first).astype(float)
    per_byte, per_word = np.maximum(sizes, 1), np.maximum(words, 1)
    counts = [_sums(kind == k, t.bounds) for k in range(8)]
    counts[6] = counts[6] - 1  # the newline that ends each text here
    length = (t.end - t.start).astype(float)
    total, squares = _sums(length, t.first), _sums(length * length, t.first)
    mean = total / per_word
    share = lambda x: _sums(x, t.first) / per_word
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum((kind == 1) | (kind == 2) | (kind == 7), out=letters[1:])
    owner = np.repeat(np.arange(rows), np.diff(t.first))
    distinct, top = _distinct(t.hash, owner, rows)
    grams = t.shingles(3)
    whole = np.arange(len(grams)) + 3 <= t.first[owner + 1] if len(grams) else np.zeros(0, bool)
    tri, _ = _distinct(grams[whole], owner[whole], rows)
    # lines: each ends at a newline of ours or the text's
    ends = np.flatnonzero(data == 10)
    begins = np.append(0, ends[:-1] + 1)
    line_owner = np.searchsorted(t.bounds, begins, "right") - 1
    lines = np.bincount(line_owner, minlength=rows).astype(float)
    unlike, _ = _distinct(t.hash_of(begins, ends), line_owner, rows)
    bare = np.bincount(line_owner, weights=(ends > begins) & (_KIND[data[np.maximum(ends - 1, 0)]] != 4), minlength=rows)
    return np.column_stack(
        [
            np.log1p(words), np.log1p(sizes), mean, np.sqrt(np.maximum(squares / per_word - mean * mean, 0)), share(length > 12), share(length < 3),
            counts[1] / per_byte, counts[3] / per_byte, counts[4] / per_byte, counts[5] / per_byte, counts[6] / per_byte, counts[7] / per_byte,
            share(kind[t.start] == 1), share(kind[t.end - 1] == 5), share(letters[t.end] == letters[t.start]), distinct / per_word, top / per_word,
            tri / np.maximum(words - 2, 1), np.log1p(lines), sizes / lines, 1 - unlike / lines, bare / lines,
        ]
    )


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out += self.value[at]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost on logistic loss; without both labels the score is their smoothed share."""
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        flat = binned + np.arange(x.shape[1]) * BINS
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            roots.append(len(nodes))
            todo = [(np.arange(len(y)), 0, len(nodes))]
            nodes.append([0, 0, 0, 0, 0])
            while todo:
                rows, depth, at = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
                    where = flat[rows].ravel()
                    shape = (x.shape[1], BINS)
                    many = x.shape[1]
                    hg = np.bincount(where, np.repeat(g[rows], many), many * BINS).reshape(shape).cumsum(1)
                    hh = np.bincount(where, np.repeat(h[rows], many), many * BINS).reshape(shape).cumsum(1)
                    hn = np.bincount(where, minlength=many * BINS).reshape(shape).cumsum(1)
                    gain = hg**2 / (hh + L2) + (gs - hg) ** 2 / (hs - hh + L2) - gs**2 / (hs + L2)
                    gain[(hn < LEAST_ROWS) | (len(rows) - hn < LEAST_ROWS)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), shape)
                    if gain[f, b] > 1e-6 and b < len(cuts[f]):
                        best = int(f), int(b)
                if best is None:
                    value = RATE * gs / (hs + L2)
                    nodes[at] = [0, 0, at, at, value]
                    margin[rows] += value
                    continue
                f, b = best
                goes = binned[rows, f] <= b
                nodes[at] = [f, cuts[f][b], len(nodes), len(nodes) + 1, 0]
                nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
                todo += [(rows[goes], depth + 1, len(nodes) - 2), (rows[~goes], depth + 1, len(nodes) - 1)]
    n = np.array(nodes or np.zeros((0, 5)), float)
    return Trees(n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64), n[:, 4], np.array(roots, np.int64), base)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, most: int, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``text, label`` of up to ``most`` labelled rows for which ``train`` (of the id) holds; the lowest hashes of ids.

    The sample is bounded, so it is broadcast.  Of texts with one id that with the least hash stands for it.
    """
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    picked = picked.orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(id_col).alias("picked"), "label")
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("picked"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"), F.col("label"))).alias("one")
    return found.groupBy("picked").agg(one).select("one.text", "one.label")


def bucket(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def _with_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = statistics(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, folds=3, held=1, label_col="quality", most=SAMPLE, id_col="doc_id", text_col="text") -> Trees:
    rows = labelled(docs, labels, label_col, bucket(id_col, folds) != held, most, id_col=id_col, text_col=text_col)
    got = rows.mapInArrow(_with_label, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    y = np.array(got.column("label").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of tasks
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, score, predicted`` of every row; null texts score like empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            s = model.score(statistics(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, score double, predicted int").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, *, folds=3, held=1, id_col="doc_id", text_col="text", label_col="quality", most=SAMPLE) -> DataFrame:
    """``<id_col>, held_out, score, predicted`` of every row of ``docs``.

    Learns from rows whose crc32 bucket is not ``held``; a null id is neither held out nor learnt from.
    Repeated rows get equal scores.  Without labels, or with one kind only, all scores are the labels'
    smoothed share (a half without any).  An empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, folds=folds, held=held, label_col=label_col, most=most, id_col=id_col, text_col=text_col)
    held_out = F.coalesce(bucket(id_col, folds) == held, F.lit(False))
    return score(docs, model, id_col=id_col, text_col=text_col).select(id_col, held_out.alias("held_out"), "score", "predicted")
