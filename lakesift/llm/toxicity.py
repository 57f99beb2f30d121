"""Toxicity: a linear-chain conditional random field tags toxic spans.

Rows carry one label per document, so tokens are labelled first: words, and beginnings of words, that enough
toxic documents of a bounded sample hold, near copies counted once, and that clean ones lack, make toxic tokens
of those documents; toxic documents without any are not learnt from.  The field is fitted to chains of up to 64 of these
tokens.  Forward-backward marginals of every token of every text then give spans and document scores.  A text's
chains are taken in step across a batch, so that long texts cost no more per word than short ones, and
hand their messages on to one another, so that marginals are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesift.llm.common import discard, stash
from lakesift.llm.quality import bucket, labelled
from lakesift.llm.words import Texts, mix, pieces

#: Labelled rows to learn from, at most: those whose ids hash lowest.
SAMPLE = 5_000
#: Files that the sample is kept in, at most.
PARTS = 8
CHAIN = 64
SLOTS = 1 << 18
#: How many toxic documents must hold a toxic word or beginning.
LEAST_DOCS = 5
#: Bytes of a word's beginnings that count.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A word or beginning is toxic if this share of the documents that hold it is.
PURE = 0.8
#: Least hashes of a text's 5-word shingles that tell near copies in the sample, in bands, and the share of them that must agree.
SKETCH, BAND, ALIKE = 64, 4, 0.7
#: Chains that one slice of a training step holds.
SLICE = 4096
STEPS, RATE, L2 = 60, 0.2, 1e-5
#: Marginals below this do not add up over a document: no number of unlikely tokens makes a long text toxic.
FLOOR = 0.5
MARKS = np.zeros(256, bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Tokens:
    """Words of a batch of texts without punctuation around, lower-cased: ``word`` hashes and ``features`` per token."""

    def __init__(self, texts: list[str | None]) -> None:
        t = self.texts = Texts(texts, lower=True)
        start, end = t.start.copy(), t.end.copy()
        for _ in range(4):
            more = (end > start) & MARKS[t.bytes[np.maximum(end - 1, 0)]]
            end[more] -= 1
            more = (end > start) & MARKS[t.bytes[start]]
            start[more] += 1
        self.start, self.end = start, end
        self.word = t.hash_of(start, end)
        self.first = t.first

    def markers(self) -> np.ndarray:
        """Tokens x (the word, its beginnings) as hashes; 0 where a word is no longer than a beginning."""
        t, start, end = self.texts, self.start, self.end
        out = [mix(self.word, 50)]
        for n in BEGINNINGS:
            out.append(np.where(end - start > n, mix(t.hash_of(start, np.minimum(start + n, end)), 50 + n), np.uint64(0)))
        return np.column_stack(out).view(np.int64)

    def features(self) -> np.ndarray:
        """Slots of: the word, its beginnings, its last three bytes, its length, and whether marks stood around it."""
        t, start, end = self.texts, self.start, self.end
        size = end - start
        kinds = (
            *self.markers().view(np.uint64).T,
            t.hash_of(np.maximum(end - 3, start), end),
            np.minimum(size, 20).astype(np.uint64),
            (t.end - t.start - size > 0).astype(np.uint64),
        )
        return np.column_stack([(mix(k, 60 + i) % np.uint64(SLOTS)).astype(np.int32) for i, k in enumerate(kinds)])

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """First token and length of each chain."""
        sizes = np.diff(self.first)
        many = -(-sizes // CHAIN)
        owner = np.repeat(np.arange(len(sizes)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        begin = self.first[owner] + at * CHAIN
        return begin, np.minimum(CHAIN, self.first[owner + 1] - begin)


@dataclass
class Field:
    """Weights of the toxic state's features; ``step[i, j]`` from state i to j and ``start`` are log potentials."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray


def _local(e: np.ndarray) -> np.ndarray:
    out = np.ones((*e.T.shape, 2))
    out[:, :, 1] = np.exp(np.clip(e.T, -30, 30))
    return out


def forward_backward(e: np.ndarray, lengths: np.ndarray, field: Field, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains x steps of toxic scores -> marginals of the toxic state, expected steps, expected starts.

    ``before`` and ``after`` are messages (chains x states) from the rest of a text, up to a factor.
    """
    rows, width = e.shape
    psi, local = np.exp(field.step), _local(e)
    before = np.exp(field.start) if before is None else before
    after = np.ones((rows, 2)) if after is None else after
    alpha, beta, scale = np.zeros((width, rows, 2)), np.empty((width, rows, 2)), np.ones((width, rows))
    live = np.arange(width)[:, None] < lengths[None, :]
    for t in range(width):
        a = before * local[0] if t == 0 else (alpha[t - 1] @ psi) * local[t]
        s = a.sum(1)
        scale[t] = np.where(live[t], s, 1)
        alpha[t] = np.where(live[t][:, None], a / s[:, None], alpha[t - 1] if t else 0.5)
    steps = np.zeros((2, 2))
    beta[width - 1] = after
    for t in range(width - 2, -1, -1):
        on = live[t + 1][:, None]
        ahead = local[t + 1] * beta[t + 1] / scale[t + 1][:, None]
        beta[t] = np.where(on, ahead @ psi.T, after)
        steps += (np.where(on, alpha[t], 0).T @ ahead) * psi
    both = alpha * beta
    marginal = both[:, :, 1] / both.sum(2)
    marginal[~live] = 0
    first = both[0] / both[0].sum(1, keepdims=True)
    return marginal.T, steps, first.sum(0)


def messages(e: np.ndarray, lengths: np.ndarray, number: np.ndarray, last: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """``before`` and ``after`` of chains, each the ``number``-th of its text in order; ``last`` marks a text's last one.

    A chain's steps multiply up to a matrix of two states; messages run through these, chain by chain of all texts at once.
    """
    rows, width = e.shape
    psi, local = np.exp(field.step), _local(e)
    whole = np.eye(2) * local[0][:, None, :]
    for t in range(1, width):
        on = np.flatnonzero(lengths > t)
        m = (whole[on] @ psi) * local[t][on][:, None, :]
        whole[on] = m / m.max((1, 2), keepdims=True)
    before, after = np.tile(np.exp(field.start), (rows, 1)), np.ones((rows, 2))
    for k in range(1, int(number.max(initial=0)) + 1):
        at = np.flatnonzero(number == k)
        m = np.einsum("ri,rij->rj", before[at - 1], whole[at - 1]) @ psi
        before[at] = m / m.sum(1, keepdims=True)
    for k in range(int(number.max(initial=0)) - 1, -1, -1):
        at = np.flatnonzero((number == k) & ~last)
        m = np.einsum("rij,rj->ri", whole[at + 1], after[at + 1]) @ psi.T
        after[at] = m / m.sum(1, keepdims=True)
    return before, after


def fit(kinds: np.ndarray, types: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> Field:
    """The field of greatest penalised likelihood (Adam, all chains a step).

    Each type of token has its row of feature slots in ``kinds``; ``types`` and ``tags`` are chains x CHAIN.
    """
    used, where = np.unique(kinds, return_inverse=True)
    where = where.reshape(kinds.shape)
    sizes = np.array([len(used), 4, 2])
    x, m, v = np.zeros(sizes.sum()), np.zeros(sizes.sum()), np.zeros(sizes.sum())
    x[len(used) + 1] = -3.0
    live = np.arange(CHAIN)[None, :] < lengths[:, None]
    per_feature = lambda per_type: np.bincount(where.ravel(), per_type.repeat(where.shape[1]), len(used))
    seen = per_feature(np.bincount(types[live], tags[live], len(kinds)))
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (tags[:, :-1][live[:, 1:]], tags[:, 1:][live[:, 1:]]), 1)
    starts = np.bincount(tags[:, 0], minlength=2).astype(float)
    total = max(1, live.sum())
    for k in range(1, STEPS + 1):
        w = x[: len(used)]
        score = w[where].sum(1)
        field = Field(w, x[len(used) : len(used) + 4].reshape(2, 2), x[-2:])
        hoped, steps, first = np.zeros(len(kinds)), np.zeros((2, 2)), np.zeros(2)
        for a in range(0, len(lengths), SLICE):
            own, on = types[a : a + SLICE], live[a : a + SLICE]
            p, s, f = forward_backward(np.where(on, score[own], 0), lengths[a : a + SLICE], field)
            hoped += np.bincount(own[on], p[on], len(kinds))
            steps, first = steps + s, first + f
        g = np.concatenate([seen - per_feature(hoped), (pairs - steps).ravel(), starts - first]) / total - L2 * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    weights = np.zeros(SLOTS)
    weights[used] = x[: len(used)]
    return Field(weights, x[len(used) : len(used) + 4].reshape(2, 2), x[-2:])


def _distinct(m: np.ndarray) -> np.ndarray:
    m = np.unique(m)
    return m[m != 0]


def _distinct_markers(gone: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            batch = batch.filter(pa.array(~np.isin(np.array(batch.column("th").to_pylist(), np.int64), gone)))
            t = Tokens(batch.column("text").to_pylist())
            m = t.markers()
            found = [_distinct(m[t.first[i] : t.first[i + 1]]) for i in range(batch.num_rows)]
            at = np.repeat(np.array(batch.column("label").to_pylist(), np.int32), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), pa.array(at, pa.int32())], names=["marker", "label"])

    return run


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``th, sketch``: the least hash of a text's 5-word shingles in each of SKETCH classes of hashes; zeros where there is none."""
    for batch in pieces(batches):
        t = Texts(batch.column("text").to_pylist(), lower=True)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(t.first))
        grams = t.shingles(5)
        on = np.arange(len(grams)) + 5 <= t.first[owner + 1] if len(grams) else np.zeros(0, bool)
        least = np.full(batch.num_rows * SKETCH, np.iinfo(np.uint64).max)
        np.minimum.at(least, owner[on] * SKETCH + (grams[on] % np.uint64(SKETCH)).astype(np.int64), grams[on])
        least[least == np.iinfo(np.uint64).max] = 0
        yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array([x.tobytes() for x in least.reshape(-1, SKETCH)], pa.binary())], names=["th", "sketch"])


def near_copies(names: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Names of the sample's rows that are near copies of one with a smaller name, by bands of their sketches."""
    order = np.argsort(names)
    names, sketches = names[order], sketches[order]
    gone = np.zeros(len(names), bool)
    for b in range(0, SKETCH, BAND):
        first: dict[bytes, int] = {}
        for i in np.flatnonzero(sketches[:, b : b + BAND].any(1)).tolist():
            j = first.setdefault(sketches[i, b : b + BAND].tobytes(), i)
            some = (sketches[i] > 0) | (sketches[j] > 0)
            if i != j and (sketches[i] == sketches[j])[some].mean() >= ALIKE:
                gone[i] = True
    return names[gone]


def toxic_markers(rows: DataFrame) -> np.ndarray:
    """Hashes of the words and beginnings that at least LEAST_DOCS toxic rows of ``text, label`` (a bounded sample) hold, and few clean ones.

    Copies share odd words with the toxic words that they hold, so of near copies one counts.
    """
    texts = stash(rows.groupBy("text").agg(F.max("label").alias("label")).select(F.xxhash64("text").alias("th"), "text", "label").coalesce(PARTS), "toxic-texts")
    got = texts.select("th", "text").mapInArrow(_sketches, "th long, sketch binary").toArrow()
    sketches = np.frombuffer(b"".join(got.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH)
    gone = near_copies(np.array(got.column("th").to_pylist(), np.int64), sketches)
    counts = texts.mapInArrow(_distinct_markers(gone), "marker long, label int").groupBy("marker").agg(F.sum("label").alias("toxic"), F.count("*").alias("docs"))
    good = counts.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= PURE * F.col("docs"))).select("marker").toArrow()
    discard(texts)
    return np.sort(np.array(good.column("marker").to_pylist(), np.int64))


def _training_tokens(markers: np.ndarray):
    """A row for each batch: its types of tokens and their feature slots, the tokens of its texts (type in the batch, doubled, plus
    tag) one text after another, and how many each text has.

    A toxic row without a marker gives none: which of its tokens are toxic is not known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t = Tokens(batch.column("text").to_pylist())
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            features = t.features()
            kind = np.zeros(len(features), np.uint64)
            for i in range(features.shape[1]):
                kind = mix(kind + features[:, i].astype(np.uint64), 80 + i)
            owner = np.repeat(np.arange(len(labels)), np.diff(t.first))
            tag = np.isin(t.markers(), markers).any(1) & (labels[owner] == 1)
            told = (labels != 1) | (np.bincount(owner, tag, len(labels)) > 0)
            types, at, local = np.unique(kind, return_index=True, return_inverse=True)
            tokens = (local * 2 + tag).astype(np.int32)[told[owner]]
            row = (types.tobytes(), features[at].tobytes(), tokens.tobytes(), np.diff(t.first)[told].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["types", "features", "tokens", "counts"])

    return run


def train(docs: DataFrame, labels: DataFrame, *, folds=5, held=0, label_col="toxic", most=SAMPLE, id_col="doc_id", text_col="text") -> Field:
    """The field learnt from up to ``most`` labelled rows whose crc32 bucket is not ``held``, all of their tokens."""
    rows = stash(labelled(docs, labels, label_col, bucket(id_col, folds) != held, most, id_col=id_col, text_col=text_col).coalesce(PARTS), "toxic-sample")
    markers = toxic_markers(rows)
    got: list[tuple[bytes, bytes]] = []
    slots: dict[int, bytes] = {}
    known: dict[int, int] = {}
    kinds: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    # a partition at a time: what is kept is four bytes a token and each type's features once
    for r in rows.mapInArrow(_training_tokens(markers), "types binary, features binary, tokens binary, counts binary").toLocalIterator():
        before, hashes = len(known), np.frombuffer(r["types"], np.uint64)
        here = np.array([known.setdefault(h, len(known)) for h in hashes.tolist()], np.int32)
        kinds.append(np.frombuffer(r["features"], np.int32).reshape(len(hashes), -1)[here >= before])
        tokens, counts = np.frombuffer(r["tokens"], np.int32), np.frombuffer(r["counts"], np.int32)
        if len(tokens):
            texts += np.split(here[tokens >> 1] * 2 + (tokens & 1), np.cumsum(counts)[:-1])
    discard(rows)
    texts = [x for x in texts if len(x)]
    if not len(markers) or not texts:
        return Field(np.zeros(SLOTS), np.array([[0.0, -30.0], [0.0, -30.0]]), np.array([0.0, -30.0]))
    # the same field whatever the order of tasks
    order = np.argsort(np.array(list(known), np.uint64))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    texts = sorted((rank[x >> 1] * 2 + (x & 1) for x in texts), key=bytes)
    lengths = np.concatenate([np.minimum(CHAIN, len(x) - np.arange(0, len(x), CHAIN)) for x in texts])
    live = np.arange(CHAIN)[None, :] < lengths[:, None]
    types, tags = np.zeros(live.shape, np.int32), np.zeros(live.shape, np.int8)
    every = np.concatenate(texts)
    types[live], tags[live] = every >> 1, every & 1
    return fit(np.concatenate(kinds)[order], types, tags, lengths)


def marginals(tokens: Tokens, field: Field) -> np.ndarray:
    """The toxic state's marginal at each token of the batch."""
    out = np.zeros(len(tokens.word))
    if not len(out):
        return out
    score = field.weights[tokens.features()].sum(1)
    begin, length = tokens.chains()
    at = np.minimum(begin[:, None] + np.arange(CHAIN)[None, :], len(out) - 1)
    live = np.arange(CHAIN)[None, :] < length[:, None]
    owner = np.searchsorted(tokens.first, begin, "right") - 1
    number = (begin - tokens.first[owner]) // CHAIN
    last = begin + length == tokens.first[owner + 1]
    out[at[live]] = forward_backward(score[at], length, field, *messages(score[at], length, number, last, field))[0][live]
    return out


def document_score(own: np.ndarray) -> float:
    """The chance of any toxic token among those that stand out, or the greatest marginal where none does."""
    high = own[own >= FLOOR]
    return float(min(1.0, max(own.max(), 1 - np.prod(1 - high))))


def tag(docs: DataFrame, field: Field, *, id_col="doc_id", text_col="text") -> DataFrame:
    """``<id_col>, score, predicted, spans`` of every row.

    ``score`` is as in ``document_score``; ``spans`` are code point offsets (start, end) of runs of tokens more likely toxic than not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column("text").to_pylist()
            t = Tokens(texts)
            p = marginals(t, field)
            scores, spans = [], []
            for i in range(batch.num_rows):
                a, b = int(t.first[i]), int(t.first[i + 1])
                own = p[a:b]
                scores.append(document_score(own) if b > a else 0.0)
                found: list[dict] = []
                on = np.flatnonzero(own >= 0.5)
                if len(on):
                    raw, base = texts[i].encode("utf-8", "surrogatepass"), int(t.texts.bounds[i])
                    place = lambda at, raw=raw, base=base: len(raw[: at - base].decode("utf-8", "surrogatepass"))
                    for run_of in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                        found.append({"start": place(int(t.start[a + run_of[0]])), "end": place(int(t.end[a + run_of[-1]]))})
                spans.append(found)
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["id", "score", "predicted", "spans"],
            )

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {dict(base.dtypes)['id']}, score double, predicted int, spans array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, *, folds=5, held=0, id_col="doc_id", text_col="text", label_col="toxic", most=SAMPLE) -> DataFrame:
    """``<id_col>, held_out, score, predicted, spans`` of every row of ``docs``.

    Learns from rows whose crc32 bucket is not ``held``; a null id is neither held out nor learnt from.  Null and
    empty texts score 0 without spans; repeated rows score alike; without labels, or toxic words among them,
    all scores are near 0.  An empty table gives no rows; other columns are ignored.
    """
    field = train(docs, labels, folds=folds, held=held, label_col=label_col, most=most, id_col=id_col, text_col=text_col)
    held_out = F.coalesce(bucket(id_col, folds) == held, F.lit(False))
    return tag(docs, field, id_col=id_col, text_col=text_col).select(id_col, held_out.alias("held_out"), "score", "predicted", "spans")


def reject(docs: DataFrame, labels: DataFrame, *, folds=5, held=0, id_col="doc_id", text_col="text", label_col="toxic", most=SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts stay, and so do rows without an id; repeated rows stay or go together; an empty table stays empty.
    """
    field = train(docs, labels, folds=folds, held=held, label_col=label_col, most=most, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            t = Tokens(batch.column(text_col).to_pylist())
            p = marginals(t, field)
            keep = [not len(own) or document_score(own) < 0.5 for own in (p[t.first[i] : t.first[i + 1]] for i in range(batch.num_rows))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
