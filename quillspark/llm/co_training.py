"""Quality classifier by co-training of two views.

The text view sees hashed byte n-grams, the metadata view sees language, source and the
layout of the page: its length, its lines and their length, and the shares of digits,
capitals and signs. Both are logistic models fitted on a bounded sample of labelled documents.
Each view is calibrated on labelled documents set aside. In each round both views score all
documents that have no label, and each hands its most confident pseudo-labels, by its
calibrated score, ``HANDED`` of each class at most, to the other view. A view that does not
rank the documents set aside (``RANKS_FROM``) hands over nothing. In the end the two are combined
as independent evidence: logit(text) + logit(metadata) - logit(prior). Every document
is scored.

``LABELLED_LIMIT`` bounds the labelled sample (the ids with the smallest hashes). A task
sends on ids and scores of its most confident documents only; the features of those
that are handed over, and of the labelled sample, are what reaches the driver.

Defined results: null or empty texts have no n-grams and are scored by their metadata;
null metadata is a value of its own; of contradictory labels for an id the lower one
counts; without labels of both kinds every score is the prior (1 without any label);
repeated rows are each scored; they count as one when documents are handed over,
and one of them is learned from; equally confident
documents are handed over in the order of ids; a very long text is one row of one task;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, settled
from .quality_rules import buckets

TEXT_BITS = 9
META_SIZE = 200
LABELLED_LIMIT = 6_000
ROUNDS = 4
#: Pseudo-labels that a view hands over in a round, of each class at most, and the confidence they need.
HANDED, CONFIDENT = 150, 0.95
#: The share of good and bad pairs set aside that a view has to order rightly before it hands over anything.
RANKS_FROM = 0.7
KEEP_FROM = 0.5
#: Where the steps of a share of a text's bytes begin.
STEPS = np.array([1e-9, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25])
_CLASS = np.zeros(256, np.uint8)  # 1 line end, 2 digit, 3 capital, 4 sign
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 4
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x0A] = 2, 3, 1


def text_features(piece: tk.Slice) -> np.ndarray:
    """Square roots of the bucket frequencies of each text's n-grams."""
    code, at = buckets(piece, bits=16)
    n = len(piece.offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(at)) << TEXT_BITS | (code & ((1 << TEXT_BITS) - 1))
    counts = np.bincount(cell, minlength=n << TEXT_BITS).reshape(n, 1 << TEXT_BITS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def meta_features(piece: tk.Slice, lengths: list, langs: list, sources: list) -> np.ndarray:
    """One-hot features: length, lines and mean line length in powers of two, shares of characters in steps, hashed language and source."""
    n = len(lengths)
    out = np.zeros((n, META_SIZE), np.float32)
    rows, size = np.arange(n), np.diff(piece.offsets)
    kind = _CLASS[piece.data]
    ends, digits, capitals, signs = (np.diff(np.searchsorted(np.flatnonzero(kind == k), piece.offsets)) for k in (1, 2, 3, 4))
    lines = ends + (size > 0)
    out[rows, 128 + np.minimum(np.ceil(np.log2(lines + 1)).astype(int), 31)] = 1
    out[rows, 160 + np.minimum(np.ceil(np.log2(size // np.maximum(lines, 1) + 1)).astype(int), 15)] = 1
    for first, count in ((176, digits), (184, capitals), (192, signs)):
        out[rows, first + np.searchsorted(STEPS, count / np.maximum(size, 1), side="right")] = 1
    for r, (length, lang, source) in enumerate(zip(lengths, langs, sources, strict=True)):
        out[r, min(int(length).bit_length(), 31) if length and length > 0 else 0] = 1
        out[r, 32 + zlib.crc32(repr(lang).encode()) % 32] = 1
        out[r, 64 + zlib.crc32(repr(source).encode()) % 64] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam over the whole sample; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (sigmoid(x @ w) - y) / len(y) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def ordered(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of a good and a bad document that the score orders rightly; ties count half."""
    good, bad = score[y == 1][:, None], score[y == 0][None, :]
    return float(((good > bad) + 0.5 * (good == bad)).mean())


def calibration(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset; a view that ranks the wrong way round says nothing, and its best constant is the share of good ones."""
    s = fit(score[:, None], y.astype(float), penalty=1e-3)
    return (float(s[0]), float(s[1])) if s[0] > 0 else (0.0, logit(float(y.mean())))


def handing(w: np.ndarray, score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the calibrated score; all zero, so never confident, if the view doesn't rank what was set aside."""
    slope, offset = calibration(score, y)
    if slope == 0 or ordered(score, y) < RANKS_FROM:
        return np.zeros_like(w)
    return np.append(slope * w[:-1], slope * w[-1] + offset)


@dataclass
class Model:
    """Weights of both views with their calibration (slope, offset), and the prior."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_scale[0] * linear(text, self.text) + self.text_scale[1]
        b = self.meta_scale[0] * linear(meta, self.meta) + self.meta_scale[1]
        return sigmoid(a), sigmoid(b), sigmoid(a + b - logit(self.prior))


Handed = dict[int, tuple[int, np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Callable[[list[np.ndarray], list[set[int]]], list[Handed]], rounds: int = ROUNDS) -> Model:
    """``text``, ``meta``, ``y``: labelled documents, of which a fifth of each label is set aside for calibration.

    ``pool(weights, taken)``, given the weights of the calibrated scores, scores the unlabelled documents with both views and gives what each view hands to the
    other: (label, text features, metadata features) by id; ids in ``taken`` were handed to that view before.
    """
    prior = float(y.mean()) if len(y) else 1.0
    aside = np.sort(np.concatenate([np.flatnonzero(y == k)[::5] for k in (0, 1)]))
    core = np.setdiff1d(np.arange(len(y)), aside)
    if len(set(y[core].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        return Model(np.zeros(text.shape[1] + 1), np.zeros(meta.shape[1] + 1), (0.0, logit(prior)), (0.0, logit(prior)), prior)
    given: list[Handed] = [{}, {}]
    models: list[np.ndarray] = []
    for step in range(rounds + 1):
        models = []
        for k, own in enumerate((text, meta)):
            x = np.vstack([own[core], *(v[1 + k][None, :] for v in given[k].values())])
            models.append(fit(x, np.array([*y[core], *(v[0] for v in given[k].values())], float)))
        if step == rounds:
            break
        surest = [handing(w, linear(view[aside], w), y[aside]) for view, w in zip((text, meta), models, strict=True)]
        offers = pool(surest, [set(given[1]), set(given[0])])
        if not any(offers):
            break
        given[1] |= offers[0]
        given[0] |= offers[1]
    scales = [calibration(linear(view[aside], w), y[aside]) for view, w in zip((text, meta), models, strict=True)]
    return Model(models[0], models[1], scales[0], scales[1], prior)


def surest(ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``HANDED`` ids of least score, an id's best row alone; which rows met in a task makes no difference to the best of all."""
    order = np.lexsort((score, ids))
    order = order[np.append(True, np.diff(ids[order]) != 0)] if len(order) else order
    top = order[np.lexsort((ids[order], score[order]))[:HANDED]]
    return ids[top], score[top]


def confident(p: np.ndarray, ids: np.ndarray, free: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each label the ids of rows that are free and sure of it, the surest ``HANDED`` of them, with how unsure they are."""
    for label, score in ((0, p), (1, 1 - p)):
        rows = np.flatnonzero(free & (score <= 1 - CONFIDENT))
        yield label, *surest(ids[rows], score[rows])


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))


def _views(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for piece in tk.slices(b.column(1)):
        part = b.slice(piece.first, piece.last - piece.first)
        yield part, text_features(piece), meta_features(piece, *(part.column(c).to_pylist() for c in (2, 3, 4)))


def _features(own: DataFrame, wanted: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Both views' features of a bounded set of ids; of an id's rows one counts, chosen before anything is collected."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_in(b.column(0), wanted))
            for part, text, meta in _views(b):
                yield batch("doc_id long,text binary,meta binary", part.column(0), [x.tobytes() for x in text], [x.tobytes() for x in meta])

    rows = own.mapInArrow(gather, "doc_id long, text binary, meta binary").groupBy("doc_id").agg(F.min(F.struct("text", "meta")).alias("x")).select("doc_id", "x.text", "x.meta").toArrow()
    return {d: (np.frombuffer(t, np.float32), np.frombuffer(m, np.float32)) for d, t, m in zip(*(c.to_pylist() for c in rows.columns), strict=True)}


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled sample, and in each round on what all other documents hand over."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(6), "doc_id"), F.col("doc_id")
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"))
    truth = {r[0]: int(r[1]) for r in marked.orderBy(*order).limit(LABELLED_LIMIT).collect()}
    own = _prepared(docs)
    known = _features(own, pa.array(sorted(truth), pa.int64()))
    ids = sorted(known)

    def pool(weights: list[np.ndarray], taken: list[set[int]]) -> list[Handed]:
        sent = spark.sparkContext.broadcast((weights, [pa.array(sorted(x | set(truth)), pa.int64()) for x in taken]))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, closed = sent.value
            best: list[list[np.ndarray]] = [[np.zeros(0, np.int64), np.zeros(0)] for _ in range(4)]
            for b in batches:
                b = b.filter(pc.is_valid(b.column(0)))
                for part, *views in _views(b):
                    names = part.column(0).to_numpy()
                    for k in range(2):
                        p = sigmoid(linear(views[k], models[k]))
                        free = ~pc.is_in(part.column(0), closed[k]).to_numpy(zero_copy_only=False)
                        for label, *found in confident(p, names, free):
                            best[2 * k + label] = list(surest(*(np.concatenate(x) for x in zip(best[2 * k + label], found, strict=True))))
            for slot, (at, sure) in enumerate(best):
                yield batch("slot int,doc_id long,p double", np.full(len(at), slot), at, sure)

        found = settled(lambda: own.mapInArrow(score, "slot int, doc_id long, p double").groupBy("slot", "doc_id").agg(F.min("p").alias("p")))
        chosen = [[r[0] for r in found.where(F.col("slot") == k).orderBy("p", "doc_id").limit(HANDED).select("doc_id").collect()] for k in range(4)]
        made = _features(own, pa.array(sorted({i for c in chosen for i in c}), pa.int64()))
        return [{i: (label, *made[i]) for label in (0, 1) for i in chosen[2 * k + label]} for k in range(2)]

    empty = [np.zeros((0, 1 << TEXT_BITS), np.float32), np.zeros((0, META_SIZE), np.float32)]
    text, meta = (np.stack([known[i][k] for i in ids]) if ids else empty[k] for k in range(2))
    return co_train(text, meta, np.array([truth[i] for i in ids], np.int64), pool)


def report(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Both views' scores, the combined score and the verdict for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, text, meta in _views(b):
                a, m, both = sent.value.scores(text, meta)
                yield batch("doc_id long,text_score double,meta_score double,score double,kept boolean", part.column(0), a, m, both, both >= keep_from)

    return _prepared(docs).mapInArrow(score, "doc_id long, text_score double, meta_score double, score double, kept boolean")
