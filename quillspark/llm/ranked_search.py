"""Ranked lexical search as a blocked sparse matrix product.

The items are a sparse matrix of term multiplicities (item x term), the documents one of int64
impacts (term x document); scores are the product. One scan of the texts keeps, for each document,
its length and the frequencies of the items' terms, and writes them to the shared folder; sums over
that table give N, L and the document frequencies, and so the impacts. A task then takes its documents
in blocks: a block's part of the second matrix is put in row order, an item's row of the product is
merged from the rows of its terms (Gustavson's way), and the ten best of the block are merged with
those of the blocks before. What leaves a task is ten rows an item; a rank within each item ends it.

Items are taken in groups of ``GROUP_BYTES`` of text, each with a scan of its own, so that what is sent
to the tasks has a bound. Terms are found by a 64-bit hash and then compared byte by byte.

Defined results: null texts have no terms and only appear nowhere; a document without a term does not
count in N. Each row of documents is a document of its own, also where ids repeat; a null id comes after
all others of its score. Items with the same id are one item with the terms of all its rows. An item
without terms, or whose terms occur nowhere, has no rows; so has every item of an empty table. Texts of
any length are taken whole. Only id and text are read; other columns may have any name.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import settled, small_batches, written

# Fixed values of the score.
SCALE, LENGTH_SHARE, SATURATION = 1_000_000_000, 75, 8
TOP = 10
#: Bytes of item text in a group; terms and multiplicities of a group are sent to the tasks.
GROUP_BYTES = 16_000_000
#: Documents in a block of the product at most.
BLOCK_DOCS = 16_384

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ROWS = "doc_id long, n long, terms binary, tfs binary"


@dataclass
class Items:
    """A group of items: their ids, the terms by hash, and the matrix of multiplicities in rows."""

    ids: pa.Array
    hashes: np.ndarray
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    row_at: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _hashed(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = tk.spans(piece, tk.IS_PUNCTUATION)
    return starts, ends, first, tk.span_hash(tk.prefix_hash(piece.data, tk.BYTE_VALUE_LOWER), starts, ends)


def matrix(ids: pa.Array, texts: pa.Array) -> Items:
    """The items' matrix; ``ids`` are sorted, so that rows of one item stand together."""
    same = np.zeros(len(ids), np.int64)
    listed = ids.to_pylist()
    same[1:] = [a != b for a, b in zip(listed, listed[1:], strict=False)]
    item_of = np.cumsum(same)
    items, hashes, spelled = [], [], []
    for piece in tk.slices(texts):
        starts, ends, first, h = _hashed(piece)
        low = _LOWER[piece.data].tobytes()
        items.append(np.repeat(item_of[piece.first : piece.last], np.diff(first)))
        hashes.append(h)
        spelled += [low[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    item, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((items, np.int64), (hashes, np.uint64)))
    own, at, term = np.unique(h, return_index=True, return_inverse=True)
    names = [spelled[k] for k in at.tolist()]
    if any(spelled[k] != names[t] for k, t in enumerate(term.tolist())):
        raise ValueError("two terms of the items have one hash")
    cut = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
    pairs, times = np.unique(item * max(len(own), 1) + term, return_counts=True)
    rows = pairs // max(len(own), 1)
    begin = np.flatnonzero(np.concatenate([[True], same[1:] > 0])) if len(ids) else np.zeros(0, np.int64)
    return Items(ids.take(pa.array(begin)), own, np.frombuffer(b"".join(names), np.uint8), cut[:-1], cut[1:], np.searchsorted(rows, np.arange(len(begin) + 1)), pairs % max(len(own), 1), times.astype(np.int64))


def _same_bytes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: Items, term: np.ndarray) -> np.ndarray:
    """Which words are spelled as the terms found for them by hash."""
    same = ends - starts == items.ends[term] - items.begins[term]
    left, at = np.flatnonzero(same), 0
    while len(left):
        left = left[ends[left] - starts[left] > at]
        wrong = low[starts[left] + at] != items.data[items.begins[term[left]] + at]
        same[left[wrong]] = False
        left, at = left[~wrong], at + 1
    return same


def frequencies(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document: its number of terms, and those that the items have, with frequencies."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((items.hashes, items.data, items.begins, items.ends))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, data, begins, ends_of = sent.value
        own = Items(None, hashes, data, begins, ends_of, None, None, None)
        for b in batches:
            for piece in tk.slices(b.column(1)):
                starts, ends, first, h = _hashed(piece)
                counts = np.diff(first)
                row = np.repeat(np.arange(len(counts)), counts)
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                known = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
                term = at[known]
                known_same = _same_bytes(_LOWER[piece.data], starts[known], ends[known], own, term)
                pairs, tf = np.unique(row[known[known_same]] * max(len(hashes), 1) + term[known_same], return_counts=True)
                cuts = np.searchsorted(pairs // max(len(hashes), 1), np.arange(len(counts) + 1)).tolist()
                terms, tfs = (pairs % max(len(hashes), 1)).astype("<i4").tobytes(), tf.astype("<i4").tobytes()
                parts = list(zip(cuts, cuts[1:], strict=False))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(piece.first, piece.last - piece.first), pa.array(counts.astype(np.int64)), pa.array([terms[4 * s : 4 * e] for s, e in parts], pa.binary()), pa.array([tfs[4 * s : 4 * e] for s, e in parts], pa.binary())],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _ROWS)


def _joined(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def statistics(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the items; a row for each term and task is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, words = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            n = b.column(0).to_numpy()
            docs, words = docs + int((n > 0).sum()), words + int(n.sum())
            df += np.bincount(_joined(b.column(1)), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[docs, words], df[some]]))], names=["term", "n"])

    df = np.zeros(n_terms + 2, np.int64)
    sums = rows.select("n", "terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return int(df[-1]), int(df[-2]), df[:n_terms]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """w of each term; the logarithm is taken once for each distinct frequency."""
    found, at = np.unique(df, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in found.tolist()], np.int64)[at]


class Best:
    """The best documents so far of each item."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.least = np.ones(n_items, np.int64)
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * n_items
        self.doc: list[np.ndarray] = [np.zeros(0, np.int64)] * n_items
        self.void: list[np.ndarray] = [np.zeros(0, bool)] * n_items

    def add(self, item: int, scores: np.ndarray, docs: np.ndarray, void: np.ndarray) -> None:
        """Scores of a block; ties at the last place are kept until the ids decide."""
        at = np.flatnonzero(scores >= self.least[item])
        if len(at) > self.top:
            own = scores[at]
            at = at[own >= np.partition(own, len(own) - self.top)[len(own) - self.top]]
        if not len(at):
            return
        score = np.concatenate([self.score[item], scores[at]])
        doc = np.concatenate([self.doc[item], docs[at]])
        none = np.concatenate([self.void[item], void[at]])
        order = np.lexsort((doc, none, -score))[: self.top]
        self.score[item], self.doc[item], self.void[item] = score[order], doc[order], none[order]
        if len(order) == self.top:
            self.least[item] = score[order[-1]]


def _product(n: np.ndarray, own: np.ndarray, sizes: np.ndarray, tf: np.ndarray, items: Items, weight: np.ndarray, n_docs: int, n_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of the product over a block of documents: ``(item, score of each document)``."""
    doc = np.repeat(np.arange(len(n)), sizes)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // max(n_words, 1)
    impact = weight[own] * ((SCALE * tf) // (1000 * tf + SATURATION * m[doc]))
    order = np.argsort(own, kind="stable")
    doc, impact = doc[order], impact[order]
    row = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(weight)))])
    total = np.zeros(len(n), np.int64)
    for item in range(len(items.row_at) - 1):
        part = slice(items.row_at[item], items.row_at[item + 1])
        merged = [(doc[s:e], times * impact[s:e]) for s, e, times in zip(row[items.terms[part]].tolist(), row[items.terms[part] + 1].tolist(), items.times[part].tolist(), strict=True) if e > s]
        if merged:
            total[:] = 0
            np.add.at(total, np.concatenate([d for d, _ in merged]), np.concatenate([v for _, v in merged]))
            yield item, total


def best_of_tasks(rows: DataFrame, items: Items, weight: np.ndarray, n_docs: int, n_words: int, id_type: str, top: int = TOP) -> DataFrame:
    """``(item_id, doc_id, score)``: for each task the best documents of each item."""
    sent = rows.sparkSession.sparkContext.broadcast((items, weight))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = sent.value
        best = Best(len(items.ids), top)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(at, BLOCK_DOCS)
                void = part.column(0).is_null().to_numpy(zero_copy_only=False)
                docs = part.column(0).fill_null(0).to_numpy()
                sizes = np.array([len(x) // 4 for x in part.column(2).to_pylist()], np.int64)
                for item, scores in _product(part.column(1).to_numpy(), _joined(part.column(2)), sizes, _joined(part.column(3)), items, weight, n_docs, n_words):
                    best.add(item, scores, docs, void)
            tk.give_back()
        owner = np.repeat(np.arange(len(items.ids)), [len(x) for x in best.score])
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(owner, pa.int64())), pa.array(flat(best.doc, np.int64), mask=flat(best.void, bool)), pa.array(flat(best.score, np.int64))], names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(scan, f"item_id {id_type}, doc_id long, score long")


def groups(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", group_bytes: int = GROUP_BYTES) -> Iterator[Items]:
    """Items in groups of about ``group_bytes`` of text; rows of one id are in one group."""
    own = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // group_bytes)
    for k in range(n):
        part = (own.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) if n > 1 else own).toArrow().sort_by("item_id").combine_chunks()
        if part.num_rows:
            flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in part.columns]
            yield matrix(*flat)


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0."""
    id_type = benchmark.schema[item_col].dataType.simpleString()

    def one(items: Items) -> DataFrame:
        rows = written(frequencies(docs, items, id_col, text_col))
        n_docs, n_words, df = statistics(rows, len(items.hashes))
        return written(best_of_tasks(rows, items, term_weights(n_docs, df), n_docs, n_words, id_type, top))

    found = [settled(functools.partial(one, items)) for items in groups(benchmark, item_col, item_text, group_bytes)]
    every = functools.reduce(DataFrame.unionByName, found) if found else benchmark.select(F.col(item_col).alias("item_id"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).where("false")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
