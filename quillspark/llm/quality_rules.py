"""Quality rules: base counts of a text and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte 4-grams are counted in one pass: of the raw
corpus (all documents) and of the trusted target (a bounded sample of labelled
documents). A second pass gives each document the mean log ratio of its n-grams
and keeps it if that is at least ``threshold``. Ratios are whole numbers of
1/65536, so a score does not depend on how rows are batched.

Defined results: a null text counts as empty and fails the base rules; repeated
rows are judged each on its own; without any trusted document all ratios are 0
and every document that passes the base rules is kept; an id with contradictory
labels is trusted if one of its rows is good and not toxic; a document exactly at the
threshold is kept; a very long text is measured whole, as one row; an empty table
gives an empty result; other columns are passed through or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch

BUCKET_BITS = 16
ORDER = 4
SMOOTHING = 0.5
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.5
#: The trusted sample: at most this many labelled documents, those with the smallest hash.
TRUSTED_LIMIT = 20_000
FIXED_POINT = 65_536

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
REPORT = "doc_id long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,n_grams long,llr double,kept boolean"


def buckets(piece: tk.Slice, order: int = ORDER, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram that lies in one text, and each text's first n-gram."""
    d = piece.data
    lengths = np.diff(piece.offsets)
    at = np.concatenate([[0], np.cumsum(np.maximum(lengths - order + 1, 0))])
    if len(d) < order:
        return np.zeros(0, np.int64), at
    code = np.zeros(len(d) - order + 1, np.uint32)
    for k in range(order):
        code = (code * np.uint32(0x01000193)) ^ d[k : len(d) - order + 1 + k]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
    code >>= np.uint32(32 - bits)
    inside = np.ones(len(d) + 1, bool)
    for k in range(1, order):
        ends = piece.offsets[1:] - k
        inside[ends[ends >= piece.offsets[:-1]]] = False
    return code[inside[: len(code)]].astype(np.int64), at


def gram_counts(docs: DataFrame, trusted_ids: Iterable[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each bucket in all documents and in the trusted ones, summed in each task before the shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(sorted(set(trusted_ids)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(1 << BUCKET_BITS, np.int64)
        trusted = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            is_trusted = pc.is_in(b.column(0), pa.array(known.value, pa.int64())).to_numpy(zero_copy_only=False)
            for piece in tk.slices(b.column(1)):
                code, at = buckets(piece)
                raw += np.bincount(code, minlength=len(raw))
                flag = np.repeat(is_trusted[piece.first : piece.last], np.diff(at))
                trusted += np.bincount(code[flag], minlength=len(raw))
        seen = np.flatnonzero(raw)
        yield batch("bucket long,raw long,trusted long", seen, raw[seen], trusted[seen])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Fixed-point log ratio for each bucket; the frame has at most 2**BUCKET_BITS rows."""
    rows = counts.toPandas()
    raw = np.zeros(1 << BUCKET_BITS)
    trusted = np.zeros(1 << BUCKET_BITS)
    raw[rows["bucket"]] = rows["raw"]
    trusted[rows["bucket"]] = rows["trusted"]
    if not trusted.sum():
        return np.zeros(1 << BUCKET_BITS, np.int64)
    spread = SMOOTHING * len(raw)
    ratio = np.log((trusted + SMOOTHING) / (trusted.sum() + spread)) - np.log((raw + SMOOTHING) / (raw.sum() + spread))
    return np.rint(ratio * FIXED_POINT).astype(np.int64)


def _repeats(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys of texts: is it found elsewhere in its text, and is it found earlier there?"""
    own = tk.mix(key + tk.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), bool)
    earlier = np.zeros(len(own), bool)
    earlier[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, earlier


def measure(piece: tk.Slice, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The report's columns, but for the id, for each text of a slice."""
    data, offs = piece.data, piece.offsets
    starts, ends, first = tk.spans(piece, tk.IS_SPACE)
    prefix = tk.prefix_hash(data)
    words = tk.span_hash(prefix, starts, ends)
    counts = np.diff(first)
    characters = ((data & 0xC0) != 0x80) & ~tk.IS_SPACE[data]

    long_enough = np.where(counts >= 3, counts - 2, 0)
    at = np.concatenate([[0], np.cumsum(long_enough)])
    owner = np.repeat(np.arange(len(counts)), long_enough)
    begin = first[:-1][owner] + np.arange(at[-1]) - at[:-1][owner]
    key = words[begin] * tk.ORDER_VALUE[0] + words[begin + 1] * tk.ORDER_VALUE[1] + words[begin + 2] * tk.ORDER_VALUE[2] if len(begin) else np.zeros(0, np.uint64)
    again, _ = _repeats(owner, tk.mix(key))
    covered = np.zeros(len(words) + 3, np.int64)
    np.add.at(covered, begin[again], 1)
    np.add.at(covered, begin[again] + 3, -1)
    repeated = np.cumsum(covered)[: len(words)] > 0

    line_starts, line_ends, line_first = tk.spans(piece, _NEWLINE)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_owner = np.repeat(np.arange(len(counts)), np.diff(line_first))
    _, earlier = _repeats(line_owner, tk.span_hash(prefix, line_starts, line_ends))

    n_words, n_repeat = counts, tk.per_text_sums(repeated, first)
    code, gram_at = buckets(piece)
    total, grams = tk.per_text_sums(ratios[code], gram_at), np.diff(gram_at)
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words,
        "word_chars": tk.per_text_sums(characters, offs),
        "n_symbols": tk.per_text_sums(_SYMBOL[data], offs),
        "n_dup_lines": tk.per_text_sums(earlier & has_word, line_first),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "n_grams": grams,
        "llr": total / FIXED_POINT / np.maximum(grams, 1),
        "kept": ~failed & (total >= round(threshold * FIXED_POINT) * grams),
    }


def report(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts and the verdict for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in tk.slices(b.column(1)):
                found = measure(piece, sent.value, threshold)
                yield batch(REPORT, b.column(0).slice(piece.first, piece.last - piece.first), *found.values())

    schema = ", ".join(REPORT.split(","))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, schema)


def keep(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)
    where = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [measure(piece, sent.value, threshold)["kept"] for piece in tk.slices(b.column(where))]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(judge, docs.schema)


def trusted_sample(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> list[int]:
    """Ids of labelled documents of good quality that are not toxic: ``limit`` at most, chosen by hash."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull())
    return [r[0] for r in good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()]


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return log_ratios(gram_counts(docs, trusted_sample(labels)))
