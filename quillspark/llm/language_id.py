"""Language ID with bit-sliced Bloom filters of hashed byte n-grams.

Training counts the n-grams of each language over all training rows, summed in each
task before the shuffle. A language contains an n-gram that is at least ``SHARE``
times as frequent in it as in the language where it is most frequent; all of these
enter its filter. All filters have the same bits,
stored position by position: one look-up gives the mask of all languages that have
that bit, and the AND over the hash functions the languages that contain the n-gram.

For each text the bits of each language are counted over its n-grams and corrected
for false positives: (hits - n * p) / (1 - p), where p is the language's share of
set bits to the power of the number of hash functions. The largest count decides,
the first name in order among equals; the score is its share of all counts.

Defined results: a null text, or one without letters, is ``und`` with score 0, and so
is every text if nothing was learned; a text whose n-grams are all unknown gets the
language most frequent in training with score 0; rows without a language are not
learned from; repeated rows each count; a very long text is scanned whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import batch, settled

ORDER = 3
GRAM_BITS = 20
FILTER_BITS = 20
HASHES = 3
SHARE = 0.5
#: Languages that a task counts at a time (4 MB each); it hands on what it has and starts anew.
COUNTED = 16
UNKNOWN = "und"

#: A-Z folded; everything that is no ASCII letter and below 0x80 becomes a space.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, those with two spaces together left out; and each text's first one."""
    d = _FOLD[piece.data]
    n = len(d) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(piece.offsets), np.int64)
    code = np.zeros(n, np.uint32)
    good = np.ones(n, bool)
    for k in range(ORDER):
        code = (code << np.uint32(8)) | d[k : n + k]
        if k:
            good &= (d[k : n + k] != 0x20) | (d[k - 1 : n + k - 1] != 0x20)
    for k in range(1, ORDER):
        ends = piece.offsets[1:] - k
        good[ends[(ends >= piece.offsets[:-1]) & (ends < n)]] = False
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    where = np.flatnonzero(good)
    return (code[where] >> np.uint32(32 - GRAM_BITS)).astype(np.int64), np.searchsorted(where, piece.offsets)


def held_out(id_col: str) -> Column:
    """The contract's fold: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@dataclass
class Filters:
    """``planes[k, p]``: the mask of languages 64 * k .. 64 * k + 63 with bit ``p`` set."""

    names: list[str]
    fallback: str
    planes: np.ndarray
    false_positive: np.ndarray

    def counts(self, piece: tk.Slice) -> np.ndarray:
        """Corrected count of each language for each text."""
        code, at = grams(piece)
        n = np.diff(at).astype(float)
        out = np.zeros((len(n), len(self.names)))
        spots = positions(code)
        for k, plane in enumerate(self.planes):
            mask = plane[spots[0]]
            for s in spots[1:]:
                mask = mask & plane[s]
            for j in range(64 * k, min(64 * k + 64, len(self.names))):
                hits = tk.per_text_sums((mask >> np.uint64(j - 64 * k)) & np.uint64(1), at)
                p = self.false_positive[j]
                out[:, j] = np.maximum((hits - n * p) / max(1 - p, 1e-9), 0)
        return out


def positions(code: np.ndarray) -> list[np.ndarray]:
    """Bit positions of n-grams for each hash function."""
    h = tk.mix(code.astype(np.uint64) + np.uint64(0x51ED27))
    return [((h >> np.uint64(k * 20)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def learned(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from the rows of ``docs`` where ``training`` holds and the language is known."""
    rows = docs.where(F.coalesce(training, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    known = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    names = [x for x, _ in known]
    number = {x: i for i, x in enumerate(names)}

    def counts_of(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for j, total in totals.items():
            seen = np.flatnonzero(total)
            yield batch("j int,gram long,n long", np.full(len(seen), j), seen, total[seen])
        totals.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            langs = np.array([number[x] for x in b.column(0).to_pylist()])
            for piece in tk.slices(b.column(1)):
                code, at = grams(piece)
                owner = np.repeat(langs[piece.first : piece.last], np.diff(at))
                for j in np.unique(owner).tolist():
                    if j not in totals:
                        if len(totals) == COUNTED:
                            yield from counts_of(totals)
                        totals[j] = np.zeros(1 << GRAM_BITS, np.int32)
                    totals[j] += np.bincount(code[owner == j], minlength=1 << GRAM_BITS).astype(np.int32)
        yield from counts_of(totals)

    counts = settled(lambda: rows.mapInArrow(count, "j int, gram long, n long").groupBy("j", "gram").agg(F.sum("n").alias("n")))
    # a row for each language, and one for each n-gram: both are bounded by the filters
    rated = counts.join(F.broadcast(counts.groupBy("j").agg(F.sum("n").alias("total"))), "j").withColumn("rate", F.col("n") / F.col("total"))
    chosen = rated.join(rated.groupBy("gram").agg(F.max("rate").alias("most")), "gram").where(F.col("rate") >= SHARE * F.col("most"))
    found = chosen.select("j", "gram").toPandas()
    planes = np.zeros((-(-len(names) // 64) or 1, 1 << FILTER_BITS), np.uint64)
    for j in range(len(names)):
        code = found["gram"][found["j"] == j].to_numpy(np.int64)
        for s in positions(code):
            planes[j // 64, s] |= np.uint64(1) << np.uint64(j % 64)
    fill = np.array([((planes[j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean() for j in range(len(names))])
    return Filters(names, max(known, key=lambda x: (x[1], x[0]))[0] if known else UNKNOWN, planes, fill**HASHES)


def predicted(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A language and a score for every row; nothing but the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sent.value
        names = [*tool.names, UNKNOWN, tool.fallback]
        for b in batches:
            for piece in tk.slices(b.column(2)):
                size = piece.last - piece.first
                counts = tool.counts(piece)
                total = counts.sum(axis=1)
                best = counts.argmax(axis=1) if tool.names else np.full(size, -2)
                best[total <= 0] = -1
                score = np.where(total > 0, counts.max(axis=1, initial=0) / np.maximum(total, 1e-12), 0.0)
                letters = tk.per_text_sums((_FOLD[piece.data] != 0x20) & (piece.data < 0x80), piece.offsets)
                for r in np.flatnonzero(letters == 0):
                    text = piece.data[piece.offsets[r] : piece.offsets[r + 1]].tobytes().decode()
                    if not any(c.isalpha() for c in text):
                        best[r], score[r] = -2, 0.0
                part = b.slice(piece.first, size)
                yield batch("doc_id long,held_out boolean,lang_pred string,score double", part.column(0), part.column(1), [names[k] for k in best], score)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInArrow(decide, "doc_id long, held_out boolean, lang_pred string, score double")


def report(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return predicted(docs, learned(docs, ~held_out(id_col), lang_col, text_col), id_col, text_col)
