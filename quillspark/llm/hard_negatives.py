"""Hard negatives from a pivot table.

Components become integers, and each row gets one more coordinate, ``sqrt(M - norm)`` with M the largest
squared norm, so that all rows lie on one sphere: the inner product of an anchor (whose extra coordinate is 0)
with a row is ``(anchor's norm + M - squared distance) / 2``. The distances of every row to ``PIVOTS`` pivots are
stored beside it, rows with like distances next to each other. By the triangle inequality the differences of
two rows' stored distances bound their distance from below, and the sums from above, which brackets the score: first
for a whole block of rows by the block's smallest and largest distances, then row by row. Only rows whose
bracket reaches what an anchor still wants get an exact integer product.

Anchors are taken in blocks of ``BLOCK_ANCHORS`` and compared with the whole table, a job for the positives
and one for the negatives. A task keeps the best few of each anchor; a rank within each anchor merges the tasks.

Pivots are chosen, each farthest from those before, among ``PIVOT_SAMPLE`` rows; the choice changes
how much is pruned, never the result, and every row is in the table.

Defined results: rows with a null id, label, vector or component, with a component that is not finite, or
without components take no part. Of several rows with one id, the one with the smallest (label, vector) takes part.
Vectors of different lengths are compared over the components that both have. Equal scores come by smaller id.
An anchor without a positive, or whose window is empty, has no rows; an empty table gives none. Extra columns are
not read. Scores are exact below 2**53 and integers of 64 bits beyond.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import settled, written

# Fixed values of the task: which rows are anchors, which labels move on, the window in hundredths of the positive's score.
ANCHOR_EVERY, MOVED_EVERY, LABELS = 50, 7, 10
WINDOW = (50, 95)
POSITIVES, NEGATIVES = 5, 3
SCALE = 256
#: Pivots, the rows among which they are chosen, anchors in a block, rows in a block.
PIVOTS, PIVOT_SAMPLE, BLOCK_ANCHORS, BLOCK_ROWS = 8, 1024, 2048, 512

_LEAST = np.iinfo(np.int64).min
_TABLE = "vec_id long, label long, vector binary, distances binary, cell int, near double"


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, v, norm)`` of the rows that take part, components as integers."""
    finite = F.forall(F.col("v"), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    one = own.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    label = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("r.label") + 1) % LABELS).otherwise(F.col("r.label"))
    whole = one.select("vec_id", label.alias("label"), F.transform("r.v", lambda x: F.floor(x * SCALE)).alias("v"))
    return whole.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    out = np.zeros((len(column), width), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - offsets[:-1][row]] = flat
    return out


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that puts all of them on one sphere."""
    real = v.astype(np.float64)
    return np.concatenate([real, np.sqrt(np.maximum(most - (real * real).sum(1), 0))[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], axis=1)


def pivots_among(sample: np.ndarray, most: float, n: int = PIVOTS) -> np.ndarray:
    """Points of the sample, each farthest from those chosen before."""
    points = _lifted(sample, most)
    chosen = [0]
    far = _distances(points, points[:1])[:, 0]
    while len(chosen) < min(n, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


@dataclass
class Shape:
    width: int
    most: float
    pivots: np.ndarray


def pivot_table(rows: DataFrame) -> tuple[DataFrame, Shape] | None:
    """The table of all rows with their distances to the pivots, ordered by nearest pivot and distance; nothing if there are no rows."""
    width, most = rows.agg(F.max(F.size("v")), F.max("norm")).first()
    if width is None:
        return None
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow().column(0)
    shape = Shape(width, most, pivots_among(_stacked(few, width), most))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _stacked(b.column(2), shape.width)
            d = _distances(_lifted(v, shape.most), shape.pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary()), pa.array([x.tobytes() for x in d.astype("<f8")], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[x.split()[0] for x in _TABLE.split(", ")])

    placed = rows.select("vec_id", "label", "v").mapInArrow(place, _TABLE)
    # the id splits many rows with one vector
    return written(written(placed).repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id")), shape


@dataclass
class Rows:
    """Some rows of the table as arrays."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    distances: np.ndarray

    def part(self, at: np.ndarray | slice) -> Rows:
        return Rows(self.ids[at], self.labels[at], self.v[at], self.distances[at])


def _arrays(b: pa.RecordBatch | pa.Table) -> Rows:
    binary = lambda k, kind: np.frombuffer(b"".join(b.column(k).to_pylist()), kind).reshape(b.num_rows, -1)
    return Rows(b.column(0).to_numpy(), b.column(1).to_numpy(), binary(2, "<i8"), binary(3, "<f8"))


def brackets(anchors: Rows, rows: Rows, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each anchor's score with each row, from stored distances alone."""
    shape = (len(anchors.ids), len(rows.ids))
    gap, reach = np.zeros(shape), np.full(shape, np.inf)
    for p in range(rows.distances.shape[1]):
        a, r = anchors.distances[:, p, None], rows.distances[None, :, p]
        np.maximum(gap, np.abs(a - r), out=gap)
        np.minimum(reach, a + r, out=reach)
    norms = (anchors.v.astype(np.float64) ** 2).sum(1)[:, None]
    slack = 1.0 + 1e-9 * (norms + most)
    return (norms + most - reach * reach) / 2 - slack, (norms + most - gap * gap) / 2 + slack


def _block_brackets(anchors: Rows, rows: Rows, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The same for all rows of a block at once, from their smallest and largest distances."""
    low, high = rows.distances.min(0), rows.distances.max(0)
    gap = np.maximum(np.maximum(anchors.distances - high, low - anchors.distances), 0).max(1)
    reach = (anchors.distances + high).min(1)
    norms = (anchors.v.astype(np.float64) ** 2).sum(1)
    slack = 1.0 + 1e-9 * (norms + most)
    return (norms + most - reach * reach) / 2 - slack, (norms + most - gap * gap) / 2 + slack


def _exact(anchors: Rows, rows: Rows, alive: np.ndarray) -> np.ndarray:
    """Integer scores where ``alive``, the least number elsewhere."""
    out = np.full(alive.shape, _LEAST)
    largest = float(np.abs(anchors.v).max(initial=0)) * float(np.abs(rows.v).max(initial=0)) * anchors.v.shape[1]
    kind = np.float64 if largest < 2**53 else np.int64
    if alive.mean() > 0.05:
        every = anchors.v.astype(kind) @ rows.v.astype(kind).T
        out[alive] = every[alive].astype(np.int64)
    else:
        i, j = np.nonzero(alive)
        out[i, j] = (anchors.v[i] * rows.v[j]).sum(1)
    return out


class Best:
    """For each slot (an anchor, or an anchor and one of its positives) the best rows so far."""

    def __init__(self, slots: int, top: int):
        self.scores = np.full((slots, top), _LEAST)
        self.ids = np.zeros((slots, top), np.int64)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """A matrix of scores, a row for each of ``slots``; the least number stands for none."""
        top = self.scores.shape[1]
        bar = np.maximum(self.least[slots], _LEAST + 1)
        if scores.shape[1] > top:
            bar = np.maximum(bar, np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top])
        i, j = np.nonzero(scores >= bar[:, None])
        if not len(i):
            return
        touched = np.unique(i)
        old = np.repeat(touched, top)
        slot = np.concatenate([i, old])
        score = np.concatenate([scores[i, j], self.scores[slots[touched]].ravel()])
        own = np.concatenate([ids[j], self.ids[slots[touched]].ravel()])
        order = np.lexsort((own, ~score, slot))
        slot, score, own = slot[order], score[order], own[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < top
        self.scores[slots[slot[first]], place[first]] = score[first]
        self.ids[slots[slot[first]], place[first]] = own[first]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            yield _arrays(b.slice(at, BLOCK_ROWS))
        tk.give_back()


def _found(best: Best, slots: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    i, k = np.nonzero(best.scores > _LEAST)
    return pa.RecordBatch.from_arrays([*(pa.array(c[slots[i]]) for c in columns), pa.array(best.ids[i, k]), pa.array(best.scores[i, k])], names=names)


def _positives(table: DataFrame, anchors: Rows, most: float) -> DataFrame:
    """``(anchor_id, positive_id, positive_score)`` of the best rows of each task with the anchor's label."""
    sent = table.sparkSession.sparkContext.broadcast(anchors)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors.ids), POSITIVES)
        for block in _blocks(batches):
            reached = _block_brackets(anchors, block, most)[1] >= best.least
            for label in np.unique(block.labels):
                slots = np.flatnonzero(reached & (anchors.labels == label))
                if not len(slots):
                    continue
                own, rows = anchors.part(slots), block.part(block.labels == label)
                alive = (brackets(own, rows, most)[1] >= best.least[slots, None]) & (own.ids[:, None] != rows.ids[None, :])
                best.add(slots, _exact(own, rows, alive), rows.ids)
        yield _found(best, np.arange(len(anchors.ids)), [anchors.ids], ["anchor_id", "positive_id", "positive_score"])

    each = table.mapInArrow(scan, "anchor_id long, positive_id long, positive_score long")
    return _first(each, ["anchor_id"], "positive_score", "positive_id", POSITIVES)


def _first(each: DataFrame, by: list[str], score: str, row: str, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), row)
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _negatives(table: DataFrame, anchors: Rows, at: np.ndarray, positive: np.ndarray, score: np.ndarray, most: float) -> DataFrame:
    """The best rows of each task in the window of each pair: ``at`` gives the pair's anchor, sorted."""
    low, high = -(-WINDOW[0] * score // 100), WINDOW[1] * score // 100
    sent = table.sparkSession.sparkContext.broadcast((anchors, at, positive, score, low, high))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, at, positive, score, low, high = sent.value
        best = Best(len(at), NEGATIVES)
        with_pairs, first = np.unique(at, return_index=True)
        turn = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        own_all = anchors.part(with_pairs)
        last = np.maximum.reduceat(high, first) if len(at) else high
        pairs_of = [np.flatnonzero(turn == k) for k in range(turn.max(initial=-1) + 1)]
        for block in _blocks(batches):
            wanted = np.maximum(low, best.least)
            wanted = np.minimum.reduceat(np.where(wanted > high, np.iinfo(np.int64).max, wanted), first) if len(at) else wanted
            least, largest = _block_brackets(own_all, block, most)
            open_at = np.flatnonzero((largest >= wanted) & (least <= last))
            if not len(open_at):
                continue
            own = own_all.part(open_at)
            least, largest = brackets(own, block, most)
            alive = (largest >= wanted[open_at, None]) & (least <= last[open_at, None]) & (own.labels[:, None] != block.labels[None, :])
            exact = _exact(own, block, alive)
            here = np.full(len(with_pairs), -1)
            here[open_at] = np.arange(len(open_at))
            for pairs in pairs_of:
                row = here[np.searchsorted(with_pairs, at[pairs])]
                pairs, row = pairs[row >= 0], row[row >= 0]
                scores = exact[row]
                inside = (scores >= low[pairs, None]) & (scores <= high[pairs, None])
                best.add(pairs, np.where(inside, scores, _LEAST), block.ids)
        yield _found(best, np.arange(len(at)), [anchors.ids[at], positive, score], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    each = table.mapInArrow(scan, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(each, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """For each anchor and positive, the first different-label rows within the window, by falling score."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], MINED)

    def all_blocks() -> DataFrame:
        made = pivot_table(written(prepared(rows, id_col, vector_col, label_col)))
        if made is None:
            return nothing
        table, shape = made
        n = table.where(F.col("vec_id") % ANCHOR_EVERY == 0).count()
        blocks = -(-n // block_anchors)
        anchors = written(table.where(F.col("vec_id") % ANCHOR_EVERY == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))), "block")
        found = []
        for k in range(blocks):
            few = anchors.where(F.col("block") == k).select("vec_id", "label", "vector", "distances").toArrow()
            if not few.num_rows:
                continue
            own = _arrays(few)
            own.distances = _distances(np.concatenate([own.v.astype(np.float64), np.zeros((len(own.ids), 1))], axis=1), shape.pivots)
            own = own.part(np.argsort(own.ids))
            pairs = _positives(table.select("vec_id", "label", "vector", "distances"), own, shape.most).toArrow()
            at = np.searchsorted(own.ids, pairs.column("anchor_id").to_numpy())
            order = np.argsort(at, kind="stable")
            part = _negatives(table.select("vec_id", "label", "vector", "distances"), own, at[order], pairs.column("positive_id").to_numpy()[order], pairs.column("positive_score").to_numpy()[order], shape.most)
            found.append(written(part.select(*(x.split()[0] for x in MINED.split(", ")))))
        return functools.reduce(DataFrame.unionByName, found) if found else nothing

    return settled(all_blocks)
