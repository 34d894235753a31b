"""Exact vector search (TOP-1..3). Vectors are input data; an encoder is any function over batches (UDF-2)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a block of queries (or of the smaller side of another search), vectors of a part, and scores that are in memory at a time.
BLOCK_QUERIES, PART_VECTORS, SCORES = 2_000, 8_192, 1 << 21
#: Scores that differ by less may change places when they are rounded to six digits.
ROUNDED = 2e-6


def in_blocks(few: DataFrame, key: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` over blocks of about ``BLOCK_QUERIES`` rows, together; rows with one key share a block."""
    blocks = -(-few.count() // BLOCK_QUERIES) or 1
    return functools.reduce(DataFrame.unionByName, (search(few.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)) for k in range(blocks)))


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix with zeros for what is missing, and where they have components."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()  # without the components of null vectors
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, there = np.zeros((len(lists), width)), np.zeros((len(lists), width), bool)
    out[row, at] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    there[row, at] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return out, there


def _width(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)


def _pairs(keys: np.ndarray, k: int, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query, vector)`` of all whose key is among the query's ``k`` largest or within its slack of them, or not a number."""
    open_keys = np.isnan(keys)
    keys[open_keys] = -np.inf
    least = np.partition(keys, keys.shape[1] - k, axis=1)[:, -k] if keys.shape[1] > k else np.full(len(keys), -np.inf)
    return np.nonzero((keys >= np.where(np.isfinite(slack), least - slack, -np.inf)[:, None]) | open_keys)


def _candidates(x: np.ndarray, has_x: np.ndarray, q: np.ndarray, has_q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(query, vector, score, whether there is one)`` of all pairs that can be among a query's ``k`` best once scores are rounded.

    A matrix product finds them; what is returned is summed up component by component. Of equal sums the first ``k`` are enough.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        norms = [np.sqrt(np.where(np.isfinite(v), v, 0.0) ** 2 @ np.ones(v.shape[1])) for v in (x, q)]
        keys = q @ x.T
        if not (has_x.all() and has_q.all()):
            keys[has_q.astype(np.float32) @ has_x.T.astype(np.float32) == 0] = -np.inf  # no score comes last
        of_query, of_row = _pairs(keys, k, ROUNDED + 1e-12 * norms[1] * norms[0].max(initial=0.0))
        score, there = np.zeros(len(of_row)), np.zeros(len(of_row), bool)
        for j in range(x.shape[1]):
            both = has_q[of_query, j] & has_x[of_row, j]
            score += np.where(both, q[of_query, j] * x[of_row, j], 0.0)
            there |= both
    order = np.lexsort((of_row, score, there, of_query))
    of_query, of_row, score, there = (v[order] for v in (of_query, of_row, score, there))
    same = (np.diff(of_query, prepend=-1) == 0) & (np.diff(there, prepend=False) == 0) & ((np.diff(score, prepend=0.0) == 0) | (np.isnan(score) & np.isnan(np.roll(score, 1))))
    run = np.flatnonzero(~same)
    kept = np.arange(len(score)) - np.repeat(run, np.diff(np.append(run, len(score)))) < k
    return of_query[kept], of_row[kept], score[kept], there[kept]


def _best(k: int, id_col: str, vector: str, query_vector: str, group: str | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What each query can want of a part of the vectors; a part has at most some ``PART_VECTORS`` rows, a block some ``BLOCK_QUERIES``."""
    order = [(c, "ascending") for c in ((group,) if group else ()) + (id_col,)]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.select([c for c, _ in order]), sort_keys=order, null_placement="at_start")).drop_columns(["part", "block"])
        width = _width(rows[vector], queries[query_vector])
        (x, has_x), (q, has_q) = _matrix(rows[vector], width), _matrix(queries[query_vector], width)
        ends = np.array([len(x)])
        if group and len(x):
            codes = pc.dictionary_encode(rows[group], null_encoding="encode").combine_chunks()
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            ends = np.append(np.flatnonzero(np.diff(codes)) + 1, len(x))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            step = max(1, SCORES // max(1, end - start))
            for a in range(0, len(q), step):
                i, j, score, there = _candidates(x[start:end], has_x[start:end], q[a : a + step], has_q[a : a + step], k)
                found.append((i + a, j + start, score, there))
        i, j, score, there = (np.concatenate(c) for c in zip(*found, strict=True))
        out = rows.drop_columns([vector]).take(pa.array(j))
        return out.append_column("query_id", queries["query_id"].take(pa.array(i))).append_column("score", pa.array(score, mask=~there))

    return run


def scored(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "embedding", query_vector: str = "query_vector", group: str | None = None) -> DataFrame:
    """Every vector against every query ``(query_id, query_vector)``: the rows that can be among a query's ``k`` best, of each ``group`` if there is one.

    Vectors are dealt into parts and queries into blocks, both of bounded size, and each part meets each block in a task's
    memory. The score is the inner product in doubles, over the components that both have, rounded to six digits.
    """
    parts, blocks = (max(1, -(-df.count() // most)) for df, most in ((vectors, PART_VECTORS), (queries, BLOCK_QUERIES)))
    dealt = lambda df, column, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int").alias(column)
    each = lambda column, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)
    rows = vectors.select("*", dealt(vectors, "part", parts)).select("*", each("block", blocks))
    asked = queries.select("query_id", query_vector, dealt(queries, "block", blocks)).select("*", each("part", parts))
    kinds = [f for f in vectors.schema if f.name != vector]
    schema = StructType(kinds + [StructField("query_id", queries.schema["query_id"].dataType), StructField("score", DoubleType())])
    met = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(_best(k, id_col, vector, query_vector, group), schema)
    return met.withColumn("score", F.round("score", 6))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """TOP-1/2: the k best of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored(vectors, queries, k, id_col, vector).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_per_group(vectors: DataFrame, queries: DataFrame, n: int, group: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """TOP-3: the n best rows of each group for each query."""
    order = Window.partitionBy("query_id", group).orderBy(F.desc("score"), id_col)
    return scored(vectors, queries, n, id_col, vector, group=group).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def encoded(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], id_col: str, text_col: str, done: DataFrame | None = None) -> DataFrame:
    """SNK-6, UDF-2: vectors of texts by an encoder given by the caller; ids in ``done`` are passed over, so a run can go on."""
    todo = texts.join(done, id_col, "left_anti") if done is not None else texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "embedding": encode(b[text_col].fillna("").tolist())})

    kind = dict(texts.dtypes)[id_col]
    return todo.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")
