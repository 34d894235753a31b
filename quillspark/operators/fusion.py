"""Fusion of ranked lists and score blending (AGG-8..12, MTH-2..4, WIN-8/9, QRY-6/9/10)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.values import above_floor, hybrid_blend, rerank_blend

# Reciprocal-rank constant, weight of the evidence channel, score floors, window sizes.
K = 60
EVIDENCE_WEIGHT = 1.15
DENSE_FLOOR, EVIDENCE_FLOOR = 0.28, 0.30
RERANK_WINDOW, RERANK_TOP = 60, 24
MAX_RESULTS = 250


def evidence_per_object(hits: DataFrame, object_col: str = "object_id", evidence_col: str = "evidence_id") -> DataFrame:
    """AGG-8: best score, first rank and the ids in rank order, for each object."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", evidence_col))), lambda x: x[evidence_col])
    return hits.groupBy("query_id", object_col).agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"), ids.alias("evidence_ids"))


def reciprocal_rank(channels: Mapping[str, tuple[DataFrame, float]], id_col: str, k: int = K) -> DataFrame:
    """AGG-9, JON-2: sum of weight / (k + rank) over channels; union and one aggregation instead of outer joins."""
    rows = reduce(DataFrame.unionByName, (df.select("query_id", id_col, "rank", F.lit(w).alias("w"), F.lit(name).alias("channel")) for name, (df, w) in channels.items()))
    return rows.groupBy("query_id", id_col).agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 8).alias("score"), F.sort_array(F.collect_set("channel")).alias("channels"))


def share_of_best(scores: DataFrame, score: str = "score", to: str = "share") -> DataFrame:
    """AGG-10."""
    best = F.max(score).over(Window.partitionBy("query_id"))
    return scores.withColumn(to, F.when(best > 0, F.col(score) / best).otherwise(0.0))


def hybrid(lexical: DataFrame, dense: DataFrame, dense_evidence: DataFrame, evidence_text: DataFrame, id_col: str = "object_id") -> DataFrame:
    """QRY-6: consensus of the two dense channels, outer fusion with lexical and evidence text, blended score.

    Inputs are ``(query_id, id, score, rank)``. Ranks of the dense lists are positions before any floor.
    """
    pairs = ((dense, DENSE_FLOOR), (dense_evidence, EVIDENCE_FLOOR))
    kept = [df.where(F.col("score") >= floor) for df, floor in pairs]
    consensus = reciprocal_rank({"object": (kept[0], 1.0), "evidence": (kept[1], EVIDENCE_WEIGHT)}, id_col)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    agreed = consensus.withColumn("rank", F.row_number().over(order))
    fused = reciprocal_rank({"lexical": (lexical, 1.0), "dense": (agreed, 1.0), "text": (evidence_text, EVIDENCE_WEIGHT)}, id_col)
    keys = ["query_id", id_col]
    named = lambda df, name: df.select(*keys, F.col("score").alias(name))
    joined = share_of_best(fused, to="fused")
    for df, name in ((share_of_best(lexical, to="s").select(*keys, F.col("s").alias("score")), "lex"), (share_of_best(evidence_text, to="s").select(*keys, F.col("s").alias("score")), "txt"), (kept[0], "obj"), (kept[1], "evi")):
        joined = joined.join(named(df, name), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    evidence = above_floor(zero("evi"), EVIDENCE_FLOOR)
    best = F.greatest(zero("lex"), zero("txt"), above_floor(zero("obj"), DENSE_FLOOR))
    out = joined.select(*keys, F.round(hybrid_blend(F.col("fused"), evidence, best), 6).alias("score"), "channels")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_RESULTS)


def reranked(results: DataFrame, relevance: DataFrame, id_col: str, window: int = RERANK_WINDOW, top: int = RERANK_TOP) -> DataFrame:
    """QRY-9: rows of the window that a judge scored go first by blended score; the tail keeps its order."""
    order = Window.partitionBy("query_id").orderBy("rank")
    prior = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    joined = results.withColumn("prior", prior).join(relevance.select("query_id", id_col, "relevance"), ["query_id", id_col], "left")
    judged = (F.col("rank") <= window) & F.col("relevance").isNotNull()
    blended = F.when(judged, F.round(rerank_blend(F.col("relevance"), F.col("prior")), 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("blended"), "rank"))
    chosen = joined.withColumn("blended", blended).withColumn("blended", F.when(place <= top, F.col("blended")))
    new = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("blended"), "rank"))
    return chosen.withColumn("new_rank", new).select("query_id", id_col, F.coalesce("blended", "score").alias("score"), F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank"))


def fused_queries(results: DataFrame, id_col: str, limit: int = MAX_RESULTS) -> DataFrame:
    """QRY-10: one list from the lists of several sub-queries (``axis``), scores scaled to 100 at the top."""
    summed = results.groupBy("query_id", id_col).agg(F.sum(1 / (K + F.col("rank"))).alias("p"), F.min("rank").alias("best_rank"), F.sort_array(F.collect_set("axis")).alias("axes"))
    scaled = summed.withColumn("score", F.round(100 * F.col("p") / F.max("p").over(Window.partitionBy("query_id")), 6)).drop("p")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scaled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def interleaved(channels: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """WIN-8, WIN-9: first of each list, then second of each ...; an id stays where it comes first."""
    rows = reduce(DataFrame.unionByName, (df.select("query_id", id_col, "rank", F.lit(i).alias("channel")) for i, df in enumerate(channels.values())))
    first = rows.groupBy("query_id", id_col).agg(F.min(F.struct("rank", "channel")).alias("p"))
    order = Window.partitionBy("query_id").orderBy("p", id_col)
    return first.withColumn("place", F.row_number().over(order)).select("query_id", id_col, "place")


def dominant(scores: DataFrame, label: str) -> DataFrame:
    """AGG-12: the label with the largest sum of scores, each counted as 1 at least."""
    sums = scores.groupBy("query_id", label).agg(F.sum(F.greatest(F.col("score"), F.lit(1.0))).alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("total"), label)
    return sums.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def joined_ids(rows: DataFrame, keys: list[str], order: list[str], array: str) -> DataFrame:
    """AGG-11: the distinct entries of arrays, in the order of the rows."""
    lists = F.array_sort(F.collect_list(F.struct(*order, array)))
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.transform(lists, lambda x: x[array]))).alias(array))


def channel_ranks(channels: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """JON-2: one row for each id of any channel with its rank in each; union and one aggregation instead of outer joins."""
    rows = reduce(DataFrame.unionByName, (df.select("query_id", id_col, "rank", F.lit(name).alias("channel")) for name, df in channels.items()))
    return rows.groupBy("query_id", id_col).agg(*(F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(name) for name in channels))


def consensus(objects: DataFrame, evidence: DataFrame, id_col: str) -> DataFrame:
    """WIN-2: positions by the agreement of two dense channels, ties by id; no two rows share one."""
    agreed = reciprocal_rank({"object": (objects, 1.0), "evidence": (evidence, EVIDENCE_WEIGHT)}, id_col)
    return agreed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
