"""Scores of retrieval runs against judgements (AGG-13..24, JON-3/13/14, QRY-18, SNK-9).

``run``: (query_id, object_id, rank). ``qrels``: (query_id, object_id, relevance, scored) where an
unscored judgement is pending. Means are over queries with at least one relevant scored judgement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 2
RECALL_AT, NDCG_AT, MRR_AT, SUCCESS_AT = 50, 10, 10, 5


def _gain(grade: str) -> F.Column:
    return F.pow(F.lit(2.0), F.col(grade)) - 1


def per_query(run: DataFrame, qrels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """AGG-13: recall, nDCG, reciprocal rank and success of each query with a relevant judgement."""
    scored = qrels.where("scored")
    relevant = scored.where(F.col("relevance") >= threshold).groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "object_id")
    ideal = scored.withColumn("p", F.row_number().over(order)).where(F.col("p") <= NDCG_AT).groupBy("query_id").agg(F.sum(_gain("relevance") / F.log2(F.col("p") + 1)).alias("ideal"))
    joined = run.join(qrels, ["query_id", "object_id"], "left")
    grade = F.coalesce("relevance", F.lit(0))
    hit = F.coalesce(F.col("scored"), F.lit(False)) & (grade >= threshold)
    found = joined.withColumn("g", grade).groupBy("query_id").agg(
        F.count_if(hit & (F.col("rank") <= RECALL_AT)).alias("found"),
        F.sum(F.when(F.col("rank") <= NDCG_AT, _gain("g") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    out = relevant.join(ideal, "query_id", "left").join(found, "query_id", "left")
    first = F.col("first")
    return out.select(
        "query_id",
        F.round(F.coalesce("found", F.lit(0)) / F.col("n_relevant"), 8).alias("recall"),
        F.round(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0), 8).alias("ndcg"),
        F.round(F.when(first <= MRR_AT, 1 / first).otherwise(0.0), 8).alias("mrr"),
        F.coalesce((first <= SUCCESS_AT).cast("double"), F.lit(0.0)).alias("success"),
    )


def macro_means(scores: DataFrame, metrics: Sequence[str] = ("recall", "ndcg", "mrr", "success"), by: Sequence[str] = ()) -> DataFrame:
    """Means over queries, AGG-24 with ``by``."""
    return scores.groupBy(*by).agg(F.count("*").alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def leg_coverage(run: DataFrame, required: DataFrame, legs: DataFrame, qrels: DataFrame, at: int, threshold: int = THRESHOLD) -> DataFrame:
    """AGG-14: share of each query's required legs that its first ``at`` results show; and whether all are shown.

    A leg counts only through relevant, scored judgements (``legs``: query_id, object_id, leg); a query counts only
    if each of its legs has one.
    """
    good = qrels.where(F.coalesce("scored", F.lit(False)) & (F.col("relevance") >= threshold)).select("query_id", "object_id").distinct()
    judged = legs.join(good, ["query_id", "object_id"], "left_semi")
    possible = required.join(judged.select("query_id", "leg").distinct(), ["query_id", "leg"], "left_semi").groupBy("query_id").agg(F.count("*").alias("possible"))
    shown = run.where(F.col("rank") <= at).join(judged, ["query_id", "object_id"]).select("query_id", "leg").distinct()
    met = required.join(shown.withColumn("hit", F.lit(1)), ["query_id", "leg"], "left").groupBy("query_id").agg(F.count("*").alias("legs"), F.count("hit").alias("met"))
    return met.join(possible, "query_id").where("possible = legs").select("query_id", F.round(F.col("met") / F.col("legs"), 8).alias("share"), (F.col("met") == F.col("legs")).alias("complete"))


def stage_quality(stages: DataFrame, qrels: DataFrame, closed: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """AGG-18: for each stage: recall of the known pool, nDCG of judged results, judged precision, unjudged rate.

    ``stages``: (stage, query_id, object_id, rank); ``closed``: queries whose unjudged objects are irrelevant.
    """
    world = closed.select("query_id").distinct().withColumn("closed", F.lit(True))
    rows = stages.join(qrels.where("scored").select("query_id", "object_id", "relevance"), ["query_id", "object_id"], "left").join(world, "query_id", "left")
    rows = rows.withColumn("judged", F.col("relevance").isNotNull() | F.coalesce("closed", F.lit(False))).withColumn("g", F.coalesce("relevance", F.lit(0)))
    order = Window.partitionBy("stage", "query_id", "judged").orderBy("rank")
    placed = rows.withColumn("p", F.row_number().over(order))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "object_id")
    scored = qrels.where("scored")
    ideal = scored.withColumn("p", F.row_number().over(ranked)).where(F.col("p") <= NDCG_AT).groupBy("query_id").agg(F.sum(_gain("relevance") / F.log2(F.col("p") + 1)).alias("ideal"), )
    relevant = scored.where(F.col("relevance") >= threshold).groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    each = placed.groupBy("stage", "query_id").agg(
        F.count_if(F.col("judged") & (F.col("g") >= threshold)).alias("hits"),
        F.count_if(F.col("judged")).alias("judged"),
        F.count("*").alias("results"),
        F.sum(F.when(F.col("judged") & (F.col("p") <= NDCG_AT), _gain("g") / F.log2(F.col("p") + 1)).otherwise(0.0)).alias("dcg"),
    )
    full = each.join(relevant, "query_id").join(ideal, "query_id")
    return full.groupBy("stage").agg(
        F.count("*").alias("queries"),
        F.round(F.avg(F.col("hits") / F.col("n_relevant")), 6).alias("known_recall"),
        F.round(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))), 6).alias("condensed_ndcg"),
        F.round(F.sum("hits") / F.sum("judged"), 6).alias("judged_precision"),
        F.round(1 - F.sum("judged") / F.sum("results"), 6).alias("unjudged_rate"),
    )


def percentiles(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """AGG-17: nearest-rank percentiles."""
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.max(value).cast("double").alias("max"))


def support_rate(accepted: DataFrame, qrels: DataFrame) -> DataFrame:
    """AGG-15: accepted results that cite a supporting evidence id, over all accepted results."""
    pairs = accepted.join(qrels.select("query_id", "object_id", "supporting"), ["query_id", "object_id"], "left")
    ok = F.coalesce(F.arrays_overlap("evidence_ids", "supporting"), F.lit(False))
    return pairs.agg(F.count("*").alias("accepted"), F.count_if(ok).alias("supported"), F.round(F.avg(ok.cast("double")), 6).alias("rate"))


def answerability(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """AGG-16: how often the answer's status is the expected one; how often "supported" is given where nothing is."""
    joined = questions.join(runs.select("query_id", "answerability"), "query_id", "left")
    boundary = F.col("expected") == "unsupported"
    wrong = boundary & (F.col("answerability") == "supported")
    return joined.agg(F.round(F.avg((F.coalesce("answerability", F.lit("")) == F.col("expected")).cast("double")), 6).alias("accuracy"), F.round(F.avg(F.when(boundary, F.coalesce(wrong, F.lit(False)).cast("double"))), 6).alias("false_support"))


def deltas(baseline: DataFrame, candidate: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """AGG-23: candidate less baseline for each metric; null where either is missing."""
    a, b = baseline.select(metric, F.col(value).alias("baseline")), candidate.select(metric, F.col(value).alias("candidate"))
    return a.join(b, metric, "full_outer").withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6))


def pool_scores(accepted: DataFrame, labels: DataFrame, slots: int = 5) -> DataFrame:
    """AGG-22: reviewed coverage, precision of reviewed rows, missing slots, and short, empty and full lists."""
    rows = accepted.join(labels, ["query_id", "object_id"], "left")
    each = rows.groupBy("query_id").agg(F.count("object_id").alias("n"), F.count("relevance").alias("reviewed"), F.count_if(F.col("relevance") >= THRESHOLD).alias("good"))
    return each.agg(
        F.count("*").alias("queries"),
        F.round(F.sum("reviewed") / F.sum("n"), 6).alias("coverage"),
        F.round(F.sum("good") / F.sum("reviewed"), 6).alias("precision"),
        F.sum(F.greatest(F.lit(slots) - F.col("n"), F.lit(0))).alias("missing_slots"),
        F.count_if(F.col("n") == 0).alias("empty"),
        F.count_if((F.col("n") > 0) & (F.col("n") < slots)).alias("short"),
        F.count_if(F.col("n") >= slots).alias("full"),
    )


def overlaid(qrels: DataFrame, reviews: DataFrame, keys: Sequence[str] = ("query_id", "object_id")) -> DataFrame:
    """JON-13: judgements with what reviews say instead, column by column."""
    columns = [c for c in qrels.columns if c not in keys]
    newer = reviews.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns if c in reviews.columns))
    out = qrels.join(newer, list(keys), "left")
    return out.select(*keys, *(F.coalesce(f"__{c}", c).alias(c) if c in reviews.columns else F.col(c) for c in columns))


def merged_labels(*pools: DataFrame, keys: Sequence[str] = ("query_id", "object_id")) -> DataFrame:
    """JON-14: labels of disjoint pools; a key that two pools have is an error when the result is used."""
    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in keys]
    one = F.when(F.count("*") > 1, F.raise_error(F.concat_ws(" ", F.lit("labelled twice:"), *keys)))
    return out.groupBy(*keys).agg(one.alias("__e"), F.any_value(F.struct(*rest)).alias("r")).where("__e IS NULL").select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def overlap_at(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """AGG-35: results that two rankings share among their first ``k``."""
    few = [df.where(F.col("rank") <= k).select("query_id", "object_id") for df in (a, b)]
    return few[0].join(few[1], ["query_id", "object_id"]).groupBy("query_id").agg(F.count("*").alias("shared"))


def markdown(report: DataFrame, title: str) -> str:
    """SNK-9: a report frame as a Markdown table, all its rows; a report is an aggregate, as long as its groups are many."""
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in report.toLocalIterator())]) + "\n"
