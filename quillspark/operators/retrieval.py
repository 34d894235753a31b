"""Search as a user asks for it: modes, batches, atomic queries, outside judges, and the benchmark made from it (QRY-7, QRY-8, QRY-17, UDF-3)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fusion, search
from .search import Index, QueryPlan

FULL_DEPTH, THIN_DEPTH = 1.1, 1.0


def browsed(docs: DataFrame, id_col: str, plans: Sequence[QueryPlan], depth: str) -> DataFrame:
    """QRY-7: without a topic every object is a result, full records before thin ones."""
    names = F.explode(F.array(*(F.lit(p.query_id) for p in plans)))
    score = F.when(F.col(depth) == "full", FULL_DEPTH).otherwise(THIN_DEPTH)
    return search.ranked(docs.select(names.alias("query_id"), id_col, score.alias("score")), id_col)


def searched(index: Index, plans: Sequence[QueryPlan], searchable: Column, mode: str = "bm25", channels: Mapping[str, DataFrame] | None = None, allowed: DataFrame | None = None, limit: int = fusion.MAX_RESULTS) -> DataFrame:
    """QRY-7: ``(query_id, id, score, rank)`` in mode ``bm25`` or ``hybrid``; ``shadow`` gives bm25 with the rank in hybrid.

    ``channels``: ranked lists ``dense``, ``evidence`` and ``text`` for hybrid. ``allowed`` holds the ids that filters
    left; they are gone before anything is counted.
    """
    if mode not in ("bm25", "hybrid", "shadow"):
        raise ValueError(f"no such mode: {mode}")
    key = index.id_col
    own = index if allowed is None else replace(index, docs=index.docs.join(allowed.select(key), key, "left_semi"))

    def hybrid() -> DataFrame:
        pick = lambda name: channels[name] if allowed is None else channels[name].join(allowed.select(key), key, "left_semi")
        lexical = search.two_stage_search(own, plans, searchable, limit=limit)
        return fusion.hybrid(lexical, pick("dense"), pick("evidence"), pick("text"), key).select("query_id", key, "score", "rank")

    if mode == "hybrid":
        return hybrid()
    plain = search.lexical_search(own, plans, searchable, limit).select("query_id", key, "score", "rank")
    return plain if mode == "bm25" else plain.join(hybrid().select("query_id", key, F.col("rank").alias("hybrid_rank")), ["query_id", key], "left")


def search_many(index: Index, plans: Sequence[QueryPlan], searchable: Column, pool: DataFrame | None = None, least: int = 0, limit: int = fusion.MAX_RESULTS) -> DataFrame:
    """QRY-8: many searches as one job; equal plans are searched once and share the result.

    With ``pool`` (query_id, id), the candidates of atomic queries, results come from it alone. A query with fewer than
    ``least`` strict results goes on, after these, with those of its pool that have any of its words (``relaxed``).
    """
    key = index.id_col
    first: dict[tuple, str] = {}
    shared = [(p.query_id, first.setdefault((p.terms, p.exact, p.groups, p.excluded, p.title_terms), p.query_id)) for p in plans]
    once = [p for p in plans if p.query_id in first.values()]
    found = search.lexical_search(index, once, searchable).select("query_id", key, "score", F.lit(False).alias("relaxed"))
    if pool is not None:
        found = found.join(pool, ["query_id", key], "left_semi")
        if least:
            n = found.groupBy("query_id").agg(F.count("*").alias("n"))
            loose = search.lexical_search(index, [replace(p, groups=(), title_terms=()) for p in once], searchable).select("query_id", key, "score", F.lit(True).alias("relaxed"))
            short = loose.join(pool, ["query_id", key], "left_semi").join(n, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).drop("n")
            found = found.unionByName(short.join(found, ["query_id", key], "left_anti"))
    order = Window.partitionBy("query_id").orderBy("relaxed", F.desc("score"), key)
    placed = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    names = index.docs.sparkSession.createDataFrame(shared, "asked string, query_id string")
    return placed.join(F.broadcast(names), "query_id").select(F.col("asked").alias("query_id"), key, "score", "relaxed", "rank")


def judged(results: DataFrame, judge: Callable[[str, list[str]], Sequence[tuple[int, float]]], id_col: str, window: int = fusion.RERANK_WINDOW) -> DataFrame:
    """UDF-3: relevance of each query's first ``window`` results by an outside judge, which gives (position, relevance) pairs.

    Columns: query_id, question, id, rank, text. An answer with a position out of range or twice, or a relevance outside
    0 to 1, is refused as a whole, and the query stays without relevance.
    """
    kind = dict(results.dtypes)[id_col]

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("rank")
        answer = list(judge(rows["question"].iloc[0], rows["text"].tolist()))
        places = [p for p, _ in answer]
        good = len(set(places)) == len(places) and all(0 <= p < len(rows) and 0 <= r <= 1 for p, r in answer)
        return pd.DataFrame([(rows["query_id"].iloc[p], rows[id_col].iloc[p], float(r)) for p, r in (answer if good else [])], columns=["query_id", id_col, "relevance"])

    few = results.where(F.col("rank") <= window).select("query_id", "question", id_col, "rank", "text")
    return few.groupBy("query_id").applyInPandas(ask, f"query_id string, `{id_col}` {kind}, relevance double")


def built_dataset(questions: DataFrame, matches: DataFrame, pooled: DataFrame, size: int = 12, reserve: int = 2) -> DataFrame:
    """QRY-17: the judgements of a benchmark. A rule's question has all its matches as gold; a pooled one the best of each
    leg first, then the best of the rest, to be judged; a question beyond the catalogue has none.

    ``questions``: (query_id, kind); ``matches``: (query_id, object_id); ``pooled``: (query_id, object_id, leg, score).
    """
    from .ranking import reserved_pool

    of = lambda kind: questions.where(F.col("kind") == kind).select("query_id")
    gold = matches.join(of("rule"), "query_id", "left_semi").select("query_id", "object_id", F.lit(3).alias("relevance"), F.lit("gold").alias("status")).distinct()
    pool = reserved_pool(pooled.join(of("pooled"), "query_id", "left_semi"), "leg", reserve, size, "object_id")
    return gold.unionByName(pool.select("query_id", "object_id", F.lit(None).cast("int").alias("relevance"), F.lit("pending").alias("status")))
