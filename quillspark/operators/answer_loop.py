"""Retrieve, audit, recover, expand: a bounded fixpoint over the questions that are still open (QRY-20).

A round shows each open question the next window of rows that it has not seen, a judge decides, and gates close the
questions that have enough accepted objects of all required legs. Later rounds show first what serves a missing leg, then
what has curatorial text. A question whose pool is used up may get more rows once, for reasons on a list; rows that were
accepted stay at the head. The loop ends when nothing is left to show; each round is written, so a lost executor repeats one round.

Pools are dealt by question once and read in place after that. A round writes what it shows, what is accepted and one row for
each open question, which holds the objects seen so far (``MOST_WINDOW`` a round at most); it never moves the pool.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.shared import dealt, kept

# Rows shown to a judge at a time, and the length from which a text counts as curatorial.
LEAST_WINDOW, MOST_WINDOW, PER_OBJECT = 20, 32, 4
CURATORIAL = 40
TOO_FEW, MISSING_LEG = "too_few", "missing_leg"
#: A pool of P rows needs P / LEAST_WINDOW rounds at most.
MAX_ROUNDS = 64
#: Rows of a pool and questions that one task works on, unless a single question has more.
PART_ROWS = 100_000

Judge = Callable[[DataFrame], DataFrame]


def window_size(count: Column, configured: int = MOST_WINDOW) -> Column:
    """How many rows of a question are shown at a time."""
    return F.least(F.greatest(PER_OBJECT * count, F.lit(LEAST_WINDOW)), F.lit(configured), F.lit(MOST_WINDOW))


def _reason() -> Column:
    """Why a question is open; null if it is not."""
    return F.when(F.col("accepted") < F.col("count"), TOO_FEW).when(F.size("missing") > 0, MISSING_LEG)


def _parts(*tables: DataFrame) -> int:
    return max(1, -(-sum(t.count() for t in tables) // PART_ROWS))


def _shown(live: DataFrame, pool: DataFrame, configured: int) -> DataFrame:
    """The next window of each question: by missing leg and curatorial text after the first round, then by rank."""
    asked = live.select("query_id", "count", "missing", "seen", "round", "offset").hint("shuffle_hash")
    left = pool.join(asked, "query_id").where(~F.array_contains("seen", F.struct("object_id"))).drop("seen")
    later = F.col("round") > 0
    serves = later & F.arrays_overlap("legs", "missing")
    told = later & (F.coalesce(F.length("text"), F.lit(0)) >= CURATORIAL)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(serves), F.desc(told), "rank", "object_id"))
    shown = left.withColumn("place", place).where(F.col("place") <= MOST_WINDOW).where(F.col("place") <= window_size(F.col("count"), configured))
    return shown.select("query_id", "object_id", (F.col("rank") + F.col("offset")).alias("rank"), "legs", "text", "round")


def _rounds(live: DataFrame, pool: DataFrame, judge: Judge, parts: int, configured: int, max_rounds: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Rounds until each question of ``live`` is closed or has seen its whole pool: the questions that left in each round, and what was accepted."""
    left, accepted = [], []
    going = ~F.col("idle") & F.col("reason").isNotNull() & (F.col("round") < max_rounds)
    left.append(live.where(~going))
    live = live.where(going)
    while not live.isEmpty():
        shown = dealt(_shown(live, pool, configured), parts, "query_id")
        # nothing moves here: a judge that goes row by row leaves its decisions where the rows are
        verdicts = judge(shown).where("accepted").repartition(parts, "query_id").groupBy("query_id").agg(F.collect_list(F.struct("object_id", F.col("score").cast("double").alias("score"))).alias("ok"))
        good = shown.drop("text").join(verdicts.hint("shuffle_hash"), "query_id").withColumn("ok", F.explode(F.filter("ok", lambda v: v["object_id"] == F.col("object_id"))))
        good = dealt(good.withColumn("score", F.col("ok.score")).drop("ok"), parts, "query_id")
        accepted.append(good)
        seen = shown.groupBy("query_id").agg(F.collect_list(F.struct("object_id")).alias("now"), F.max("rank").alias("furthest"))
        gained = good.groupBy("query_id").agg(F.count("*").alias("more"), F.array_distinct(F.flatten(F.collect_set("legs"))).alias("held"))
        moved = live.drop("reason", "idle").join(seen.hint("shuffle_hash"), "query_id", "left").join(gained.hint("shuffle_hash"), "query_id", "left")
        moved = moved.withColumns({
            "accepted": F.col("accepted") + F.coalesce("more", F.lit(0)),
            "missing": F.array_except("missing", F.coalesce("held", F.array().cast("array<string>"))),
            "seen": F.when(F.col("now").isNull(), F.col("seen")).otherwise(F.concat("seen", "now")),
            "behind": F.greatest("behind", "furthest"),
            "idle": F.col("now").isNull(),
            "round": F.col("round") + F.when(F.col("now").isNull(), 0).otherwise(1),
        })
        moved = moved.withColumn("rounds", F.when(F.col("idle"), F.col("rounds")).otherwise(F.col("round"))).withColumn("reason", _reason())
        moved = dealt(moved.select(*live.columns), parts, "query_id")
        left.append(moved.where(~going))
        live = moved.where(going)
    return left, accepted


def answered(questions: DataFrame, pool: DataFrame, judge: Judge, expand: Judge | None = None, expandable: Sequence[str] = (TOO_FEW, MISSING_LEG), configured: int = MOST_WINDOW, max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """``(states, accepted)`` of all questions.

    ``questions``: (query_id, count, required); ``pool``: (query_id, object_id, rank, legs, text), one row for an
    object of a question. ``judge`` gives (query_id, object_id, accepted, score) for shown rows; a row without a decision counts as
    rejected. ``expand`` gives more pool rows for open questions; objects that a question has seen are passed over.

    ``states``: (query_id, status, accepted, missing, rounds, expanded): ``supported`` with enough objects of all legs,
    ``partial`` with some, else ``unsupported``. ``accepted``: (query_id, object_id, round, score, place), first
    rounds first, within a round by falling score, then rank.
    """
    none = F.array().cast("array<string>")
    asked = kept(questions.select("query_id", "count", F.coalesce("required", none).alias("required")))
    columns = ("query_id", "object_id", F.col("rank").cast("long").alias("rank"), F.coalesce("legs", none).alias("legs"), "text")
    pool = kept(pool.join(asked.select("query_id"), "query_id", "left_semi").select(*columns))
    parts = _parts(asked, pool)
    start = asked.select("*", F.lit(0).cast("long").alias("accepted"), F.array_distinct("required").alias("missing"), F.array().cast(f"array<struct<object_id:{dict(pool.dtypes)['object_id']}>>").alias("seen"), *(F.lit(0).alias(c) for c in ("round", "rounds")), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("behind"), F.lit(False).alias("idle"), F.lit(False).alias("expanded"))
    start = dealt(start.withColumn("reason", _reason()).repartition(parts, "query_id"), parts, "query_id")
    left, accepted = _rounds(start, dealt(pool.repartition(parts, "query_id"), parts, "query_id"), judge, parts, configured, max_rounds)
    states = functools.reduce(DataFrame.unionByName, left)
    if expand is not None:
        # questions are independent of each other: all that can be expanded are, at once, and each goes on from its own round
        once = F.coalesce(F.col("idle") & F.col("query_id").isNotNull() & F.col("reason").isin(*expandable), F.lit(False))
        ready = kept(states.where(once).withColumns({"expanded": F.lit(True), "idle": F.lit(False), "round": F.col("round") + 1, "offset": F.coalesce("behind", F.lit(0).cast("long"))}))
        if not ready.isEmpty():
            more = kept(expand(ready.select("query_id", "count", "required", "missing", "reason")).select(*columns))
            parts = _parts(ready, more)
            more = dealt(more.repartition(parts, "query_id").dropDuplicates(["query_id", "object_id"]), parts, "query_id")
            later, gains = _rounds(dealt(ready.repartition(parts, "query_id"), parts, "query_id"), more, judge, parts, configured, max_rounds)
            states, accepted = functools.reduce(DataFrame.unionByName, later, states.where(~once)), accepted + gains
    status = F.when(F.col("reason").isNull(), "supported").when(F.col("accepted") > 0, "partial").otherwise("unsupported")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("round", F.desc("score"), "rank", "object_id"))
    kinds = dict(pool.dtypes)
    none_yet = questions.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, object_id {kinds['object_id']}, rank long, legs array<string>, round int, score double")
    decisions = functools.reduce(DataFrame.unionByName, accepted, none_yet)
    return (
        states.select("query_id", status.alias("status"), "accepted", F.array_sort("missing").alias("missing"), "rounds", "expanded"),
        decisions.select("query_id", "object_id", "round", "score", place.alias("place")),
    )
