"""Append-only review log, its current state, and reports (WIN-3/4/11, AGG-20/21/25..31, SEC-1..5, STM-3..5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import latest


def current(log: DataFrame, keys: Sequence[str] = ("query_id", "object_id"), order: str = "id") -> DataFrame:
    """WIN-3."""
    return latest(log, keys, order)


def finalized(log: DataFrame) -> DataFrame:
    """WIN-4: each query's last finalisation is current if nothing about its candidates came later."""
    last = log.groupBy("query_id").agg(F.max(F.when(F.col("kind") == "final", F.col("id"))).alias("final_id"), F.max(F.when(F.col("kind") == "candidate", F.col("id"))).alias("candidate_id"))
    return last.where("final_id IS NOT NULL").select("query_id", "final_id", (F.col("final_id") > F.coalesce("candidate_id", F.lit(-1))).alias("is_current"))


def accepted_appends(log: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """WIN-11, STM-5: which incoming rows may be appended.

    A request id that the log has, or that came before in the batch, is ``duplicate``. A row must carry the
    revision that follows the last one of its key, counted on through the batch; otherwise it is a ``conflict``.
    """
    last = log.groupBy(*keys).agg(F.max("revision").alias("last"))
    known = log.select("request_id").distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy("request_id").orderBy("arrival")
    rows = incoming.withColumn("copy", F.row_number().over(order)).join(known, "request_id", "left").join(last, list(keys), "left")
    fresh = rows.withColumn("duplicate", F.coalesce("known", F.lit(False)) | (F.col("copy") > 1))
    turn = F.row_number().over(Window.partitionBy(*keys, "duplicate").orderBy("arrival"))
    checked = fresh.withColumn("turn", turn)
    status = F.when(F.col("duplicate"), "duplicate").when(F.col("revision") == F.coalesce("last", F.lit(0)) + F.col("turn"), "accepted").otherwise("conflict")
    return checked.select(*incoming.columns, status.alias("status"))


def revisions_gapless(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose revisions don't run 1, 2, 3 ... (``lag`` check of the log)."""
    before = F.lag("revision", 1, 0).over(Window.partitionBy(*keys).orderBy("id"))
    return log.withColumn("before", before).where(F.col("revision") != F.col("before") + 1).select(*keys).distinct()


def progress(questions: DataFrame, candidates: DataFrame, log: DataFrame) -> DataFrame:
    """AGG-31, SEC-3: reviewed candidates of each question and its status."""
    reviewed = current(log.where(F.col("kind") == "candidate"))
    state = candidates.join(reviewed.select("query_id", "object_id", "reviewer"), ["query_id", "object_id"], "left").groupBy("query_id").agg(F.count("*").alias("candidates"), F.count("reviewer").alias("reviewed"), F.count_if(F.col("reviewer").startswith("delegate")).alias("delegated"))
    out = questions.join(state, "query_id", "left").join(finalized(log), "query_id", "left")
    done = F.coalesce("is_current", F.lit(False))
    status = F.when(done, "complete").when(F.coalesce("reviewed", F.lit(0)) > 0, "in_progress").otherwise("unreviewed")
    zero = F.lit(0).cast("long")
    return out.select("query_id", F.coalesce("candidates", zero).alias("candidates"), F.coalesce("reviewed", zero).alias("reviewed"), F.coalesce("delegated", zero).alias("delegated"), status.alias("status"))


def may_finalize(candidates: DataFrame, reviewed: DataFrame, required: DataFrame) -> DataFrame:
    """SEC-2: all candidates reviewed, one of relevance 2 supports, and every required leg is covered."""
    rows = candidates.join(reviewed, ["query_id", "object_id"], "left")
    each = rows.groupBy("query_id").agg(F.bool_and(F.col("relevance").isNotNull()).alias("all_reviewed"), F.coalesce(F.bool_or(F.col("supports") & (F.col("relevance") >= 2)), F.lit(False)).alias("has_support"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("relevance") >= 2, F.col("legs"))))).alias("covered"))
    out = each.join(required, "query_id", "left")
    missing = F.array_sort(F.array_except(F.coalesce("required_legs", F.array().cast("array<string>")), "covered"))
    return out.select("query_id", "all_reviewed", "has_support", missing.alias("missing_legs"), (F.col("all_reviewed") & F.col("has_support") & (F.size(missing) == 0)).alias("supported_ok"))


def counted(rows: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """AGG-1, AGG-25: how often each value occurs."""
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def one_dimensional(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-26, AGG-37: counts by each column on its own, in one pass by grouping sets."""
    names = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in columns))
    value = F.coalesce(*(F.when(F.grouping(c) == 0, F.coalesce(F.col(c).cast("string"), F.lit("not_recorded"))) for c in columns))
    return rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(names.alias("dimension"), value.alias("value"), F.count("*").alias("n")).select("dimension", "value", "n")


def with_default(rows: DataFrame, column: str, default: str = "not_recorded") -> DataFrame:
    """AGG-27."""
    return rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(column)), F.lit("")), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AGG-26: empty or missing values of each column, one pass."""
    counts = rows.agg(*(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("p")).select("p.*")


def pattern_counts(lines: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """AGG-21: lines that match each pattern."""
    counts = lines.agg(*(F.count_if(F.col(text).rlike(p)).alias(n) for n, p in patterns.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n")) for n in patterns))).alias("p")).select("p.*")


def current_generation(rows: DataFrame, generations: DataFrame, key: str) -> DataFrame:
    """STM-4: rows of a generation that is no longer the key's own are dropped."""
    return rows.join(generations.select(key, F.col("generation").alias("__g")), key).where(F.col("generation") == F.col("__g")).drop("__g")


def job_state(steps: DataFrame) -> DataFrame:
    """STM-3: the last status of each step, and the share of steps that are settled."""
    now = latest(steps, ["job_id", "step"], "id")
    settled = F.col("status").isin("done", "failed", "skipped")
    return now.groupBy("job_id").agg(F.count("*").alias("steps"), F.count_if(settled).alias("settled"), F.round(F.avg(settled.cast("double")), 4).alias("progress"), F.bool_or(F.col("status") == "failed").alias("failed"))


def evicted(files: DataFrame, cap: int, share: float = 0.9) -> DataFrame:
    """STM-7: files, oldest first, that must go so that what stays is at most ``share`` of the cap; none below the cap.

    Sizes are summed by day first, so that only days, not files, are ordered in one place.
    """
    day = F.to_date("used_at")
    by_day = files.groupBy(day.alias("day")).agg(F.sum("size").alias("size"))
    newer = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = by_day.agg(F.sum("size").alias("total"))
    later = by_day.withColumn("newer", newer).select(F.col("day").alias("__day"), "newer")
    own = F.sum("size").over(Window.partitionBy("__day").orderBy(F.desc("used_at"), "path"))
    rows = files.join(F.broadcast(later), day == F.col("__day")).withColumn("kept", F.col("newer") + own).join(F.broadcast(total))
    return rows.where((F.col("total") > cap) & (F.col("kept") > share * cap)).select(*files.columns)


def intro_counts(objects: DataFrame, house: str, pack: str) -> DataFrame:
    """AGG-30: the numbers of an introduction, one row."""
    return objects.agg(F.countDistinct(house).alias("houses"), F.countDistinct(pack).alias("packs"), F.count("*").alias("objects"))


def candidate_detail(candidates: DataFrame, judgements: DataFrame, suggestions: DataFrame, keys: Sequence[str], salt: str) -> DataFrame:
    """SEC-4: candidates with their latest judgement and suggestion, in an order that doesn't tell where they came from."""
    out = candidates
    for log in (judgements, suggestions):
        out = out.join(latest(log, keys, "id").drop("id"), list(keys), "left")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(keys[-1]).cast("string")), 256)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(digest, keys[-1])))


def exported(log: DataFrame, order: str = "id", ranges: int = 64) -> DataFrame:
    """SEC-5: the whole log numbered in order. Rows are counted in ranges of the order column first, so none is a bottleneck."""
    edges = log.agg(F.min(order).alias("low"), F.max(order).alias("high"))
    part = F.floor((F.col(order) - F.col("low")) * ranges / (F.col("high") - F.col("low") + 1))
    cut = log.join(F.broadcast(edges)).withColumn("__part", part).drop("low", "high")
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    line = F.row_number().over(Window.partitionBy("__part").orderBy(order)) + F.col("__before")
    return cut.join(F.broadcast(starts), "__part").withColumn("line", line).drop("__part", "__before")


def unlike_identity(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SEC-23: keys whose rows don't agree in the fields that name a run."""
    changed = F.lit(False)
    for f in fields:
        changed = changed | (F.min(f) != F.max(f))
    return rows.groupBy(key).agg(changed.alias("c")).where("c").select(key)


def human_reviewed(flag: Column, note: Column, pending: str) -> Column:
    """SEC-30: the flag is set and nothing says that the review is still to come."""
    return F.coalesce(flag, F.lit(False)) & ~F.coalesce(note.contains(pending), F.lit(False))


def campaign_state(planned: DataFrame, done: DataFrame, shard: str, key: str = "query_id") -> DataFrame:
    """SEC-31: what each shard of a campaign planned and did, and whether that is all."""
    rows = planned.join(done.select(key).distinct().withColumn("__done", F.lit(True)), key, "left")
    return rows.groupBy(shard).agg(F.count("*").alias("planned"), F.count("__done").alias("done"), (F.count("__done") == F.count("*")).alias("complete"))


def suggestion_outcomes(offered: DataFrame, frozen: DataFrame, verdicts: Sequence[str]) -> DataFrame:
    """SEC-7: which suggestions may be appended: a known verdict, a pair of the frozen dataset, and its hash."""
    known = frozen.select("query_id", "object_id", F.col("dataset_sha256").alias("__sha"))
    bound = offered.join(known, ["query_id", "object_id"], "left")
    outcome = F.when(~F.coalesce(F.col("verdict").isin(*verdicts), F.lit(False)), "invalid").when(F.col("__sha").isNull(), "unknown_pair").when(F.col("__sha") != F.col("dataset_sha256"), "wrong_hash").otherwise("accepted")
    return bound.withColumn("outcome", outcome).drop("__sha")
