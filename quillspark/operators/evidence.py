"""Source-bound evidence checks and set rules (QRY-11..16, QRY-20/21, AGG-32..34, SEC-8..31, JON-10/12)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import phrases
from quillspark.operators.dense import in_blocks

# The least relevance of a decision and its weights.
LEAST_RELEVANCE = 0.62


def visible(evidence: DataFrame, matched: DataFrame, most: int = 3) -> DataFrame:
    """QRY-11: up to three rows of each object: its best match, one curatorial row, other matches, then by id.

    ``evidence``: (object_id, evidence_id, source_kind); ``matched``: (object_id, evidence_id, position).
    """
    rows = evidence.where(F.col("source_kind") != "provenance").join(matched, ["object_id", "evidence_id"], "left")
    own = Window.partitionBy("object_id")
    is_text = F.col("source_kind") == "curatorial"
    best_text = F.row_number().over(Window.partitionBy("object_id", "source_kind").orderBy(F.asc_nulls_last("position"), "evidence_id"))
    first = F.col("position") == F.min("position").over(own)
    tier = F.when(F.coalesce(first, F.lit(False)), 0).when(is_text & (F.col("text_place") == 1), 1).when(F.col("position").isNotNull(), 2).otherwise(3)
    placed = rows.withColumn("text_place", best_text).withColumn("tier", tier)
    # the curatorial slot is the best match itself where that is curatorial
    place = F.row_number().over(own.orderBy("tier", F.asc_nulls_last("position"), "evidence_id"))
    return placed.withColumn("place", place).where(F.col("place") <= most).select("object_id", "evidence_id", "place")


def checked(checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """QRY-12: each check's failure, null if its quotation is bound to the evidence it names.

    ``checks``: (object_id, condition_id, evidence_id, quote, status); ``evidence``: (object_id, evidence_id, text).
    """
    known = evidence.select("evidence_id", F.col("object_id").alias("__owner"), "text")
    copies = F.count("*").over(Window.partitionBy("object_id", "condition_id"))
    rows = checks.withColumn("__copies", copies).join(known, "evidence_id", "left")
    failure = (
        F.when(F.col("__copies") > 1, "duplicate_condition")
        .when(F.col("status") != "supported", "not_supported")
        .when(F.col("__owner").isNull(), "unknown_evidence")
        .when(F.col("__owner") != F.col("object_id"), "foreign_evidence")
        .when(~F.coalesce(T.quote_visible(F.col("text"), F.col("quote")), F.lit(False)), "quote_not_visible")
    )
    return rows.select(*checks.columns, failure.alias("failure"))


def admitted(decisions: DataFrame, checks: DataFrame, conditions: DataFrame, rejected: DataFrame) -> DataFrame:
    """QRY-13: decisions with every condition bound, relevant enough, made once and not rejected elsewhere.

    ``decisions``: (query_id, object_id, relevance, rank); ``conditions``: (query_id, condition_id).
    """
    once = F.count("*").over(Window.partitionBy("query_id", "object_id")) == 1
    single = decisions.withColumn("__once", once).where(F.col("__once") & (F.col("relevance") >= LEAST_RELEVANCE)).drop("__once")
    wanted = single.join(conditions, "query_id")
    bound = checks.where("failure IS NULL").select("object_id", "condition_id", F.lit(1).alias("ok")).distinct()
    met = wanted.join(bound, ["object_id", "condition_id"], "left").groupBy("query_id", "object_id").agg(F.bool_and(F.col("ok").isNotNull()).alias("met")).where("met").drop("met")
    good = single.join(met, ["query_id", "object_id"], "left_semi").join(rejected, ["query_id", "object_id"], "left_anti")
    return good.withColumn("score", F.round(100 * (0.88 * F.col("relevance") + 0.12 / (1 + F.col("rank"))), 6))


def answer_status(admissions: DataFrame, rejected: DataFrame, questions: DataFrame) -> DataFrame:
    """Nothing admitted is unsupported; any rejection makes partial of supported."""
    n = admissions.groupBy("query_id").agg(F.count("*").alias("n"))
    r = rejected.select("query_id").distinct().withColumn("r", F.lit(True))
    out = questions.join(n, "query_id", "left").join(r, "query_id", "left")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "unsupported").when(F.coalesce("r", F.lit(False)), "partial").otherwise("supported")
    return out.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("accepted"), status.alias("status"))


def answerability(counts: DataFrame) -> DataFrame:
    """QRY-20, SEC-8/9: the first rule that fits; a missing named leg, or fewer than three regions, makes partial of supported.

    Columns: policy, audited, results, banned, matched, missing_legs, regions (null where not asked for).
    """
    status = F.coalesce(F.col("policy"), F.when(~F.col("audited") | (F.col("results") < 5) | F.col("banned"), "unsupported").when(F.col("matched") >= 5, "supported").when(F.col("matched") >= 1, "partial").otherwise("unsupported"))
    short = (F.coalesce("missing_legs", F.lit(0)) > 0) | (F.coalesce("regions", F.lit(3)) < 3)
    return counts.withColumn("status", F.when((status == "supported") & short, "partial").otherwise(status))


def set_coverage(requirements: DataFrame, witnesses: DataFrame, selected: DataFrame) -> DataFrame:
    """AGG-32, JON-12, QRY-14: distinct selected witnesses of each requirement, and whether they are enough.

    A witness must agree with the requirement in id, text and quotation, and its check be supported and bound.
    """
    keys = ["query_id", "requirement_id", "requirement_text", "source_quote"]
    good = witnesses.where((F.col("status") == "supported") & F.col("source_bound") & F.col("relation").isin("exact", "narrower")).join(selected, ["query_id", "object_id"], "left_semi")
    counts = good.groupBy(*keys).agg(F.countDistinct("object_id").alias("witnesses"))
    out = requirements.join(counts, keys, "left")
    n = F.coalesce("witnesses", F.lit(0)).cast("long")
    return out.select("query_id", "requirement_id", "min_witnesses", n.alias("witnesses"), (n >= F.col("min_witnesses")).alias("satisfied"))


def over_concentrated(items: DataFrame, key: Column, most: int = 3) -> DataFrame:
    """AGG-33: keys that more than ``most`` objects of a set share."""
    return items.withColumn("key", key).where(F.col("key") != "").groupBy("set_id", "key").agg(F.countDistinct("object_id").alias("n")).where(F.col("n") > most)


def mean_distance(sets: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """AGG-34, JON-10: mean Jaccard distance of the pairs of members in each group; 0 for a group without a pair.

    Members with the same items are one row with a weight, so what is paired are a group's distinct item sets.
    """
    own = sets.groupBy(group, member).agg(F.sort_array(F.collect_set(item)).alias("items"))
    kinds = own.groupBy(group, "items").agg(F.count("*").alias("n"))
    a, b = kinds.select(group, F.col("items").alias("x"), F.col("n").alias("nx")), kinds.select(group, F.col("items").alias("y"), F.col("n").alias("ny"))
    both = F.size(F.array_intersect("x", "y"))
    likeness = F.when(F.size("x") + F.size("y") > both, both / (F.size("x") + F.size("y") - both)).otherwise(1.0)
    pairs = a.join(b, group).where("x < y").groupBy(group).agg(F.sum(F.col("nx") * F.col("ny") * (1 - likeness)).alias("s"))
    count = kinds.groupBy(group).agg(F.sum("n").alias("m"))
    total = F.col("m") * (F.col("m") - 1) / 2
    return count.join(pairs, group, "left").select(group, F.round(F.when(total > 0, F.coalesce("s", F.lit(0.0)) / total).otherwise(0.0), 6).alias("distance"))


def rules_broken(rows: DataFrame, id_col: str, rules: Mapping[str, Column]) -> DataFrame:
    """QRY-15/16: (id, code) of each rule that a row breaks; a rule that can't be decided is broken."""
    codes = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items())), lambda c: c.isNotNull())
    return rows.select(id_col, F.explode(codes).alias("code"))


def extractive(statement: Column, evidence_texts: Column) -> Column:
    """SEC-25: the statement stands in one of the evidence texts."""
    return F.exists(evidence_texts, lambda e: T.normalise(e).contains(T.normalise(statement)))


def best_by_mentions(items: DataFrame, question: str, labels: str, id_col: str, order: str) -> DataFrame:
    """QRY-21: the item with most labels that occur in the question; the first among equals."""
    q = F.lit(question.lower())
    n = F.size(F.filter(F.col(labels), lambda x: (x != "") & q.contains(F.lower(x))))
    return items.withColumn("mentions", n).orderBy(F.desc("mentions"), order).limit(1).where("mentions > 0").select(id_col, "mentions")


def longest_labels(texts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """SEC-29: for each text the label whose matching terms are longest in all; terms go to the texts in blocks of bounded size.

    A term is looked for only in texts that have its first characters.
    """
    hits = in_blocks(labels, "term", lambda few: phrases.holding(texts, F.lower("text"), few))
    sums = hits.groupBy(id_col, "label").agg(F.sum(F.length("term")).alias("total"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("total"), "label"))
    return sums.withColumn("n", place).where("n = 1").select(id_col, "label", "total")


def alternatives(results: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """SEC-12: the first results that are not used yet."""
    left = results.join(used, ["query_id", "object_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return left.withColumn("place", place).where(F.col("place") <= n)


def matched_first(evidence: Column, matched: Column) -> Column:
    """SEC-13: evidence ids in order, those that matched at the front."""
    return F.concat(F.array_intersect(evidence, matched), F.array_except(evidence, matched))


def coverage_valid(stored: DataFrame, requirements: DataFrame, witnesses: DataFrame, selected: DataFrame) -> DataFrame:
    """QRY-14: a stored coverage holds if counting again gives the same witnesses and all requirements are met."""
    again = set_coverage(requirements, witnesses, selected).select("query_id", "requirement_id", F.col("witnesses").alias("now"), "satisfied")
    both = again.join(stored.select("query_id", "requirement_id", "witnesses"), ["query_id", "requirement_id"], "full_outer")
    ok = F.coalesce((F.col("now") == F.col("witnesses")) & F.col("satisfied"), F.lit(False))
    return both.groupBy("query_id").agg(F.bool_and(ok).alias("valid"))


def edited(rows: DataFrame, replaced: DataFrame, moved: DataFrame) -> DataFrame:
    """SEC-14: rows of sets after edits: objects that give way to others, and objects with new places; places run on without gaps.

    ``replaced``: (query_id, object_id, by); ``moved``: (query_id, object_id, to), named by the object before its replacement.
    """
    keys = ["query_id", "object_id"]
    out = rows.join(replaced, keys, "left").join(moved, keys, "left").select("query_id", F.coalesce("by", "object_id").alias("object_id"), F.coalesce("to", "place").alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "object_id"))
    return out.select("query_id", "object_id", place.alias("place"))
