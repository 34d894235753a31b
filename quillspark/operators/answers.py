"""Questions and what may be answered: classifiers, obligations, predicates, audits and repair of sets (SEC-1..16, STR-7/22/23, CLS-8, SMP-7/10).

Rules are data: a question or an object is judged by one expression over the rules, never by a row for each rule.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

MAX_POOL = 250


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the patterns occurs, in whatever case."""
    return reduce(Column.__or__, (text.rlike(f"(?i){p}") for p in patterns), F.lit(False))


def concept_present(text: Column, concept: str, left: str = "", right: str = "") -> Column:
    """STR-7: a concept of one CJK character counts only between other characters or those in ``left`` and ``right``."""
    if not re.fullmatch("[㐀-鿿]", concept):
        return T.phrase_present(text, concept)
    before = f"(^|[^㐀-鿿]{''.join(f'|{c}' for c in left)})"
    behind = f"($|[^㐀-鿿]{''.join(f'|{c}' for c in right)})"
    return text.rlike(f"{before}{concept}{behind}")


@dataclass(frozen=True)
class Obligation:
    """A leg that a question may name, and what shows that an object stands for it."""

    leg: str
    asked: tuple[str, ...]
    origins: tuple[str, ...] = ()
    packs: tuple[str, ...] = ()


def named_legs(question: Column, obligations: Sequence[Obligation]) -> Column:
    """SEC-11: the legs that a question names; none if it names fewer than two."""
    found = F.filter(F.array(*(F.when(any_pattern(question, o.asked), F.lit(o.leg)) for o in obligations)), lambda x: x.isNotNull())
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<string>"))


def legs_of(origin: Column, regions: Column, packs: Column, obligations: Sequence[Obligation]) -> Column:
    """STR-22: the legs that an object stands for: by its own origin, else by its only pack."""
    origin = F.coalesce(origin, F.lit(""))

    def holds(o: Obligation) -> Column:
        own = any_pattern(origin, (*o.origins, *o.asked))
        wanted = F.array(*map(F.lit, o.packs)).cast("array<string>")
        return F.when(origin != "", own | F.arrays_overlap(regions, wanted)).otherwise((F.size(packs) == 1) & F.arrays_overlap(packs, wanted))

    return F.filter(F.array(*(F.when(holds(o), F.lit(o.leg)) for o in obligations)), lambda x: x.isNotNull())


def classified(questions: DataFrame, text: str, cross: Sequence[str], obligations: Sequence[Obligation], provenance: Sequence[str], browse: Sequence[str], attribution: Sequence[Sequence[str]]) -> DataFrame:
    """SEC-1: flags of each question. Browsing is the whole of a question; attribution needs one pattern of every group."""
    q = F.col(text)
    compact = F.regexp_replace(F.lower(q), r"[\s，,。.!！?？、;；:：'\"]+", "")
    legs = reduce(Column.__add__, (any_pattern(q, o.asked).cast("int") for o in obligations), F.lit(0))
    return questions.select(
        "*",
        (any_pattern(q, cross) | (legs >= 2)).alias("cross_cultural"),
        any_pattern(q, provenance).alias("provenance"),
        any_pattern(compact, [f"^(?:{b})$" for b in browse]).alias("browse"),
        reduce(Column.__and__, (any_pattern(q, g) for g in attribution), F.lit(True)).alias("attribution"),
    )


def opening_kind(text: Column, cues: Mapping[str, Sequence[str]], filler: Sequence[str], longest: int = 60) -> Column:
    """STR-23: what an opening without a subject does; null if it names something.

    ``cues`` in order of priority. The opening is taken apart at punctuation; what is left after cues and filler names
    something. Words are told apart by spaces.
    """
    raw = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    phrases = sorted({p for ps in cues.values() for p in ps} | set(filler), key=lambda p: (-len(p), p))
    padded = F.concat(F.lit(" "), F.regexp_replace(raw, r"[^\p{L}\p{N}' ]+", "  "), F.lit(" "))
    rest = F.regexp_replace(padded, "(?: (?:" + "|".join(map(re.escape, phrases)) + "))+(?= )", " ")
    kind = F.lit("unsure")
    for name in reversed(cues):
        kind = F.when(any_pattern(padded, [f" {re.escape(p)} " for p in cues[name]]), name).otherwise(kind)
    return F.when((F.length(raw) <= longest) & (F.trim(rest) == ""), kind)


@dataclass(frozen=True)
class Predicate:
    """A claim that topic counts can't answer: all groups of patterns occur in the question."""

    name: str
    asked: tuple[tuple[str, ...], ...]
    evidence: str | None = None
    #: Status with and without matching evidence.
    with_match: str = "partially_supported"
    without: str = "unsupported"


def assessed(questions: DataFrame, results: DataFrame, predicates: Sequence[Predicate], question: str = "question") -> DataFrame:
    """CLS-8, FLT-17: ``(query_id, predicate, status, matched)`` of the first predicate that a question makes.

    ``results``: (query_id, object_id, source_kind, text); provenance is no evidence for a predicate.
    """
    first = F.lit(None).cast("string")
    for p in reversed(predicates):
        first = F.when(reduce(Column.__and__, (any_pattern(F.col(question), g) for g in p.asked)), p.name).otherwise(first)
    made = questions.select("query_id", first.alias("predicate")).where("predicate IS NOT NULL")
    good = reduce(lambda out, p: F.when(F.col("predicate") == p.name, F.col("text").rlike(f"(?i){p.evidence}") if p.evidence else F.lit(False)).otherwise(out), predicates, F.lit(False))
    shown = results.where("source_kind <> 'provenance'").join(made, "query_id").where(good).groupBy("query_id").agg(F.countDistinct("object_id").alias("matched"))
    n = F.coalesce("matched", F.lit(0)).cast("long")
    status = reduce(lambda out, p: F.when(F.col("predicate") == p.name, F.when(n > 0, p.with_match).otherwise(p.without)).otherwise(out), predicates, F.lit(None).cast("string"))
    return made.join(shown, "query_id", "left").select("query_id", "predicate", status.alias("status"), n.alias("matched"))


def merged_audits(first: DataFrame, second: DataFrame) -> DataFrame:
    """SEC-10: what either audit accepted, first audit first, with new ranks; an object keeps its first place."""
    rows = first.select("query_id", "object_id", "rank", F.lit(0).alias("turn")).unionByName(second.select("query_id", "object_id", "rank", F.lit(1).alias("turn")))
    kept = rows.groupBy("query_id", "object_id").agg(F.min(F.struct("turn", "rank")).alias("p"))
    return kept.select("query_id", "object_id", F.row_number().over(Window.partitionBy("query_id").orderBy("p", "object_id")).alias("rank"))


def downgraded(status: Column, needed: Column, got: Column) -> Column:
    """SEC-8, SEC-9: fewer than needed make partial of supported."""
    return F.when((status == "supported") & (got < needed), "partial").otherwise(status)


def conditions(questions: DataFrame, predicates: str, kinds: str, materials: str) -> DataFrame:
    """SEC-15: a condition for each predicate, kind and material of a question; an empty list asks nothing."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    out = questions
    for name, column in (("predicate", predicates), ("kind", kinds), ("material", materials)):
        out = out.withColumn(name, F.explode(some(column)))
    parts = ("predicate", "kind", "material")
    return out.select("query_id", F.concat_ws("/", *parts).alias("condition_id"), *parts).where(F.coalesce(*parts).isNotNull())


def audit_payload(results: DataFrame, evidence: DataFrame, top: int, clip: int) -> DataFrame:
    """SEC-16: for each question its first results with their evidence, texts clipped, as JSON."""
    few = results.where(F.col("rank") <= top)
    texts = evidence.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", F.substring("text", 1, clip).alias("text")))).alias("evidence"))
    rows = few.join(texts, "object_id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "object_id", "evidence"))).alias("results"))
    return rows.select("query_id", F.to_json("results").alias("payload"))


def audit_sample(results: DataFrame, size: int, reserve: int, legs: str = "leg", axis: str = "axis", rich: str = "rich") -> DataFrame:
    """SMP-7: protected legs first, then a slot for each axis, then source-rich rows, then the best of the rest.

    Each row takes the earliest slot that it qualifies for; ``place`` orders the slots and, within one, the ranks.
    """
    by = lambda c: F.row_number().over(Window.partitionBy("query_id", c).orderBy("rank", "object_id"))
    slot = F.when(F.col(legs).isNotNull() & (by(legs) <= reserve), 0).when(F.col(axis).isNotNull() & (by(axis) <= 1), 1)
    own = results.withColumn("slot", slot)
    rich_place = F.row_number().over(Window.partitionBy("query_id", F.col("slot").isNull() & F.col(rich)).orderBy("rank", "object_id"))
    own = own.withColumn("slot", F.coalesce("slot", F.when(F.col(rich) & (rich_place <= reserve), 2).otherwise(3)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("slot", "rank", "object_id"))
    return own.withColumn("place", place).where(F.col("place") <= size)


def repaired(chosen: DataFrame, pool: DataFrame, required: DataFrame) -> DataFrame:
    """SMP-10: bring missing legs into a set: candidates in rank order each replace the last row whose loss still adds a leg.

    The last row of full depth stays unless a full one replaces it. ``chosen``: (query_id, object_id, place, legs, full);
    ``pool``: (query_id, object_id, rank, legs, full); ``required``: (query_id, legs). The best ``MAX_POOL`` of a query's
    pool and its set of a few rows are looked at together, so a group is bounded.
    """
    few = pool.where(F.col("rank") <= MAX_POOL).select("query_id", "object_id", F.col("rank").alias("place"), "legs", "full", F.lit(True).alias("spare"))
    rows = chosen.select("query_id", "object_id", "place", "legs", "full", F.lit(False).alias("spare")).unionByName(few).join(required.select("query_id", F.col("legs").alias("wanted")), "query_id")
    kind = dict(chosen.dtypes)["object_id"]

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = set(pdf["wanted"].iloc[0])
        ordered = pdf.sort_values(["place", "object_id"]).to_dict("records")
        room = [r for r in ordered if not r["spare"]]
        covered = lambda rows: set().union(*(wanted & set(r["legs"]) for r in rows))
        for candidate in (r for r in ordered if r["spare"]):
            before = covered(room)
            if before == wanted:
                break
            if candidate["object_id"] in {r["object_id"] for r in room} or not (wanted & set(candidate["legs"])) - before:
                continue
            for k in reversed(range(len(room))):
                trial = [*room[:k], candidate, *room[k + 1 :]]
                last_full = room[k]["full"] and not any(r["full"] for r in trial)
                if not last_full and len(covered(trial)) > len(before):
                    room = trial
                    break
        return pd.DataFrame([(pdf["query_id"].iloc[0], r["object_id"], k + 1, covered(room) == wanted) for k, r in enumerate(room)], columns=["query_id", "object_id", "place", "complete"])

    return rows.groupBy("query_id").applyInPandas(swap, f"query_id string, object_id {kind}, place int, complete boolean")


def pool_extension(chains: Mapping[str, DataFrame], reviewed: DataFrame, top: int = 5, salt: str = "pool") -> DataFrame:
    """SET-8: pairs among the first of any chain that are not reviewed, with the chains and ranks they come from, in an order that hides both."""
    rows = reduce(DataFrame.unionByName, (df.where(F.col("rank") <= top).select("query_id", "object_id", F.struct(F.lit(name).alias("chain"), "rank").alias("source")) for name, df in chains.items()))
    new = rows.join(reviewed.select("query_id", "object_id"), ["query_id", "object_id"], "left_anti")
    pairs = new.groupBy("query_id", "object_id").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    digest = F.sha2(F.concat_ws(":", F.lit(salt), "query_id", F.col("object_id").cast("string")), 256)
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(digest, "object_id")))


def confidence(relevance: Column, verdict: Column) -> Column:
    """SEC-32."""
    return F.when((relevance == 3) & (verdict == "supports"), "high").when(relevance == 2, "medium").otherwise("low")


def risks(level: Column, category: Column, relevance: Column, visual: Sequence[str], open_ended: Sequence[str]) -> Column:
    """SEC-32: always a draft that a person confirms; low confidence; visual questions, and open ones with any relevance, need a look."""
    look = category.isin(*visual) | (category.isin(*open_ended) & (relevance >= 1))
    flags = F.array(F.lit("ai_draft"), F.lit("needs_human_confirmation"), F.when(level == "low", "low_confidence"), F.when(look, "visual_review_required"))
    return F.filter(flags, lambda x: x.isNotNull())


def consistent_status(status: Column, supported: Column, missing_legs: Column, category: Column) -> Column:
    """SEC-32: ``supported`` needs a supporting candidate, and in cross-cultural questions every leg."""
    return F.when(status != "supported", status).when(supported == 0, "unsupported").when((category == "cross_cultural") & (missing_legs > 0), "partially_supported").otherwise(status)


def blind(rows: DataFrame, shown: Sequence[str]) -> DataFrame:
    """PRJ-11, PRJ-12: only the columns that a reviewer or the public may see; rank, score and source stay out."""
    return rows.select(*(c for c in shown if c in rows.columns))


def result_rows(ranked: DataFrame, columns: Sequence[str], order: str = "rank") -> DataFrame:
    """PRJ-10: each query's results as one array of structs with their rank."""
    entry = F.struct(F.col(order).cast("long").alias("rank"), *columns)
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("results"))
