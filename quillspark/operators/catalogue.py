"""From raw records to a catalogue: projections, rights, classification, dedup, merge (PRJ-*, CLS-*, SET-*, JON-9, SEC-17..22)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import phrases as P
from quillspark.operators.ranking import near_best


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def normalised(raw: DataFrame, spellings: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """PRJ-1: each field from the first of its spellings that has a value; rows without a required field go."""
    known = {c.lower(): c for c in raw.columns}

    def pick(names: Sequence[str]) -> Column:
        have = [F.col(f"`{known[n.lower()]}`") for n in names if n.lower() in known]
        return first_given(*have) if have else F.lit(None).cast("string")

    out = raw.select(*(pick(names).alias(field) for field, names in spellings.items()))
    return out.where(reduce(Column.__and__, (F.col(f).isNotNull() for f in required), F.lit(True)))


def shown(value: Column, kind: str) -> Column:
    """STR-12: a typed value as one text: lists joined by ``; ``, of a struct its first filled naming field."""
    if kind.startswith("array<string"):
        return F.array_join(F.filter(F.transform(value, T.strip_html), lambda x: x != ""), "; ")
    return T.strip_html(value.cast("string"))


def evidence_of(parts: Mapping[str, Column], id_col: Column) -> Column:
    """PRJ-2, SEC-21: an array of evidence structs, one for each part that has a text, in order."""
    rows = F.array(*(F.struct(F.concat_ws("#", id_col.cast("string"), F.lit(name)).alias("evidence_id"), F.lit(name).alias("supports"), first_given(c).alias("text")) for name, c in parts.items()))
    return F.filter(rows, lambda x: x["text"].isNotNull())


def evidence_depth(evidence: Column, has_prose: Column) -> Column:
    """CLS-7: full with curatorial prose and three pieces at least."""
    return F.when(has_prose & (F.size(evidence) >= 3), "full").otherwise("thin")


def rights(institution: Column, image_license: Column, metadata_license: Column, legacy: Column, open_houses: Sequence[str]) -> Column:
    """PRJ-3/4: licence of image, metadata and prose; a house's blanket licence applies only where it grants one."""
    blanket = F.when(institution.isin(*open_houses), legacy)
    return F.struct(first_given(image_license, blanket).alias("image"), first_given(metadata_license, blanket).alias("metadata"), F.when(institution.isin(*open_houses), first_given(metadata_license, legacy)).alias("prose"))


def search_text(**fields: Column) -> Column:
    """PRJ-8: labelled lines for an encoder; empty fields leave none."""
    lines = F.array(*(F.when(first_given(c).isNotNull(), F.concat(F.lit(f"{name}: "), first_given(c))) for name, c in fields.items()))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def judge_text(evidence: Sequence[Column], facts: Sequence[Column], limit: int = 360) -> Column:
    """PRJ-9: evidence first, then facts, within a limit."""
    return F.substring(F.concat_ws(" | ", *(first_given(c) for c in (*evidence, *facts))), 1, limit)


def corrected_packs(packs: Column, text: Column, moves: Sequence[tuple[str, str, str]]) -> Column:
    """PRJ-13: where a pattern occurs, a label is replaced by another, in place and without repeats."""
    out = packs
    for pattern, old, new in moves:
        out = F.when(text.rlike(pattern), F.array_distinct(_replaced(out, old, new))).otherwise(out)
    return out


def _replaced(labels: Column, old: str, new: str) -> Column:
    return F.transform(labels, lambda p: F.when(p == old, new).otherwise(p))


@dataclass(frozen=True)
class Rule:
    """M20: a label with its patterns; prose patterns count less and only up to a cap."""

    label: str
    patterns: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    prose: tuple[str, ...] = ()


WEAK, STRONG = 1.0, 3.0


def pattern_score(text: Column, rule: Rule) -> Column:
    """CLS-1: the weights of the rule's phrases that occur."""
    weights: dict[str, float] = {}
    for ps, w in ((rule.patterns, WEAK), (rule.strong, STRONG)):
        for p in ps:
            weights[P.as_found(p)] = weights.get(P.as_found(p), 0.0) + w
    if not weights:
        return F.lit(0.0)
    of = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.aggregate(P.occurring(text, [*rule.patterns, *rule.strong]), F.lit(0.0), lambda total, p: total + F.try_element_at(of, p))


def labelled(objects: DataFrame, id_col: str, rules: Sequence[Rule], controlled: Column, prose: Column | None = None, prose_weight: float = 0.5, prose_cap: float = 2.0) -> DataFrame:
    """CLS-1..4, JON-9: (id, label, score) of the rules that score; ids are unique.

    Each text is gone through once for all rules; the phrases found meet the rules in a broadcast join.
    """
    kinds = ((("patterns", WEAK), ("strong", STRONG)), (("prose", 1.0),))
    rows = [(k, P.as_found(p), r.label, w) for r in rules for k, parts in enumerate(kinds) for name, w in parts for p in getattr(r, name)]
    spelled = [[p for r in rules for name, _ in parts for p in getattr(r, name)] for parts in kinds]

    def of_kind(text: Column, k: int) -> Column:
        return F.transform(P.occurring(text, spelled[k]), lambda p: F.struct(F.lit(k).alias("kind"), p.alias("phrase")))

    found = [of_kind(text, k) for k, text in enumerate((controlled, prose)) if text is not None and spelled[k]]
    out = "kind int, phrase string, label string, weight double"
    if not found:
        return objects.select(id_col, F.lit("").alias("label"), F.lit(0.0).alias("score")).where("false")
    hits = objects.select(id_col, F.explode(F.concat(*found)).alias("x")).select(id_col, "x.kind", "x.phrase").join(F.broadcast(objects.sparkSession.createDataFrame(rows, out)), ["kind", "phrase"])
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("weight"))), F.lit(0.0))
    return hits.groupBy(id_col, "label").agg((of(0) + F.least(of(1) * prose_weight, F.lit(prose_cap))).alias("score")).where("score > 0")


def registry_manifest(rules: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """AGG-3: every registered label in order, with how often it is given and whether that is enough."""
    n = labels.groupBy("label").agg(F.count("*").alias("n"))
    zero = F.coalesce("n", F.lit(0)).cast("long")
    return rules.join(n, "label", "left").select("place", "label", zero.alias("n"), (zero >= least).alias("enough"))


def richest(rows: DataFrame, keys: Sequence[str], richness: Column, order: str) -> DataFrame:
    """SET-1: of rows with the same key the richest, the first among equals."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(richness, -F.col(order)))
    return rows.groupBy(*keys).agg(best.alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """SET-2: the first row of each key; rows with a blank key go."""
    filled = rows.where(reduce(Column.__and__, (first_given(F.col(k)).isNotNull() for k in keys)))
    rest = [c for c in rows.columns if c not in keys]
    return filled.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def folded(rows: DataFrame, house: str, description: str, rank: str, id_col: str, least: int = 120) -> DataFrame:
    """SET-3: of a house's rows with the same long description the best-ranked stays; short ones are never folded."""
    norm = T.normalise(F.col(description))
    key = F.when(F.length(norm) >= least, F.sha2(norm, 256)).otherwise(F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    rest = rows.columns
    return rows.withColumn("__k", key).groupBy(house, "__k").agg(F.min_by(F.struct(*rest), F.struct(F.col(rank), F.col(id_col))).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in rest))


def merged(existing: DataFrame, newer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SET-9: new rows take the place of old ones with the same key."""
    old = existing.join(newer.select(*keys).distinct(), list(keys), "left_anti")
    return newer.unionByName(old)


def question_cards(labels: DataFrame, objects: DataFrame, id_col: str, least: int = 40, full: int = 5, packs: int = 3) -> DataFrame:
    """SEC-17: a card for each label with enough objects; supported with enough full records and packs."""
    each = labels.join(objects, id_col).groupBy("label").agg(F.count("*").alias("objects"), F.count_if(F.col("depth") == "full").alias("full"), F.countDistinct("pack").alias("packs"))
    status = F.when((F.col("full") >= full) & (F.col("packs") >= packs), "supported").otherwise("partial")
    return each.where(F.col("objects") >= least).withColumn("status", status)


def landing(objects: DataFrame, group: str, id_col: str, kind: str, samples: int = 3, top: int = 8) -> DataFrame:
    """AGG-28: for each group its size, its first samples and its most frequent kinds."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(id_col))
    first = objects.withColumn("p", place).where(F.col("p") <= samples).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(id_col).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("samples"))
    kinds = objects.groupBy(group, kind).agg(F.count("*").alias("n"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), kind))
    best = kinds.withColumn("p", order).where(F.col("p") <= top).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(kind).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("kinds"))
    size = objects.groupBy(group).agg(F.count("*").alias("n"))
    return size.join(first, group).join(best, group)


def centuries(objects: DataFrame, low: int = -1000, high: int = 1900) -> DataFrame:
    """DAT-3, JON-8: each object with the centuries that its dates touch, without a join."""
    start = F.greatest(F.lit(low), (F.floor(F.col("date_earliest") / 100) * 100).cast("int"))
    end = F.least(F.lit(high), (F.floor(F.col("date_latest") / 100) * 100).cast("int"))
    return objects.where(start <= end).withColumn("century", F.explode(F.sequence(start, end, F.lit(100))))


def expected_versus_actual(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """FLT-20, §2.15-16: keys that only one of two sets has; empty if they agree."""
    a, b = expected.select(*keys, F.lit(True).alias("e")).distinct(), actual.select(*keys, F.lit(True).alias("a")).distinct()
    return a.join(b, list(keys), "full_outer").where("e IS NULL OR a IS NULL").select(*keys, F.when(F.col("e").isNull(), "unexpected").otherwise("missing").alias("problem"))


def licensed(chunks: Column, default: Column) -> Column:
    """PRJ-3: evidence structs whose licence is the record's where they have none of their own."""
    return F.transform(chunks, lambda x: x.withField("license", first_given(x["license"], default)))


def joined_parts(*parts: Column, sep: str = "，") -> Column:
    """SEC-22: the distinct given parts in order, as one text."""
    return F.array_join(F.array_distinct(F.filter(F.array(*map(first_given, parts)), lambda x: x.isNotNull())), sep)


def routed(objects: DataFrame, id_col: str, layers: Mapping[str, tuple[DataFrame, int, float]]) -> DataFrame:
    """CLS-5: each object with the labels of every layer, best first: up to so many with so large a share of its best score."""
    out = objects
    for name, (scores, most, share) in layers.items():
        best = near_best(scores, id_col, "label", most, share).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("l"))
        out = out.join(best.select(id_col, F.transform("l", lambda x: x["label"]).alias(name)), id_col, "left")
    return out.withColumns({name: F.coalesce(name, F.array().cast("array<string>")) for name in layers})


def regression_rows(cards: DataFrame, expected: str, boundary: Sequence[tuple[str, str, str]]) -> DataFrame:
    """SEC-18: a test row for each card with what is expected of it, and fixed rows beyond the catalogue."""
    own = cards.select("label", "question", F.col(expected).alias("expected"))
    return own.unionByName(cards.sparkSession.createDataFrame(list(boundary), "label string, question string, expected string"))


def rights_rollup(objects: DataFrame, group: str, rights_col: str) -> DataFrame:
    """SEC-19: how many objects of each group have each licence, and their share of it."""
    n = objects.groupBy(group, F.coalesce(rights_col, F.lit("not_recorded")).alias(rights_col)).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 4))
