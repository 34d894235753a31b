"""Ranking, quotas, sampling and diverse selection (WIN-*, SMP-*, TOP-4..6, QRY-19)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """WIN-3: the row with the largest ``order`` for each key; maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def near_best(scores: DataFrame, key: str, label: str, most: int, share: float) -> DataFrame:
    """WIN-5: up to ``most`` labels of each key with at least ``share`` of its best score."""
    own = Window.partitionBy(key)
    place = F.row_number().over(own.orderBy(F.desc("score"), label))
    return scores.where("score > 0").withColumn("place", place).withColumn("best", F.max("score").over(own)).where((F.col("place") <= most) & (F.col("score") >= share * F.col("best"))).drop("best")


def _in_front(rows: DataFrame, groups: Sequence[str], first: str, n: int) -> DataFrame:
    """Rows that can be among the first ``n`` of their group by ``first``: up to the n-th of the least values of 4 n shares of the group.

    That many rows are at or below it, and about as many are left. A group with fewer shares is left whole, and so are nulls.
    """
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(4 * n))
    least = rows.groupBy(*groups, share.alias("share")).agg(F.min(first).alias("cut"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.asc_nulls_last("cut")))
    cuts = least.withColumn("n", place).where(F.col("n") == n).select(*(F.col(g).alias(f"__{g}") for g in groups), "cut")
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups))
    own = rows.join(F.broadcast(cuts), same, "left")
    return own.where(F.col("cut").isNull() | F.col(first).isNull() | (F.col(first) <= F.col("cut"))).select(*rows.columns)


def round_robin(rows: DataFrame, groups: Sequence[str], within: Sequence[Column | str], limit: int | None = None) -> DataFrame:
    """WIN-6/7: the first row of each group, then the second of each ...; ``turn`` and the group give the order.

    With a limit only that many rows of a group can be wanted. Where the first of ``within`` is a number in rising order,
    rows behind a value that as many rows of the group reach are left out before any are sorted; of the others Spark
    keeps no more than the limit in each task before the shuffle.
    """
    if limit and isinstance(within[0], str) and isinstance(rows.schema[within[0]].dataType, NumericType):
        rows = _in_front(rows, groups, within[0], limit)
    turn = F.row_number().over(Window.partitionBy(*groups).orderBy(*within))
    out = rows.withColumn("turn", turn)
    return out.where(F.col("turn") <= limit).orderBy("turn", *groups).limit(limit) if limit else out


def water_fill(available: DataFrame, group: str, target: int) -> DataFrame:
    """SMP-1: one unit for each group with room in turn until ``target`` is dealt out.

    After t full rounds a group holds least(available, t). The last full round is found from the
    groups' sizes alone, so no row is made for each unit.
    """
    sizes = available.groupBy(group).agg(F.sum("available").alias("available"))
    steps = sizes.select(F.col("available").alias("t")).where("t > 0").distinct()
    filled = steps.join(sizes.select("available")).groupBy("t").agg(F.sum(F.least("t", "available")).alias("used"), F.count_if(F.col("available") > F.col("t")).alias("open"))
    level = filled.where(F.col("used") <= target).agg(F.max(F.struct("t", "used", "open")).alias("m")).select(F.coalesce("m.t", F.lit(0)).alias("t"), F.coalesce("m.used", F.lit(0)).alias("used"), F.col("m.open").alias("open"))
    total = sizes.agg(F.count_if(F.col("available") > 0).alias("groups"))
    spread = level.join(total).select("t", (F.lit(target) - F.col("used")).alias("left"), F.coalesce("open", "groups").alias("open"))
    dealt = spread.select((F.col("t") + F.when(F.col("open") > 0, F.floor(F.col("left") / F.col("open"))).otherwise(0)).alias("t"), F.when(F.col("open") > 0, F.col("left") % F.col("open")).otherwise(0).alias("more"))
    own = sizes.join(F.broadcast(dealt))
    waiting = F.when(F.col("available") > F.col("t"), F.row_number().over(Window.partitionBy((F.col("available") > F.col("t"))).orderBy(group)))
    return own.select(group, "available", (F.least("t", "available") + F.coalesce((waiting <= F.col("more")).cast("int"), F.lit(0))).cast("long").alias("quota"))


def quota_sample(rows: DataFrame, quotas: DataFrame, group: str, within: Sequence[Column | str]) -> DataFrame:
    """The first rows of each group up to its quota."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*within))
    return rows.withColumn("place", place).join(quotas.select(group, "quota"), group).where(F.col("place") <= F.col("quota")).drop("quota")


def stable_sample(rows: DataFrame, salt: str, key: str, n: int) -> DataFrame:
    """TOP-6: the ``n`` rows whose salted key has the smallest SHA-256."""
    return rows.withColumn("digest", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)).orderBy("digest", key).limit(n)


def chronological(rows: DataFrame, year: str, rank: str, least: int = 3, share: float = 0.6) -> DataFrame:
    """TOP-5: by year where enough rows are dated, else by relevance."""
    counted = rows.agg((F.count(year) >= F.greatest(F.lit(least), F.ceil(share * F.count("*")))).alias("dated"))
    return rows.join(F.broadcast(counted)).withColumn("order_key", F.when(F.col("dated"), F.coalesce(F.col(year), F.lit(2**31 - 1))).otherwise(F.col(rank)).cast("long")).orderBy("order_key", rank).drop("dated")


def reserved_pool(rows: DataFrame, leg: str, reserve: int, size: int, id_col: str) -> DataFrame:
    """SMP-6, SMP-8: the best ``reserve`` of each leg first, then the best of the rest up to ``size``."""
    in_leg = F.row_number().over(Window.partitionBy("query_id", leg).orderBy(F.desc("score"), id_col))
    own = rows.withColumn("reserved", in_leg <= reserve)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reserved"), F.desc("score"), id_col))
    return own.withColumn("place", place).where(F.col("place") <= size)


def shards(rows: DataFrame, category: str, key: str, size: int) -> DataFrame:
    """QRY-19: consecutive shards of ``size`` rows within each category."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(key))
    return rows.withColumn("shard", F.ceil(place / size).cast("long"))


def chapters(rows: DataFrame, order: str, sizes: Sequence[int]) -> DataFrame:
    """MTH-5, SEC-28: rows of each query in order, dealt to chapters of the given sizes."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    edges = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    chapter = F.lit(None).cast("int")
    for k in reversed(range(len(edges))):
        chapter = F.when(F.col("place") <= edges[k], k + 1).otherwise(chapter)
    return rows.withColumn("place", place).withColumn("chapter", chapter).where(F.col("chapter").isNotNull())


# Weights of relevance, new origin, new pack, new institution, and redundancy.
MMR = {"relevance": 0.68, "origin": 0.34, "pack": 0.12, "institution": 0.06, "redundancy": 0.22}
MAX_CANDIDATES = 250


def diverse(results: DataFrame, count: int, id_col: str) -> DataFrame:
    """SMP-5: greedy choice by relevance, novelty and redundancy; at most two of a title family while others are left.

    Works on the best ``MAX_CANDIDATES`` of each query, which is what a search returns, so a group is
    bounded. Columns: query_id, id, score, features (array), origin, packs (array), institution, family.
    """
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    few = results.withColumn("__place", best).where(F.col("__place") <= MAX_CANDIDATES).drop("__place")
    kinds = dict(results.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [{**r, "features": set(r["features"]) - {""}, "packs": set(r["packs"])} for r in pdf.to_dict("records")]
        top = max((r["score"] for r in left), default=1.0) or 1.0
        chosen: list[dict] = []
        while left and len(chosen) < count:
            packs = set().union(*(c["packs"] for c in chosen))
            origins, houses = {c["origin"] for c in chosen}, {c["institution"] for c in chosen}
            families = [c["family"] for c in chosen]

            def utility(r: dict) -> tuple[float, object]:
                overlap = max((len(r["features"] & c["features"]) / len(r["features"] | c["features"]) for c in chosen if r["features"] | c["features"]), default=0.0)
                gains = {"relevance": r["score"] / top, "origin": float(bool(r["origin"]) and r["origin"] not in origins), "pack": float(bool(r["packs"] - packs)), "institution": float(bool(r["institution"]) and r["institution"] not in houses), "redundancy": -overlap}
                return sum(MMR[k] * v for k, v in gains.items()), r[id_col]

            new = [r for r in left if r["origin"] and r["origin"] not in origins]
            pool = [r for r in new if r["packs"] - packs] or new or left
            pool = [r for r in pool if not r["family"] or families.count(r["family"]) < 2] or pool
            pick = max(pool, key=utility)
            chosen.append(pick | {"utility": round(utility(pick)[0], 6)})
            left.remove(pick)
        return pd.DataFrame([(c["query_id"], c[id_col], k + 1, c["utility"]) for k, c in enumerate(chosen)], columns=["query_id", id_col, "place", "utility"])

    return few.groupBy("query_id").applyInPandas(choose, f"query_id string, `{id_col}` {kinds[id_col]}, place int, utility double")


def themed(pool: DataFrame, theme: str, count: int, id_col: str, kind: str, band: str, cap: int, kind_cost: float = 18.0, band_cost: float = 7.0) -> DataFrame:
    """SMP-3: greedy choice within each theme by score less what a kind and a band have been chosen before; a cap for each kind.

    Works on the best ``MAX_CANDIDATES`` of each theme; pinned rows (``pinned``) come first.
    """
    best = F.row_number().over(Window.partitionBy(theme).orderBy(F.desc("pinned"), F.desc("score"), id_col))
    few = pool.withColumn("__place", best).where(F.col("__place") <= MAX_CANDIDATES).drop("__place")
    kinds = dict(pool.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values(["pinned", "score", id_col], ascending=[False, False, True]).to_dict("records")
        chosen: list[dict] = []
        while left and len(chosen) < count:
            seen_kind, seen_band = [c[kind] for c in chosen], [c[band] for c in chosen]
            free = [r for r in left if r["pinned"] or seen_kind.count(r[kind]) < cap]
            if not free:
                break
            pick = max(free, key=lambda r: (bool(r["pinned"]), r["score"] - kind_cost * seen_kind.count(r[kind]) - band_cost * seen_band.count(r[band])))
            chosen.append(pick)
            left.remove(pick)
        return pd.DataFrame([(c[theme], c[id_col], k + 1) for k, c in enumerate(chosen)], columns=[theme, id_col, "place"])

    return few.groupBy(theme).applyInPandas(choose, f"`{theme}` {kinds[theme]}, `{id_col}` {kinds[id_col]}, place int")


def swapped_in(chosen: DataFrame, pool: DataFrame, id_col: str, wanted: Column) -> DataFrame:
    """SMP-9: if no chosen row of a query is wanted, the last one gives way to the best wanted row of the pool."""
    has = chosen.groupBy("query_id").agg(F.max(wanted.cast("int")).alias("has"), F.max("place").alias("last"))
    spare = pool.join(chosen.select("query_id", id_col), ["query_id", id_col], "left_anti").where(wanted)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    best = spare.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", F.col(id_col).alias("spare"))
    out = chosen.join(has, "query_id").join(best, "query_id", "left")
    swap = (F.col("has") == 0) & (F.col("place") == F.col("last")) & F.col("spare").isNotNull()
    return out.select("query_id", F.when(swap, F.col("spare")).otherwise(F.col(id_col)).alias(id_col), "place")


def ranked_sets(rows: DataFrame, n: int, id_col: str = "object_id") -> DataFrame:
    """The best ``n`` rows of each query with their place."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def roles(rows: DataFrame, group: str, order: str) -> DataFrame:
    """CLS-9: first, last and middle row of each group have parts of their own, the others support."""
    own = Window.partitionBy(group)
    out = rows.withColumn("place", F.row_number().over(own.orderBy(order))).withColumn("__n", F.count("*").over(own))
    role = F.when(F.col("place") == 1, "opening").when(F.col("place") == F.col("__n"), "closing").when(F.col("place") == F.floor((F.col("__n") + 1) / 2), "pivot").otherwise("support")
    return out.withColumn("role", role).drop("__n")


def redundancy(candidates: DataFrame, chosen: DataFrame, id_col: str) -> DataFrame:
    """JON-11: the largest Jaccard similarity of each candidate's features to those of a chosen row.

    Rows with the same features are one set, and only sets are compared; overlaps are counted from shared features, so
    pairs of sets that share nothing are not made.
    """
    key = F.array_sort("features").alias("own")
    sets = lambda df, name: df.select(key).distinct().select(F.col("own").alias(name), F.explode("own").alias("f"))
    both = sets(candidates, "a").join(sets(chosen, "b"), "f").groupBy("a", "b").agg(F.count("*").alias("n"))
    best = both.groupBy(F.col("a").alias("own")).agg(F.max(F.col("n") / (F.size("a") + F.size("b") - F.col("n"))).alias("redundancy"))
    return candidates.select(id_col, key).join(best, "own", "left").select(id_col, F.coalesce("redundancy", F.lit(0.0)).alias("redundancy"))


def starters(rows: DataFrame, group: str, id_col: str, packs: str, institution: str, evidence: str, limit: int = 5) -> DataFrame:
    """SMP-4: up to ``limit`` rows of each group, each the best beside those before it: most new packs, then a new institution, then most evidence, then the larger id.

    Rows with the same packs and institution differ in evidence and id only, so no more than the first ``limit`` of them
    can be picked; that bounds what the rounds go through. A round is one best row of each group, so a
    group is never in one place. Null packs are none, and a missing institution is one of its own.
    """
    own = rows.select(group, id_col, F.sort_array(F.array_distinct(F.coalesce(F.array_compact(packs), F.array().cast("array<string>")))).alias("packs"), F.coalesce(F.col(institution).cast("string"), F.lit("")).alias("institution"), F.coalesce(F.col(evidence).cast("long"), F.lit(0)).alias("evidence"))
    order = Window.partitionBy(group, "packs", "institution").orderBy(F.desc("evidence"), F.desc(id_col))
    left = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    none = F.array().cast("array<string>")
    state = left.groupBy(group).agg(F.lit(0).alias("n")).select(group, none.alias("seen"), none.alias("houses"), F.array().cast(f"array<{dict(rows.dtypes)[id_col]}>").alias("picked"))
    for _ in range(limit):
        gain = F.size(F.array_except("packs", "seen"))
        value = F.struct(gain.alias("gain"), (~F.array_contains("houses", F.col("institution"))).alias("new"), "evidence", id_col)
        open_rows = left.join(state, group).where(~F.array_contains("picked", F.col(id_col)))
        best = open_rows.groupBy(group).agg(F.max_by(F.struct(id_col, "packs", "institution"), value).alias("b"))
        state = state.join(best, group, "left").select(
            group,
            F.when(F.col("b").isNull(), F.col("seen")).otherwise(F.array_union("seen", "b.packs")).alias("seen"),
            F.when(F.col("b").isNull(), F.col("houses")).otherwise(F.array_union("houses", F.array("b.institution"))).alias("houses"),
            F.when(F.col("b").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array(f"b.{id_col}"))).alias("picked"),
        )
    return state.select(group, F.posexplode("picked").alias("at", id_col)).select(group, id_col, (F.col("at") + 1).alias("place"))
