"""Typed facet and interval filters (FLT-1..9, FLT-16..23, PRJ-6, JON-4/5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

YEARS = (-10_000, 3_000)
#: Facets matched as whole-word phrases; the others are matched as values.
PHRASE_FACETS = ("materials",)
FACET_LISTS = {"cultures": "culture", "institutions": "institution", "materials": "material", "object_types": "object_type", "rights": "rights"}
SPLIT = r"\s*(?:[;,；，|]|\s/\s)\s*"


@dataclass(frozen=True)
class FilterSpec:
    """M10: the constraints that may be asked for; all that are set must hold."""

    date_start: int | None = None
    date_end: int | None = None
    cultures: tuple[str, ...] = ()
    institutions: tuple[str, ...] = ()
    materials: tuple[str, ...] = ()
    object_types: tuple[str, ...] = ()
    rights: tuple[str, ...] = ()
    image_required: bool = False
    evidence_depth: tuple[str, ...] = ()

    def __post_init__(self):
        for year in (self.date_start, self.date_end):
            if year is not None and (isinstance(year, bool) or not YEARS[0] <= year <= YEARS[1]):
                raise ValueError(f"not a year in range: {year!r}")
        if self.date_start is not None and self.date_end is not None and self.date_start > self.date_end:
            raise ValueError("the interval ends before it starts")

    @property
    def empty(self) -> bool:
        return self == FilterSpec()


def parsed(raw: Mapping[str, object] | None) -> FilterSpec | None:
    """FLT-8: a spec from a planner's answer; an unknown key or a wrong type refuses the whole."""
    known = {f.name: f for f in fields(FilterSpec)}
    if raw is None or set(raw) - set(known):
        return None
    values: dict[str, object] = {}
    for name, value in raw.items():
        if value is None:
            continue
        if name.startswith("date_"):
            if isinstance(value, bool) or not isinstance(value, int):
                return None
        elif name == "image_required":
            if not isinstance(value, bool):
                return None
        else:
            if not isinstance(value, (list, tuple)) or not all(isinstance(x, str) and x.strip() for x in value):
                return None
            value = tuple(value)
        values[name] = value
    try:
        return FilterSpec(**values)  # type: ignore[arg-type]
    except ValueError:
        return None


def facet_values(objects: DataFrame, id_col: str, facets: Mapping[str, Sequence[str]]) -> DataFrame:
    """PRJ-6: long rows (id, facet, value_norm, value_display): each value, with spaces for underscores, and its parts."""
    rows = []
    for facet, columns in facets.items():
        for i, c in enumerate(columns):
            v = F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))
            forms = F.concat(F.array(v, F.translate(v, "_", " ")), F.split(v, SPLIT))
            rows.append(objects.select(id_col, F.lit(facet).alias("facet"), F.lit(i).alias("source"), F.posexplode(forms).alias("place", "value")))
    long = reduce(DataFrame.unionByName, rows).withColumn("value_norm", T.normalise(F.col("value"))).where("value_norm <> ''")
    return long.groupBy(id_col, "facet", "value_norm").agg(F.min_by(F.substring("value", 1, 200), F.struct("source", "place")).alias("value_display"))


def overlaps(earliest: Column, latest: Column, start: int | None, end: int | None) -> Column:
    """FLT-2: intervals that touch the asked one; a missing date never does."""
    low = latest >= start if start is not None else latest.isNotNull()
    high = earliest <= end if end is not None else earliest.isNotNull()
    return F.coalesce(low & high, F.lit(False))


def expanded(values: Sequence[str], classes: Sequence[Sequence[str]]) -> list[str]:
    """FLT-5: values with all names of the classes that they are in."""
    asked = [v.strip().lower().replace("_", " ") for v in values]
    out = dict.fromkeys(asked)
    for names in classes:
        if any(n.replace("_", " ") in asked for n in names):
            out.update(dict.fromkeys(n for n in names))
    return list(out)


def matching(objects: DataFrame, facets: DataFrame, spec: FilterSpec, id_col: str, classes: Sequence[Sequence[str]] = ()) -> DataFrame:
    """FLT-1, FLT-3..6: the objects that meet every constraint. A facet is a semi-join: OR within it, AND across."""
    out = objects
    if spec.date_start is not None or spec.date_end is not None:
        out = out.where(overlaps(F.col("date_earliest"), F.col("date_latest"), spec.date_start, spec.date_end))
    if spec.image_required:
        out = out.where(F.coalesce(F.col("image_url"), F.lit("")) != "")
    if spec.evidence_depth:
        out = out.where(F.col("evidence_depth").isin(*spec.evidence_depth))
    for name, facet in FACET_LISTS.items():
        asked = getattr(spec, name)
        if not asked:
            continue
        values = expanded(asked, classes) if name == "cultures" else [a.strip().lower() for a in asked]
        if name in PHRASE_FACETS:
            test = reduce(Column.__or__, (T.contains_phrase(F.col("value_norm"), F.lit(v)) for v in values))
        else:
            test = F.col("value_norm").isin(*values)
        out = out.join(facets.where((F.col("facet") == facet) & test).select(id_col), id_col, "left_semi")
    return out


def matching_ids(objects: DataFrame, facets: DataFrame, spec: FilterSpec, id_col: str, allowed: DataFrame | None = None) -> DataFrame:
    """FLT-7, SET-5: ids in order, restricted to the allowed ones; an empty spec asks nothing of the tables."""
    found = objects if spec.empty else matching(objects, facets, spec, id_col)
    if allowed is not None:
        found = found.join(allowed, id_col, "left_semi")
    return found.select(id_col).orderBy(id_col)


def small_pool(found: DataFrame, id_col: str, most: int = 60, score: float = 0.01) -> DataFrame:
    """FLT-9: all rows of a small result as a recall channel; nothing of a larger one."""
    total = found.agg(F.count("*").alias("__n"))
    return found.join(F.broadcast(total)).where(F.col("__n") <= most).select(id_col, F.lit(score).alias("score"))


@dataclass(frozen=True)
class Gates:
    """FLT-14, FLT-19, FLT-23: named checks of a row; each becomes a boolean column."""

    checks: Mapping[str, Column] = field(default_factory=dict)

    def violations(self, rows: DataFrame) -> DataFrame:
        """(check, violations), one pass."""
        counted = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in self.checks.items()))
        pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in self.checks))
        return counted.select(F.explode(pairs).alias("p")).select("p.*")

    def passing(self, rows: DataFrame) -> DataFrame:
        return rows.where(reduce(Column.__and__, (F.coalesce(c, F.lit(False)) for c in self.checks.values())))


def widened(rows: DataFrame, narrow: Column, wide: Column, least: int) -> DataFrame:
    """FLT-18: the narrow choice if it has ``least`` rows, else the wide one."""
    counted = rows.agg(F.count_if(narrow).alias("__n"))
    return rows.join(F.broadcast(counted)).where(F.when(F.col("__n") >= least, narrow).otherwise(wide)).drop("__n")
