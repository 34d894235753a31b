"""Date, number, array and map functions as Column expressions (DAT-*, MTH-*, ARR-*, MAP-1)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_range(text: Column) -> Column:
    """DAT-1: ``struct(earliest, latest)`` of the years of three or four digits up to 2100; BCE negates and turns them.

    Words end where a character other than ``[A-Za-z0-9_]`` stands, so the pattern means the same in SQL engines.
    """
    pieces = F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+")
    years = F.filter(F.transform(F.filter(pieces, lambda p: p.rlike("^[0-9]{3,4}$")), lambda p: p.cast("int")), lambda y: y <= 2100)
    before = F.coalesce(text, F.lit("")).rlike(r"(?i)(^|[^a-z0-9_])b\.?c\.?(e?)([^a-z0-9_]|$)")
    low, high = F.array_min(years), F.array_max(years)
    return F.struct(F.when(before, -high).otherwise(low).alias("earliest"), F.when(before, -low).otherwise(high).alias("latest"))


def repaired_dates(earliest: Column, latest: Column) -> Column:
    """PRJ-7: each end stands in for a missing other one; ends in the wrong order are exchanged."""
    a, b = F.coalesce(earliest, latest), F.coalesce(latest, earliest)
    return F.struct(F.least(a, b).alias("earliest"), F.greatest(a, b).alias("latest"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """MTH-1: the vector divided by its norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def above_floor(score: Column, floor: float) -> Column:
    """MTH-2: where a score stands between its floor and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - floor) / (1 - floor)))


def hybrid_blend(fused: Column, evidence: Column, best: Column) -> Column:
    """MTH-3."""
    return 100 * (0.55 * fused + 0.25 * evidence + 0.20 * best)


def rerank_blend(relevance: Column, prior: Column) -> Column:
    """MTH-4."""
    return 100 * (0.85 * relevance + 0.15 * prior)


def spread_pages(total: int, wanted: int) -> list[int]:
    """SMP-2: evenly spaced pages with both ends, rounded half to even."""
    wanted = min(max(0, wanted), max(0, total))
    if wanted < 2:
        return [1] * wanted
    pages = {1 + round(i * (total - 1) / (wanted - 1)) for i in range(wanted)}
    for page in range(1, total + 1):
        if len(pages) == wanted:
            break
        pages.add(page)
    return sorted(pages)


def spread(total: Column, wanted: int) -> Column:
    """SMP-2 for each row: the pages of ``spread_pages`` as an array; steps of one page or more never round to the same page."""
    n = F.least(F.greatest(total, F.lit(0)), F.lit(max(0, wanted))).cast("int")
    page = lambda i: (1 + F.bround(i * (total - 1) / F.greatest(n - 1, F.lit(1)).cast("double"))).cast("long")
    return F.when(n < 1, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), page))


def chapter_sizes(items: int, chapters: int) -> list[int]:
    """MTH-5: as even as possible, the first chapters larger."""
    base, more = divmod(items, chapters)
    return [base + (k < more) for k in range(chapters)]


def capped_score(counts: Sequence[tuple[Column, float, float]], flags: Sequence[tuple[Column, float]]) -> Column:
    """MTH-6: weights times counts, each count up to its cap, and a bonus for each flag."""
    parts = [F.least(F.coalesce(c, F.lit(0)), F.lit(cap)) * weight for c, cap, weight in counts]
    parts += [F.when(flag, bonus).otherwise(0.0) for flag, bonus in flags]
    return reduce(Column.__add__, parts, F.lit(0.0))


def score_map(**fields: Column) -> Column:
    """MAP-1: named scores as one map of doubles."""
    return F.map_from_entries(F.array(*(F.struct(F.lit(name).alias("key"), c.cast("double").alias("value")) for name, c in fields.items())))
