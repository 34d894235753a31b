"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; a
line above ``MAX_RATIO`` (and on at least ``MIN_PAGES`` pages) is boilerplate of
that host and is dropped wherever it stands there.

Counts are summed before the shuffle and keyed by host and line hash, so neither
a hot host nor a hot line meets in one task. A host has at most L / MAX_RATIO
boilerplate lines, L being its mean number of distinct lines a page, so they fit
in one array for each host. These arrays are broadcast while they hold up to
``SENT_LINES`` lines in all; beyond that the pages are joined with them by a
shuffle that AQE can split.

Defined results: blank lines are neither counted nor dropped; a null text stays
null and is a page without lines; rows with a null host form one host; repeated
rows are pages of their own; a text all of whose lines go becomes empty; a very long
text is one row of one task; lines are equal byte by byte, and a line exactly at the
ratio stays; an empty table gives an empty result; other columns are passed through,
whatever their names. The host is a column of the table (``source`` for documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled

MAX_RATIO = 0.1
MIN_PAGES = 5
SENT_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(line, F.length(line))


def boilerplate(pages: DataFrame, host: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, lines)``: the hashes of each host's boilerplate lines."""
    own = pages.select(F.col(host).alias("host"), F.col(text_col).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _hash))
    counts = own.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > max_ratio * F.col("pages"))
    return common.select(counts["host"].alias("host"), "line").groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def _marked(pages: DataFrame, host: str, text_col: str, max_ratio: float, min_pages: int) -> tuple[DataFrame, str]:
    """``pages`` with the boilerplate hashes of the row's host, and the name of their column."""
    name, of = free_name(pages, "boilerplate"), free_name(pages, "boilerplate_host")
    bad = settled(lambda: boilerplate(pages, host, text_col, max_ratio, min_pages)).select(F.col("host").alias(of), F.col("lines").alias(name))
    size = bad.agg(F.sum(F.size(name))).first()[0] or 0
    small = F.broadcast(bad) if size <= SENT_LINES else bad
    return pages.join(small, F.col(host).eqNullSafe(F.col(of)), "left").drop(of), name


def _stays(line: Column, bad: str) -> Column:
    return F.col(bad).isNull() | (F.trim(line) == "") | ~F.array_contains(bad, _hash(line))


def report(pages: DataFrame, host: str = "source", id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """For every row: its lines with text, how many of them are dropped, and what is left."""
    own = pages.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text_col).alias("text"))
    marked, bad = _marked(own, "host", "text", max_ratio, min_pages)
    stays = lambda line: _stays(line, bad)
    lines = F.filter(F.coalesce(_lines(F.col("text")), F.array()), lambda x: F.trim(x) != "")
    kept = F.filter(_lines(F.col("text")), stays)
    return marked.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.filter(lines, stays))).cast("long").alias("n_dropped"),
        F.array_join(kept, "\n").alias("text"),
    )


def without_boilerplate(pages: DataFrame, host: str = "source", text_col: str = "text", length_col: str | None = None, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines gone; ``length_col``, if given, gets the new length where a text changed."""
    marked, bad = _marked(pages, host, text_col, max_ratio, min_pages)
    columns = {text_col: F.array_join(F.filter(_lines(F.col(text_col)), lambda line: _stays(line, bad)), "\n")}
    if length_col:
        kind = pages.schema[length_col].dataType
        columns[length_col] = F.when(F.col(text_col) == columns[text_col], F.col(length_col)).otherwise(F.length(columns[text_col]).cast(kind))
    return marked.withColumns(columns).select(pages.columns)
