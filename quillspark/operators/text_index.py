"""A stored full-text index: build it once, search it by reading the wanted terms only (SNK-5, QRY-3..4).

Four tables in one versioned folder, moved into place together:

* ``postings``: a row for each term of a document with the frequency in each field and the fields' lengths, so that scoring
  joins nothing. Terms are dealt by a hash; rows are dealt by ranges of (deal, run of documents) and sorted by (deal, term,
  block) in small row groups: a filter on terms reads their row groups alone, and a term of many documents spreads over
  many files. The empty term stands for the document itself.
* ``blocks``: for each stretch of a term's postings in one block the number of documents, the largest frequencies and the
  smallest lengths; short stretches of several blocks share a row without a block. The score falls with length and rises
  with frequency, so these bound it under any statistics. Documents of like length share a block, which keeps the bounds
  apart. Made file by file from the sorted postings.
* ``terms``: document frequencies.
* ``manifest``: one row with the number of documents, total lengths, and counts and digests of the other tables.

Only packed runs of postings are shuffled (``posting_runs``), once. Ids are unique; a repeated id is a document each time.

Exclusions change the statistics; they follow from the manifest less what the postings of the excluded terms hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.writers import delete, move_into_place

from . import posting_runs, search

#: Bytes of a row group of the postings; a look-up reads whole pages of few of them.
ROW_GROUP = 1 << 20
#: Bytes of rows handed to a Python worker at a time.
BATCH_BYTES = 4_000_000
#: Postings that a task opens and sorts, about.
PART_POSTINGS = 2_000_000
#: Blocks of documents: four length classes to a doubling, each dealt into so many parts.
PARTS = 16
#: Blocks that are scored first, for the score that others must reach.
FIRST_BLOCKS = 24
_SLACK = 1e-5


def _block(total: Column, id_col: str) -> Column:
    return (F.floor(F.log2(total + 1) * 4) * PARTS + F.pmod(F.xxhash64(id_col), F.lit(PARTS))).cast("int")


def _packed(index: search.Index) -> DataFrame:
    """Postings of all documents in runs, from one scan that tokenises once; a null field has no tokens."""
    names = list(index.fields)
    rows = index.docs.select(F.col(index.id_col).alias("id"), *(F.coalesce(f, F.array().cast("array<string>")).alias(f) for f in names))
    return rows.mapInArrow(posting_runs.packer(names), posting_runs.PACKED)


def _numbers(fields: Sequence[str]) -> str:
    return ", ".join(f"tf_{f} int" for f in fields) + ", " + ", ".join(f"len_{f} int" for f in fields)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python workers in batches of ``BATCH_BYTES`` while the index is built."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _digest(rows: DataFrame) -> list[Column]:
    """Count and order-free digest of all columns."""
    return [F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0).cast("long")).alias("digest")]


def build(index: search.Index, root: str, version: str) -> TextIndex:
    """Write the index below ``root``; readers see all of it or nothing. An existing version is an error."""
    spark = index.docs.sparkSession
    with _small_batches(spark):
        return _build(index, root, version)


def _build(index: search.Index, root: str, version: str) -> TextIndex:
    spark, names = index.docs.sparkSession, list(index.fields)
    staging = f"{root}/.staging-{uuid.uuid4().hex}"
    packed = _packed(index)
    packed.write.parquet(f"{staging}-runs")  # dealing by ranges reads its rows twice
    id_type = dict(index.docs.dtypes)[index.id_col]
    runs = spark.read.schema(packed.schema).parquet(f"{staging}-runs")
    # by number: packed rows are a small part of what is opened and sorted behind them, and Spark would choose by their size
    parts = max(1, -(-(runs.agg(F.sum("postings")).first()[0] or 0) // PART_POSTINGS))
    dealt = runs.repartitionByRange(parts, "deal", "run")
    total = reduce(Column.__add__, (F.col(f"len_{f}") for f in names))
    opened = dealt.mapInArrow(posting_runs.opener(names), f"deal int, term string, id {id_type}, {_numbers(names)}")
    made = opened.withColumn("block", _block(total, "id")).sortWithinPartitions("deal", "term", "block")
    made.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", ROW_GROUP >> 4).parquet(f"{staging}/postings")
    delete(spark, f"{staging}-runs")
    stored = spark.read.schema(made.schema).parquet(f"{staging}/postings")
    blocks = stored.drop("deal", "id").mapInArrow(posting_runs.bounder(names), f"term string, block int, n long, {_numbers(names)}")
    blocks.write.option("parquet.block.size", ROW_GROUP).parquet(f"{staging}/blocks")
    blocks = spark.read.schema(blocks.schema).parquet(f"{staging}/blocks")
    terms = blocks.where("term <> ''").groupBy("term").agg(F.sum("n").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{staging}/terms")
    terms = spark.read.schema(terms.schema).parquet(f"{staging}/terms")
    whole = stored.where((F.col("deal") == posting_runs.deal("")) & (F.col("term") == "")).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"len_{f}"), F.lit(0)).alias(f"total_{f}") for f in index.fields))
    own = [t.agg(F.struct(*_digest(t)).alias(name)) for name, t in (("postings", stored), ("blocks", blocks), ("terms", terms))]
    reduce(lambda a, b: a.crossJoin(b), own, whole).coalesce(1).write.parquet(f"{staging}/manifest")
    move_into_place(spark, staging, f"{root}/{version}")
    return TextIndex(spark, f"{root}/{version}", index.id_col, dict(index.fields))


@dataclass
class TextIndex:
    """A stored index; ``id_col`` names the ids in results."""

    spark: SparkSession
    path: str
    id_col: str
    fields: dict[str, float]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def manifest(self) -> Row:
        return self.table("manifest").first()

    def check(self) -> DataFrame:
        """``(name, rows, found, ok)``: each table's count and digest against the manifest."""
        kept = self.table("manifest")
        parts = []
        for name in ("postings", "blocks", "terms"):
            t = self.table(name)
            now = t.agg(F.struct(*_digest(t)).alias("now"))
            parts.append(kept.select(F.col(name).alias("kept")).crossJoin(now).select(F.lit(name).alias("name"), F.col("kept.rows").alias("rows"), F.col("now.rows").alias("found"), (F.col("kept") == F.col("now")).alias("ok")))
        return reduce(DataFrame.unionByName, parts)

    def postings(self, terms: Sequence[str], blocks: Sequence[int] | None = None) -> DataFrame:
        """Rows of the wanted terms, of all blocks or some; both filters reach the row groups."""
        rows = self.table("postings").where(F.col("deal").isin(*{posting_runs.deal(t) for t in terms}) & F.col("term").isin(*terms))
        if blocks is not None:
            rows = rows.where(F.col("block").between(min(blocks, default=0), max(blocks, default=-1)) & F.col("block").isin(*blocks))
        return rows


def _documents(stored: TextIndex, postings: DataFrame) -> DataFrame:
    """``(id, lengths, hits)``: the postings of each document together."""
    own = F.collect_list(F.struct("term", *(f"tf_{f}" for f in stored.fields))).alias("own")
    lengths = F.struct(*(F.first(f"len_{f}").alias(f) for f in stored.fields))
    rows = postings.where("term <> ''").groupBy(F.col("id").alias(stored.id_col)).agg(lengths.alias("lengths"), own)
    of = lambda f: F.transform(F.filter("own", lambda p: p[f"tf_{f}"] > 0), lambda p: F.struct(F.lit(f).alias("field"), p["term"].alias("term"), p[f"tf_{f}"].alias("tf")))
    return rows.select(stored.id_col, "lengths", F.concat(*map(of, stored.fields)).alias("hits"))


def _gated(rows: DataFrame, plans: Sequence[search.QueryPlan], spaces: Sequence[tuple]) -> DataFrame:
    """``left_in``: exclusion sets that leave the document in; ``queries``: the plans that may return it."""
    marks = F.col("hits.term")
    titles = F.filter("hits", lambda h: h["field"] == "title")["term"]
    kept = {e: search.excludes(marks, e) if e else F.lit(True) for e in spaces}

    def passes(p: search.QueryPlan) -> Column:
        title = search.any_term(titles, p.title_terms) if p.title_terms else F.lit(True)
        return kept[p.excluded] & search.anchored(marks, p.groups) & title

    queries = F.array(*(F.when(passes(p), F.struct(F.lit(p.query_id).alias("query_id"), F.lit(spaces.index(p.excluded)).alias("space"))) for p in plans))
    left_in = F.array(*(F.when(kept[e], j) for j, e in enumerate(spaces)))
    return rows.select("*", F.filter(left_in, lambda x: x.isNotNull()).alias("left_in"), F.filter(queries, lambda x: x.isNotNull()).alias("queries"))


def _statistics(stored: TextIndex, rows: DataFrame, spaces: Sequence[tuple], terms: Sequence[str]) -> DataFrame:
    """``(space, n, means, df)`` of each exclusion set: the manifest less the documents it leaves out; one small row each."""
    whole = stored.manifest()
    out_of = F.explode(F.array_except(F.array(*map(F.lit, range(len(spaces)))), "left_in")).alias("space")
    gone = rows.select("lengths", out_of).groupBy("space").agg(F.count("*").alias("n"), *(F.sum(f"lengths.{f}").alias(f) for f in stored.fields))
    held = rows.select("left_in", F.explode(F.array_distinct("hits.term")).alias("term")).where(F.col("term").isin(*terms))
    df = held.select(F.explode("left_in").alias("space"), "term").groupBy("space", "term").agg(F.count("*").alias("n")).groupBy("space").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("df"))
    every = stored.spark.range(len(spaces)).select(F.col("id").cast("int").alias("space"))
    n = F.lit(whole["n"]) - F.coalesce("n", F.lit(0))
    means = F.struct(*((F.when(n > 0, (F.lit(whole[f"total_{f}"]) - F.coalesce(f, F.lit(0))) / n)).alias(f) for f in stored.fields))
    none = F.create_map().cast("map<string,bigint>")
    return every.join(gone, "space", "left").select("space", n.alias("n"), means.alias("means")).join(df, "space", "left").withColumn("df", F.coalesce("df", none))


def _scored(stored: TextIndex, rows: DataFrame, plans: Sequence[search.QueryPlan], stats: DataFrame) -> DataFrame:
    index = search.Index(rows, stored.id_col, stored.fields)
    each = rows.select(stored.id_col, "lengths", "hits", F.explode("queries").alias("q")).select(stored.id_col, "lengths", "hits", "q.query_id", "q.space")
    scored = each.join(F.broadcast(stats), "space").join(F.broadcast(search.query_terms(stored.spark, plans)), "query_id").withColumn("score", search.fielded_score(index))
    return scored.where("score > 0").select("query_id", stored.id_col, "score")


def _stored_statistics(stored: TextIndex, terms: Sequence[str]) -> DataFrame:
    """The same for no exclusions, from the manifest and the wanted terms' frequencies alone."""
    whole = stored.manifest()
    df = stored.table("terms").where(F.col("term").isin(*terms)).agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    means = F.struct(*(F.lit(whole[f"total_{f}"] / whole["n"] if whole["n"] else None).cast("double").alias(f) for f in stored.fields))
    return df.select(F.lit(0).alias("space"), F.lit(whole["n"]).alias("n"), means.alias("means"), "df")


def _block_rows(stored: TextIndex, terms: Sequence[str]) -> DataFrame:
    """``(term, block, tf_*, len_*)``: a term's largest frequencies and smallest lengths in each block that may hold it.

    A term of few documents is looked up in the postings; bounds without a block hold for every one.
    """
    bounds = [F.max(f"tf_{f}").alias(f"tf_{f}") for f in stored.fields] + [F.min(f"len_{f}").alias(f"len_{f}") for f in stored.fields]
    rare = [r["term"] for r in stored.table("terms").where(F.col("term").isin(*terms) & (F.col("df") < posting_runs.LEAST)).collect()]
    rows = stored.table("blocks").where(F.col("term").isin(*(set(terms) - set(rare)))).drop("n")
    every = stored.table("blocks").where("term = ''").select(F.col("block").alias("any_block")).distinct()
    spread = rows.where("block IS NULL").groupBy("term").agg(*bounds).crossJoin(F.broadcast(every)).withColumn("block", F.col("any_block"))
    few = stored.postings(rare).select(*rows.columns)
    return rows.where("block IS NOT NULL").unionByName(spread.select(*rows.columns)).unionByName(few).groupBy("term", "block").agg(*bounds)


def block_bounds(stored: TextIndex, plans: Sequence[search.QueryPlan], stats: DataFrame) -> DataFrame:
    """``(query_id, block, bound)``: what no document of the block can exceed; blocks that lack a whole group of terms are left out.

    At most a row for each query and block, and there are a few hundred blocks whatever the number of documents.
    """
    terms = sorted({t for p in plans for t in p.terms} | {t for p in plans for g in p.groups for t in g})
    rows = _block_rows(stored, terms)
    means = stats.select("means", F.col("n").alias("n_docs"), "df")
    df = F.try_element_at("df", F.col("term"))
    idf = F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))

    def share(f: str) -> Column:
        tf, mean = F.col(f"tf_{f}"), F.greatest(F.col("means")[f], F.lit(1.0))
        return stored.fields[f] * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col(f"len_{f}") / mean))

    each = rows.join(F.broadcast(means)).select("term", "block", (idf * reduce(Column.__add__, map(share, stored.fields))).alias("most"))
    asked = F.broadcast(search.query_terms(stored.spark, plans))
    held = each.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "most"))).alias("most")).join(asked)
    bound = F.aggregate(F.map_entries("boosts"), F.lit(0.0), lambda total, b: total + b["value"] * F.coalesce(F.try_element_at("most", b["key"]), F.lit(0.0)))
    open_to = reduce(Column.__or__, (F.col("query_id").eqNullSafe(p.query_id) & search.anchored(F.map_keys("most"), p.groups) for p in plans))
    return held.where(open_to).select("query_id", "block", bound.alias("bound")).where("bound > 0")


def lexical_search(stored: TextIndex, plans: Sequence[search.QueryPlan], limit: int | None = None) -> DataFrame:
    """QRY-3/4 on the stored index: the same rows and scores as ``search.lexical_search`` with all fields searchable.

    With a limit and no exclusions, blocks that cannot reach the last place of any query are not read.
    """
    spaces = list(dict.fromkeys(p.excluded for p in plans))
    terms = sorted({t for p in plans for t in p.terms})
    asked = sorted({t for p in plans for gs in (p.groups, p.excluded) for g in gs for t in g} | {t for p in plans for t in p.title_terms} | set(terms))
    whole = spaces == [()]

    def found(blocks: Sequence[int] | None) -> DataFrame:
        rows = _gated(_documents(stored, stored.postings(asked, blocks)), plans, spaces)
        return _scored(stored, rows, plans, _stored_statistics(stored, terms) if whole else _statistics(stored, rows, spaces, terms))

    blocks = None
    if limit and whole:
        bounds = block_bounds(stored, plans, _stored_statistics(stored, terms)).collect()  # bounded, see there
        by_query: dict[str, list[tuple[float, int]]] = {}
        for r in bounds:
            by_query.setdefault(r["query_id"], []).append((r["bound"], r["block"]))
        first = sorted({b for own in by_query.values() for _, b in sorted(own, reverse=True)[:FIRST_BLOCKS]})
        if len(first) < len({r["block"] for r in bounds}):
            last = {r["query_id"]: r["score"] for r in search.ranked(found(first), stored.id_col, limit).where(F.col("rank") == limit).select("query_id", "score").collect()}
            blocks = sorted({b for q, own in by_query.items() for most, b in own if most + _SLACK >= last.get(q, 0.0)})
        else:
            blocks = first
    return search.ranked(found(blocks), stored.id_col, limit)
