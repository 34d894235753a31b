"""Lexical search: postings, fielded BM25, full-text BM25, gates (AGG-4..7, FLT-9..15, QRY-1..5).

Everything carries ``query_id``, so many questions are one job. The queries' terms are few and are
sent to the scan of the corpus, where each document becomes one small row: its field lengths, the
frequencies of wanted terms, and what the gates say. One scan gives the statistics (a row for each
set of exclusions), a second one scores row by row; token arrays and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Field weights and saturation of the fielded score; weights and saturation of the full-text score.
FIELD_WEIGHTS = {"title": 5.0, "routing": 3.0, "metadata": 2.0, "content": 1.0}
K1, B, EXACT_BOOST = 1.35, 0.72, 1.2
FTS_WEIGHTS = {"title": 5.0, "routing": 3.0, "metadata": 2.0, "content": 1.0}
FTS_K1, FTS_B, FTS_LEAST_IDF = 1.2, 0.75, 1e-6
RECALL_LIMIT = 500


@dataclass(frozen=True)
class QueryPlan:
    """QRY-1: what a question asks of the corpus. ``groups`` is an AND of ORs over terms."""

    query_id: str
    terms: tuple[str, ...]
    exact: tuple[str, ...] = ()
    groups: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[tuple[str, ...], ...] = ()
    title_terms: tuple[str, ...] = ()


def plan(query_id: str, question: str, aliases: Mapping[str, Sequence[str]] | None = None, stopwords: Sequence[str] = ()) -> QueryPlan:
    """QRY-1: terms of a question with inflections and aliases; each word of it is a group of alternatives."""
    words = [w for w in T.query_words(question) if w not in stopwords and len(w) > 1]
    groups = tuple(tuple(sorted(T.inflected([w, *(aliases or {}).get(w, ())]))) for w in words)
    return QueryPlan(query_id, tuple(sorted({t for g in groups for t in g})), tuple(words), groups)


def atomic_plan(query_id: str, phrase: str) -> QueryPlan:
    """QRY-2: every word must occur."""
    words = tuple(T.query_words(phrase))
    return QueryPlan(query_id, words, words, tuple((w,) for w in words))


def planned(question: Column) -> Column:
    """QRY-1 for each row of a table of questions: ``exact`` words, ``groups`` of their forms, and all ``terms``; a null has none."""
    words = F.filter(T.asked_words(F.coalesce(question, F.lit(""))), lambda w: F.length(w) > 1)
    groups = F.transform(words, lambda w: F.array_sort(F.array_distinct(T.forms(w))))
    return F.struct(words.alias("exact"), groups.alias("groups"), F.array_sort(F.array_distinct(F.flatten(groups))).alias("terms"))


def atomically_planned(phrase: Column) -> Column:
    """QRY-2 for each row: every word must occur, each a group of its own."""
    words = T.asked_words(F.coalesce(phrase, F.lit("")))
    return F.struct(words.alias("exact"), F.transform(words, lambda w: F.array(w)).alias("groups"), words.alias("terms"))


def query_terms(spark: SparkSession, plans: Sequence[QueryPlan]) -> DataFrame:
    """A row for each query with the boost of each of its terms; as small as the questions."""
    rows = [(p.query_id, {t: EXACT_BOOST if t in p.exact else 1.0 for t in p.terms}) for p in plans]
    return spark.createDataFrame(rows, "query_id string, boosts map<string,double>")


@dataclass
class Index:
    """Documents with their fields' token arrays; ``fields`` maps names to weights."""

    docs: DataFrame
    id_col: str
    fields: Mapping[str, float] = field(default_factory=lambda: FIELD_WEIGHTS)

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """AGG-5: (id, field, term, tf) of the wanted terms; nothing else leaves the scan."""
        wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

        def of(name: str) -> Column:
            return F.transform(F.filter(F.col(name), lambda t: F.array_contains(wanted, t)), lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

        each = [of(f) for f in self.fields]
        return self.docs.select(self.id_col, F.explode(F.concat(*each)).alias("p")).groupBy(self.id_col, "p.field", "p.term").agg(F.count("*").alias("tf"))

    def statistics(self) -> DataFrame:
        """AGG-4: number of documents and mean length of each field, one row."""
        return self.docs.agg(F.count("*").alias("n"), *(F.avg(F.size(f)).alias(f"avg_{f}") for f in self.fields))


def scanned(index: Index, plans: Sequence[QueryPlan], searchable: Column | None = None, gated: bool = True) -> DataFrame:
    """``(id, lengths, hits, spaces, queries)``, one row a document.

    ``hits``: (field, term, tf) of wanted terms; ``spaces``: numbers of the exclusion sets that leave the document in;
    ``queries``: (query_id, space) of the plans that may return it.
    """
    excluded = list(dict.fromkeys(p.excluded for p in plans))
    asked = {t for p in plans for groups in (p.groups, p.excluded) for g in groups for t in g}
    among = lambda tokens, terms: F.filter(tokens, lambda t: F.array_contains(F.array(*map(F.lit, sorted(terms))).cast("array<string>"), t))
    terms = {t for p in plans for t in p.terms}
    titles = {t for p in plans for t in p.title_terms}
    # long arrays are gone through once; what follows sees only the few tokens that a plan asks for
    few = index.docs.select(
        index.id_col,
        F.struct(*(F.size(f).alias(f) for f in index.fields)).alias("lengths"),
        *(among(F.col(f), terms).alias(f"own_{k}") for k, f in enumerate(index.fields)),
        (among(searchable, asked) if searchable is not None and asked else F.array().cast("array<string>")).alias("marks"),
        (among(F.col("title"), titles) if titles else F.array().cast("array<string>")).alias("title_marks"),
    )

    def hits(k: int, name: str) -> Column:
        own = F.col(f"own_{k}")
        return F.transform(F.array_distinct(own), lambda t: F.struct(F.lit(name).alias("field"), t.alias("term"), F.size(F.filter(own, lambda x: x == t)).alias("tf")))

    kept = {e: excludes(F.col("marks"), e) if e and searchable is not None else F.lit(True) for e in excluded}
    spaces = F.array(*(F.when(kept[e], j) for j, e in enumerate(excluded)))

    def passes(p: QueryPlan) -> Column:
        title = any_term(F.col("title_marks"), p.title_terms) if p.title_terms else F.lit(True)
        return kept[p.excluded] & (anchored(F.col("marks"), p.groups) & title if gated and searchable is not None else F.lit(True))

    queries = F.array(*(F.when(passes(p), F.struct(F.lit(p.query_id).alias("query_id"), F.lit(excluded.index(p.excluded)).alias("space"))) for p in plans))
    return few.select(
        index.id_col,
        "lengths",
        F.concat(*(hits(k, f) for k, f in enumerate(index.fields))).alias("hits"),
        F.filter(spaces, lambda x: x.isNotNull()).alias("spaces"),
        F.filter(queries, lambda x: x.isNotNull()).alias("queries"),
    )


def _statistics(rows: DataFrame, index: Index, by: str) -> DataFrame:
    """``(by, n, mean lengths, df of each term)`` of rows with a ``by``, lengths and hits; counts are summed before the shuffle."""
    terms = F.concat(F.array(F.lit("")), F.array_distinct(F.col("hits.term")))
    each = rows.select(by, "lengths", F.explode(terms).alias("term")).groupBy(by, "term").agg(F.count("*").alias("n"), *(F.avg(f"lengths.{f}").alias(f) for f in index.fields))
    whole = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    means = F.struct(*(whole(f).alias(f) for f in index.fields))
    return each.groupBy(by).agg(whole("n").alias("n"), means.alias("means"), F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("df"))


def fielded_score(index: Index) -> Column:
    """AGG-6 of one row with hits, lengths, boosts and statistics."""

    def of(h: Column) -> Column:
        pick = lambda values: reduce(lambda out, f: F.when(h["field"] == f, values(f)).otherwise(out), index.fields, F.lit(None).cast("double"))
        length = pick(lambda f: F.col("lengths")[f].cast("double"))
        mean = F.greatest(pick(lambda f: F.col("means")[f]), F.lit(1.0))
        df = F.try_element_at("df", h["term"])
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        saturation = h["tf"] * (K1 + 1) / (h["tf"] + K1 * (1 - B + B * length / mean))
        return pick(lambda f: F.lit(float(index.fields[f]))) * idf * saturation * F.try_element_at("boosts", h["term"])

    own = F.filter("hits", lambda h: F.map_contains_key("boosts", h["term"]))
    return F.round(F.aggregate(own, F.lit(0.0), lambda total, h: total + of(h)), 6)


def _fts_score(index: Index) -> Column:
    """AGG-7 of one row: weights multiply the frequencies before a single saturation."""
    length = reduce(Column.__add__, (F.col("lengths")[f] for f in index.fields))
    mean = reduce(Column.__add__, (F.col("means")[f] for f in index.fields))
    weight = lambda h: reduce(lambda out, f: F.when(h["field"] == f, float(index.fields[f])).otherwise(out), index.fields, F.lit(0.0))

    def of(term: Column) -> Column:
        tf = F.aggregate(F.filter("hits", lambda h: h["term"] == term), F.lit(0.0), lambda total, h: total + weight(h) * h["tf"])
        df = F.try_element_at("df", term)
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(FTS_LEAST_IDF))
        return idf * tf * (FTS_K1 + 1) / (tf + FTS_K1 * (1 - FTS_B + FTS_B * length / mean))

    own = F.array_distinct(F.filter(F.col("hits.term"), lambda t: F.map_contains_key("boosts", t)))
    return F.when(F.size(own) > 0, F.round(F.aggregate(own, F.lit(0.0), lambda total, t: total + of(t)), 6))


def _scored(rows: DataFrame, index: Index, plans: Sequence[QueryPlan], score: Column) -> DataFrame:
    """Rows of documents and the queries that may return them, with the score; a broadcast row for each query and exclusion set."""
    stats = _statistics(rows.select("lengths", "hits", F.explode("spaces").alias("space")), index, "space")
    open_rows = rows.where(F.size("hits") > 0).select(index.id_col, "lengths", "hits", F.explode("queries").alias("q")).select(index.id_col, "lengths", "hits", "q.query_id", "q.space")
    return open_rows.join(F.broadcast(stats), "space").join(F.broadcast(query_terms(rows.sparkSession, plans)), "query_id").withColumn("score", score)


def fielded_bm25(index: Index, plans: Sequence[QueryPlan]) -> DataFrame:
    """AGG-6: ``(query_id, id, score)``; df spans a document's fields, N and mean lengths span ``index``."""
    return _scored(scanned(index, plans), index, plans, fielded_score(index)).where("score > 0").select("query_id", index.id_col, "score")


def fts_bm25(index: Index, plans: Sequence[QueryPlan]) -> DataFrame:
    """AGG-7: any term may match."""
    return _scored(scanned(index, plans), index, plans, _fts_score(index)).where("score IS NOT NULL").select("query_id", index.id_col, "score")


def ranked(scores: DataFrame, id_col: str, limit: int | None = None, score: str = "score") -> DataFrame:
    """WIN-1: positions by falling score, then id, for each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), id_col)
    out = scores.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= limit) if limit else out


def any_term(tokens: Column, terms: Sequence[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, terms)))


def excludes(tokens: Column, topics: Sequence[Sequence[str]]) -> Column:
    """FLT-10: false for a document that touches an excluded topic."""
    return ~reduce(Column.__or__, (any_term(tokens, t) for t in topics if t), F.lit(False))


def anchored(tokens: Column, groups: Sequence[Sequence[str]]) -> Column:
    """FLT-11: every group of alternatives occurs."""
    return reduce(Column.__and__, (any_term(tokens, g) for g in groups if g), F.lit(True))


def suppressed(text: Column, term: str, context: Sequence[str], distance: int) -> Column:
    """FLT-13: the term occurs, and each time within ``distance`` words of a word of ``context``."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]*"), 0)
    indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    own = F.filter(indexed, lambda x: x["w"] == term)
    near = F.filter(indexed, lambda x: x["w"].isin(*context))
    return (F.size(own) > 0) & F.forall(own, lambda x: F.exists(near, lambda y: F.abs(x["i"] - y["i"]) <= distance))


def lexical_search(index: Index, plans: Sequence[QueryPlan], searchable: Column, limit: int | None = None) -> DataFrame:
    """QRY-3/4: exclusion first, statistics over what is left, gates last; one job for all plans."""
    found = _scored(scanned(index, plans, searchable), index, plans, fielded_score(index)).where("score > 0")
    return ranked(found.select("query_id", index.id_col, "score"), index.id_col, limit)


def two_stage_search(index: Index, plans: Sequence[QueryPlan], searchable: Column, recall: int = RECALL_LIMIT, limit: int | None = None) -> DataFrame:
    """QRY-5: full-text recall, then the fielded score whose statistics come from the candidates alone.

    A candidate's small row goes along, so the second stage reads no document again.
    """
    gates = scanned(index, plans, searchable)
    # recall looks past gates and exclusions; ``open`` remembers them
    everything = F.array(*(F.struct(F.lit(p.query_id).alias("query_id"), F.lit(0).alias("space")) for p in plans))
    rows = gates.withColumnsRenamed({"queries": "open", "spaces": "left_in"}).withColumn("queries", everything).withColumn("spaces", F.array(F.lit(0)))
    stats = _statistics(rows.select("lengths", "hits", F.explode("spaces").alias("space")), index, "space")
    each = rows.where(F.size("hits") > 0).select(index.id_col, "lengths", "hits", "open", "left_in", F.explode("queries").alias("q")).select(index.id_col, "lengths", "hits", "open", "left_in", "q.query_id", "q.space")
    terms = F.broadcast(query_terms(index.docs.sparkSession, plans))
    recalled = each.join(F.broadcast(stats), "space").join(terms, "query_id").withColumn("score", _fts_score(index)).where("score IS NOT NULL")
    spaces = list(dict.fromkeys(p.excluded for p in plans))
    space_of = F.create_map(*(x for p in plans for x in (F.lit(p.query_id), F.lit(spaces.index(p.excluded)))))
    few = ranked(recalled, index.id_col, recall).where(F.array_contains("left_in", F.element_at(space_of, F.col("query_id")))).select("query_id", index.id_col, "lengths", "hits", "open", "boosts")
    # at most ``recall`` rows a query, which are together already
    own = Window.partitionBy("query_id")
    terms_seen = F.flatten(F.collect_list(F.array_distinct(F.col("hits.term"))).over(own))
    counted = few.select("*", F.count("*").over(own).alias("n"), F.struct(*(F.avg(f"lengths.{f}").over(own).alias(f) for f in index.fields)).alias("means"), terms_seen.alias("terms_seen"))
    df = F.map_from_entries(F.transform(F.array_distinct("terms_seen"), lambda t: F.struct(t, F.size(F.filter("terms_seen", lambda x: x == t)))))
    judged = counted.withColumn("df", df).withColumn("score", fielded_score(index))
    passed = judged.where((F.col("score") > 0) & F.exists("open", lambda q: q["query_id"] == F.col("query_id")))
    return ranked(passed.select("query_id", index.id_col, "score"), index.id_col, limit)


def phrase_rescue(docs: DataFrame, text: Column, groups: Sequence[Sequence[str]], cap: int = 250) -> DataFrame:
    """FLT-15: rows in which a phrase of every group occurs; more than ``cap`` of them are no help, and none is returned."""
    each = [reduce(Column.__or__, (T.phrase_present(text, p) for p in g)) for g in groups]
    found = docs.where(reduce(Column.__and__, each)).limit(cap + 1)
    total = found.agg(F.count("*").alias("__n"))
    return found.join(F.broadcast(total)).where(F.col("__n") <= cap).drop("__n")
