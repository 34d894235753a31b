"""Queries of the search layer: lexical, dense, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import dense, fusion, search

from .tables import FIELDS_SQL, Registry, catalogue, fields, table

R = Registry()
TERMS = ("thea", "anin", "tionha")
PLAN = search.QueryPlan("q1", TERMS, exact=("thea",), groups=(("thea", "anin"), ("tionha", "anin")), excluded=(("idiot", "moron"),))
SECOND = search.QueryPlan("q2", ("heed", "onst"), exact=("heed",), groups=(("heed",), ("onst",)))


def _sql_terms(*plans: search.QueryPlan) -> str:
    return "term AS (SELECT * FROM (VALUES " + ", ".join(f"('{p.query_id}', '{t}', {1.2 if t in p.exact else 1.0})" for p in plans for t in p.terms) + ") v(query_id, t, boost))"


SQL_TOK = """
tok AS (
  SELECT doc_id, 'title' AS f, 5.0 AS w, unnest(title) AS t FROM {src} UNION ALL SELECT doc_id, 'routing', 3.0, unnest(routing) FROM {src}
  UNION ALL SELECT doc_id, 'metadata', 2.0, unnest(metadata) FROM {src} UNION ALL SELECT doc_id, 'content', 1.0, unnest(content) FROM {src}),
post AS (SELECT doc_id, f, w, t, count(*) AS tf FROM tok WHERE t IN (SELECT t FROM term) GROUP BY ALL),
df AS (SELECT t, count(DISTINCT doc_id) AS df FROM post GROUP BY t),
len AS (
  SELECT doc_id, unnest(['title', 'routing', 'metadata', 'content']) AS f,
         unnest([len(title), len(routing), len(metadata), len(content)]) AS l FROM {src}),
mean AS (SELECT f, avg(l) AS a FROM len GROUP BY f),
n AS (SELECT count(*) AS n FROM {src})
"""
SQL_BM25 = SQL_TOK + """,
bm25 AS (
  SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * l / greatest(a, 1.0))) * boost), 6) AS score
  FROM post JOIN df USING (t) JOIN len USING (doc_id, f) JOIN mean USING (f) JOIN n ON true JOIN term USING (t)
  GROUP BY query_id, doc_id HAVING score > 0)
"""
SQL_FTS = SQL_TOK + """,
wtf AS (SELECT doc_id, t, sum(w * tf) AS tf FROM post GROUP BY doc_id, t),
wdf AS (SELECT t, count(*) AS df FROM wtf GROUP BY t),
total AS (SELECT doc_id, sum(l) AS l FROM len GROUP BY doc_id),
mean_total AS (SELECT avg(l) AS a FROM total),
fts AS (
  SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score
  FROM wtf JOIN wdf USING (t) JOIN total USING (doc_id) JOIN mean_total ON true JOIN n ON true JOIN term USING (t) GROUP BY query_id, doc_id)
"""


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    return search.Index(fields(catalogue(spark, sf_dir)), "doc_id")


@R.add(f"WITH {FIELDS_SQL}, {_sql_terms(PLAN)}, {SQL_BM25.format(src='fld')} SELECT query_id, doc_id, score FROM bm25")
def agg6_fielded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fielded_bm25(_index(spark, sf_dir), [PLAN])


@R.add(f"WITH {FIELDS_SQL}, {_sql_terms(PLAN)}, {SQL_FTS.format(src='fld')} SELECT query_id, doc_id, score FROM fts")
def agg7_fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fts_bm25(_index(spark, sf_dir), [PLAN])


@R.add(f"WITH {FIELDS_SQL}, {_sql_terms(PLAN)}, {SQL_TOK.format(src='fld')} SELECT doc_id, f AS field, t AS term, tf FROM post")
def agg5_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings(TERMS)


@R.add(f"WITH {FIELDS_SQL} SELECT count(*) AS n, avg(len(title)) AS avg_title, avg(len(routing)) AS avg_routing, avg(len(metadata)) AS avg_metadata, avg(len(content)) AS avg_content FROM fld")
def agg4_field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).statistics()


def _searchable() -> F.Column:
    return F.concat("title", "routing", "metadata", "content")


SQL_KEPT = "kept AS (SELECT * FROM fld WHERE NOT list_has_any(content, ['idiot', 'moron']) AND NOT list_has_any(title, ['idiot', 'moron']))"
SQL_GATE = "list_has_any(content, ['thea', 'anin']) AND list_has_any(content, ['tionha', 'anin'])"


@R.add(f"""WITH {FIELDS_SQL}, {SQL_KEPT}, {_sql_terms(PLAN)}, {SQL_BM25.format(src='kept')}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM bm25 JOIN kept USING (doc_id) WHERE {SQL_GATE}""")
def qry3_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_search(_index(spark, sf_dir), [PLAN], _searchable())


@R.add(f"""WITH {FIELDS_SQL}, {_sql_terms(SECOND, search.QueryPlan('q3', ('lyed', 'onst'), ('lyed',)))}, {SQL_BM25.format(src='fld')}
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM bm25 JOIN fld USING (doc_id) WHERE (query_id = 'q3' AND true) OR (query_id = 'q2' AND list_contains(content, 'heed') AND list_contains(content, 'onst'))
QUALIFY rank <= 50""")
def qry4_many_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_search(_index(spark, sf_dir), [SECOND, search.QueryPlan("q3", ("lyed", "onst"), ("lyed",))], _searchable(), limit=50)


@R.add(f"""WITH {FIELDS_SQL}, {_sql_terms(PLAN)}, {SQL_FTS.format(src='fld').replace('n AS (', 'n0 AS (', 0)},
cand AS (SELECT doc_id FROM fts QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 40),
few AS (SELECT * FROM fld WHERE doc_id IN (FROM cand)),
tok2 AS (
  SELECT doc_id, 'title' AS f, 5.0 AS w, unnest(title) AS t FROM few UNION ALL SELECT doc_id, 'routing', 3.0, unnest(routing) FROM few
  UNION ALL SELECT doc_id, 'metadata', 2.0, unnest(metadata) FROM few UNION ALL SELECT doc_id, 'content', 1.0, unnest(content) FROM few),
post2 AS (SELECT doc_id, f, w, t, count(*) AS tf FROM tok2 WHERE t IN (SELECT t FROM term) GROUP BY ALL),
df2 AS (SELECT t, count(DISTINCT doc_id) AS df FROM post2 GROUP BY t),
len2 AS (SELECT len.* FROM len JOIN few USING (doc_id)),
mean2 AS (SELECT f, avg(l) AS a FROM len2 GROUP BY f),
n2 AS (SELECT count(*) AS n FROM few),
b2 AS (
  SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.35 / (tf + 1.35 * (0.28 + 0.72 * l / greatest(a, 1.0))) * boost), 6) AS score
  FROM post2 JOIN df2 USING (t) JOIN len2 USING (doc_id, f) JOIN mean2 USING (f) JOIN n2 ON true JOIN term USING (t) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b2 JOIN few USING (doc_id) WHERE {SQL_GATE}""")
def qry5_two_stage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.two_stage_search(_index(spark, sf_dir), [search.QueryPlan("q1", TERMS, ("thea",), PLAN.groups)], _searchable(), recall=40)


@R.add(f"WITH {FIELDS_SQL} SELECT doc_id FROM fld WHERE NOT list_has_any(content, ['idiot', 'moron']) AND NOT list_has_any(content, ['clown'])")
def flt10_exclude_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(catalogue(spark, sf_dir)).where(search.excludes(F.col("content"), (("idiot", "moron"), ("clown",)))).select("doc_id")


@R.add(f"WITH {FIELDS_SQL} SELECT doc_id FROM fld WHERE {SQL_GATE}")
def flt11_anchor_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(catalogue(spark, sf_dir)).where(search.anchored(F.col("content"), PLAN.groups)).select("doc_id")


@R.add(f"WITH {FIELDS_SQL} SELECT doc_id FROM fld WHERE list_has_any(title, ['the', 'that']) AND NOT list_contains(title, 'and')")
def flt12_title_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(catalogue(spark, sf_dir)).where(search.any_term(F.array_except("title", F.array(F.lit("and"))), ("the", "that")) & ~F.array_contains("title", "and")).select("doc_id")


@R.add("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z''-]*') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
own AS (SELECT doc_id, i FROM p WHERE w = 'heed'), near AS (SELECT doc_id, i FROM p WHERE w IN ('the', 'of'))
SELECT doc_id FROM own GROUP BY doc_id
HAVING bool_and(EXISTS (SELECT 1 FROM near WHERE near.doc_id = own.doc_id AND abs(near.i - own.i) <= 4))""".replace("bool_and(EXISTS (SELECT 1 FROM near WHERE near.doc_id = own.doc_id AND abs(near.i - own.i) <= 4))", "count(DISTINCT i) = (SELECT count(DISTINCT o.i) FROM own o JOIN near ON near.doc_id = o.doc_id AND abs(near.i - o.i) <= 4 WHERE o.doc_id = own.doc_id)"))
def flt13_contextual_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(search.suppressed(F.col("text"), "heed", ("the", "of"), 4)).select("doc_id")


@R.add("""WITH f AS (SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])of the([^a-z0-9]|$)') AND regexp_matches(lower(text), '(^|[^a-z0-9])(thea|anin)([^a-z0-9]|$)'))
SELECT doc_id FROM f WHERE (SELECT count(*) FROM f) <= 2000""")
def flt15_phrase_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase_rescue(table(spark, sf_dir, "documents"), F.col("text"), (("of the",), ("thea", "anin")), cap=2000).select("doc_id")


def _queries(spark: SparkSession, sf_dir: str, which: F.Column) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(which).select(F.concat(F.lit("v"), "vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


SQL_SCORED = """
q AS (SELECT 'v' || vec_id AS query_id, embedding AS qv FROM embeddings WHERE {which}),
scored AS (
  SELECT query_id, vec_id, label, round(list_sum(list_transform(list_zip(embedding, qv), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 6) AS score
  FROM embeddings, q)
"""


SQL_DOT = SQL_SCORED.format(which="vec_id IN (0, 7)")
SQL_SEARCHES = SQL_SCORED.format(which="vec_id % 50 = 0")


@R.add(f"WITH {SQL_SEARCHES} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 20")
def top1_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir, F.col("vec_id") % 50 == 0), 20, "vec_id")


@R.add(f"WITH {SQL_SEARCHES} SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS place FROM scored QUALIFY place <= 5")
def top3_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.top_per_group(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir, F.col("vec_id") % 50 == 0), 5, "label", "vec_id")


@R.add("""SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u FROM embeddings)""")
def mth1_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(V.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


def _channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Ranked lists for one query over the vectors: by similarity to vector 0 and 7, by label, by hash."""
    hits = dense.top_k(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir, F.col("vec_id").isin(0, 7)), 60, "vec_id").withColumnRenamed("vec_id", "object_id")
    one = F.lit("q").alias("query_id")
    pick = lambda name: hits.where(F.col("query_id") == name).select(one, "object_id", "score", "rank")
    return {"dense": pick("v0"), "evidence": pick("v7")}


SQL_CHANNELS = f"""{SQL_DOT},
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 60),
den AS (SELECT vec_id AS object_id, score, rank FROM hits WHERE query_id = 'v0'), evi AS (SELECT vec_id AS object_id, score, rank FROM hits WHERE query_id = 'v7'),
lex AS (SELECT doc_id AS object_id, CAST(n_chars AS DOUBLE) AS score, row_number() OVER (ORDER BY CAST(n_chars AS DOUBLE) DESC, doc_id) AS rank FROM documents QUALIFY rank <= 80)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("object_id"), F.col("n_chars").cast("double").alias("score"))
    return search.ranked(d, "object_id", 80)


@R.add(f"""WITH {SQL_CHANNELS}, r AS (SELECT object_id, 1.0 / (60 + rank) AS p, 'dense' AS c FROM den UNION ALL SELECT object_id, 1.15 / (60 + rank), 'evidence' FROM evi UNION ALL SELECT object_id, 1.0 / (60 + rank), 'lexical' FROM lex)
SELECT 'q' AS query_id, object_id, round(sum(p), 8) AS score, array_to_string(list_sort(list_distinct(list(c))), ',') AS channels FROM r GROUP BY object_id""")
def agg9_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _channels(spark, sf_dir)
    out = fusion.reciprocal_rank({"dense": (ch["dense"], 1.0), "evidence": (ch["evidence"], 1.15), "lexical": (_lexical(spark, sf_dir), 1.0)}, "object_id")
    return out.withColumn("channels", F.array_join("channels", ","))


@R.add(f"WITH {SQL_CHANNELS} SELECT object_id, round(score / max(score) OVER (), 6) AS share FROM lex")
def agg10_share_of_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.share_of_best(_lexical(spark, sf_dir)).select("object_id", F.round("share", 6).alias("share"))


@R.add(f"""WITH {SQL_CHANNELS}, den2 AS (SELECT * FROM den WHERE score >= 0.28), evi2 AS (SELECT * FROM evi WHERE score >= 0.30),
con AS (SELECT object_id, round(sum(p), 8) AS score FROM (SELECT object_id, 1.0 / (60 + rank) AS p FROM den2 UNION ALL SELECT object_id, 1.15 / (60 + rank) FROM evi2) GROUP BY object_id),
agr AS (SELECT object_id, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM con),
txt AS (SELECT object_id, score, rank FROM lex WHERE object_id % 3 = 0),
fus AS (SELECT object_id, round(sum(p), 8) AS f, array_to_string(list_sort(list(c)), ',') AS channels FROM (
  SELECT object_id, 1.0 / (60 + rank) AS p, 'lexical' AS c FROM lex UNION ALL SELECT object_id, 1.0 / (60 + rank), 'dense' FROM agr UNION ALL SELECT object_id, 1.15 / (60 + rank), 'text' FROM txt) GROUP BY object_id),
j AS (
  SELECT f.object_id, f.f / max(f.f) OVER () AS fused, channels, coalesce(least(1.0, greatest(0.0, (e.score - 0.30) / 0.70)), 0.0) AS ev,
         greatest(coalesce(l.score / (SELECT max(score) FROM lex), 0.0), coalesce(t.score / (SELECT max(score) FROM txt), 0.0), coalesce(least(1.0, greatest(0.0, (d.score - 0.28) / 0.72)), 0.0)) AS best
  FROM fus f LEFT JOIN lex l USING (object_id) LEFT JOIN txt t USING (object_id) LEFT JOIN den2 d USING (object_id) LEFT JOIN evi2 e USING (object_id))
SELECT 'q' AS query_id, object_id, round(100 * (0.55 * fused + 0.25 * ev + 0.20 * best), 6) AS score, channels,
       row_number() OVER (ORDER BY round(100 * (0.55 * fused + 0.25 * ev + 0.20 * best), 6) DESC, object_id) AS rank FROM j QUALIFY rank <= 250""")
def qry6_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch, lex = _channels(spark, sf_dir), _lexical(spark, sf_dir)
    out = fusion.hybrid(lex, ch["dense"], ch["evidence"], lex.where("object_id % 3 = 0"))
    return out.withColumn("channels", F.array_join("channels", ","))


@R.add(f"""WITH {SQL_CHANNELS}, rel AS (SELECT doc_id AS object_id, (doc_id * 37 % 101) / 100.0 AS relevance FROM documents WHERE doc_id % 4 = 0),
j AS (SELECT object_id, score, rank, CASE WHEN rank <= 60 AND relevance IS NOT NULL THEN round(100 * (0.85 * relevance + 0.15 * score / max(score) OVER ()), 6) END AS b FROM lex LEFT JOIN rel USING (object_id)),
k AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY b DESC NULLS LAST, rank) <= 10 THEN b END AS blended FROM j)
SELECT 'q' AS query_id, object_id, coalesce(blended, score) AS score, rank AS old_rank, row_number() OVER (ORDER BY blended DESC NULLS LAST, rank) AS rank FROM k""")
def qry9_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("object_id"), ((F.col("doc_id") * 37 % 101) / 100.0).alias("relevance"))
    return fusion.reranked(_lexical(spark, sf_dir), rel, "object_id", top=10)


@R.add(f"""WITH {SQL_CHANNELS}, r AS (SELECT object_id, rank, 'a' AS axis FROM den UNION ALL SELECT object_id, rank, 'b' FROM evi UNION ALL SELECT object_id, rank, 'c' FROM lex),
s AS (SELECT object_id, sum(1.0 / (60 + rank)) AS p, min(rank) AS best_rank, array_to_string(list_sort(list_distinct(list(axis))), ',') AS axes FROM r GROUP BY object_id),
z AS (SELECT object_id, best_rank, axes, round(100 * p / max(p) OVER (), 6) AS score FROM s)
SELECT 'q' AS query_id, *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM z QUALIFY rank <= 250""")
def qry10_fused_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = _channels(spark, sf_dir)
    rows = ch["dense"].withColumn("axis", F.lit("a")).unionByName(ch["evidence"].withColumn("axis", F.lit("b"))).unionByName(_lexical(spark, sf_dir).withColumn("axis", F.lit("c")))
    return fusion.fused_queries(rows, "object_id").withColumn("axes", F.array_join("axes", ","))


@R.add(f"""WITH {SQL_CHANNELS}, r AS (SELECT object_id, rank, 0 AS c FROM den UNION ALL SELECT object_id, rank, 1 FROM lex),
f AS (SELECT object_id, min(rank * 10 + c) AS p FROM r GROUP BY object_id)
SELECT 'q' AS query_id, object_id, row_number() OVER (ORDER BY p, object_id) AS place FROM f""")
def win8_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.interleaved({"semantic": _channels(spark, sf_dir)["dense"], "exact": _lexical(spark, sf_dir)}, "object_id")


@R.add("""WITH s AS (SELECT source, sum(greatest(CAST(n_chars AS DOUBLE) / 1000, 1.0)) AS total FROM documents GROUP BY source)
SELECT 'q' AS query_id, source, round(total, 6) AS total FROM s ORDER BY total DESC, source LIMIT 1""")
def agg12_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("q").alias("query_id"), "source", (F.col("n_chars").cast("double") / 1000).alias("score"))
    return fusion.dominant(d, "source").withColumn("total", F.round("total", 6))


SQL_EVIDENCE = """
ev AS (SELECT doc_id AS object_id, doc_id || ':' || p AS evidence_id, line AS text, p FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents) WHERE trim(line) <> '')
"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).where(F.trim("text") != "")
    return d.select("object_id", F.concat_ws(":", "object_id", "p").alias("evidence_id"), "text", "p")


@R.add(f"""WITH {SQL_EVIDENCE}, h AS (SELECT *, len(regexp_extract_all(lower(text), 'the')) AS score FROM ev), s AS (SELECT *, row_number() OVER (ORDER BY score DESC, evidence_id) AS rank FROM h WHERE score > 0)
SELECT 'q' AS query_id, object_id, max(score) AS score, min(rank) AS first_rank, string_agg(evidence_id, ',' ORDER BY rank) AS evidence_ids FROM s GROUP BY object_id""")
def agg8_evidence_per_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(spark, sf_dir).select(F.lit("q").alias("query_id"), "object_id", "evidence_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("the"), F.lit(0))).cast("long").alias("score")).where("score > 0")
    out = fusion.evidence_per_object(search.ranked(e, "evidence_id"))
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@R.add("""SELECT user_id, string_agg(event_type, ',' ORDER BY m) AS types FROM (SELECT user_id, event_type, min(event_id) AS m FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def agg11_joined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type").alias("types"))
    return fusion.joined_ids(e, ["user_id"], ["event_id"], "types").withColumn("types", F.array_join("types", ","))


@R.add("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w[1:20], ' ') AS head FROM w""")
def str3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.array_join(F.slice(w, 1, 20), " ").alias("head"))
