"""Queries of projections, classification, dedup, profiles and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import catalogue as C
from quillspark.operators import phrases as P
from quillspark.operators import review
from quillspark.sources import readers

from .tables import Registry, catalogue, table

R = Registry()

SQL_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce({x}, ''), '(?i)<br\\s*/?>|</p>', ' ', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '\\s+', ' ', 'g'))"


@R.add(f"SELECT page_id, {SQL_STRIP.format(x='html')} AS text FROM pages")
def str10_strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@R.add("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, t, substring(t, 1, 300) AS w FROM c),
k AS (SELECT *, CASE WHEN instr(reverse(w), ' .') > 0 THEN 300 - instr(reverse(w), ' .') - 1 ELSE -1 END AS a, CASE WHEN instr(reverse(w), '。') > 0 THEN 300 - instr(reverse(w), '。') ELSE -1 END AS b,
 CASE WHEN instr(reverse(w), ' ;') > 0 THEN 300 - instr(reverse(w), ' ;') - 1 ELSE -1 END AS c, CASE WHEN instr(reverse(w), ' !') > 0 THEN 300 - instr(reverse(w), ' !') - 1 ELSE -1 END AS d, CASE WHEN instr(reverse(w), ' ?') > 0 THEN 300 - instr(reverse(w), ' ?') - 1 ELSE -1 END AS e FROM w)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t WHEN a > 180 THEN trim(w[1:a + 1]) WHEN b > 180 THEN trim(w[1:b + 1]) WHEN c > 180 THEN trim(w[1:c + 1]) WHEN d > 180 THEN trim(w[1:d + 1]) WHEN e > 180 THEN trim(w[1:e + 1]) ELSE rtrim(w) || '…' END AS excerpt FROM k""")
def str11_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 300).alias("excerpt"))


@R.add("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS digest FROM documents")
def str1_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("norm"), T.query_digest(F.col("text")).alias("digest"))


@R.add("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def str13_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@R.add("SELECT p_partkey, CASE WHEN length(p_name) > 25 THEN p_name ELSE concat_ws(', ', p_name, p_type, p_brand) END AS alt FROM part")
def str14_alt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.alt_text(F.col("p_name"), F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("alt"))


@R.add("""SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_extract_all(lower(p_name || ' of ' || p_type), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'the', 'of', 'in', 'on', 'from')),
 lambda w: CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[1:-4] || 'y' WHEN w LIKE '%s' AND length(w) > 3 AND w NOT LIKE '%ss' THEN w[1:-2] ELSE w END), ' ') AS family FROM part""")
def str15_title_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.title_family(F.concat_ws(" of ", "p_name", "p_type")).alias("family"))


@R.add("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])that the([^a-z0-9]|$)')")
def str6_phrase_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.phrase_present(F.col("text"), "that the")).select("doc_id")


@R.add("""SELECT p_partkey, p_name[1:greatest(length(p_name) // 2, 1) - 1] || p_name[greatest(length(p_name) // 2, 1) + 1] || p_name[greatest(length(p_name) // 2, 1)] || p_name[greatest(length(p_name) // 2, 1) + 2:] AS typo FROM part""")
def str19_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.transposed(F.col("p_name")).alias("typo"))


@R.add("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'small|medium') THEN 'sized' WHEN regexp_matches(lower(p_type), 'promo|eco') THEN 'cheap' ELSE 'other' END AS bucket FROM part")
def cls6_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.first_match(F.lower("p_type"), {"sized": "small|medium", "cheap": "promo|eco"}, "other").alias("bucket"))


@R.add("""WITH g AS (SELECT n_nationkey, lower(n_name) AS n, CASE WHEN length(n_name) >= 2 THEN list_distinct(list_transform(range(1, length(n_name)), lambda i: lower(n_name)[i:i+1])) ELSE [] END AS g FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)), 6) AS jaccard FROM g a, g b WHERE a.n_nationkey < b.n_nationkey""")
def str8_gram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.lower("n_name").alias("n"))
    a, b = n.select(F.col("k").alias("a"), F.col("n").alias("x")), n.select(F.col("k").alias("b"), F.col("n").alias("y"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(T.gram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@R.add("""WITH y AS (SELECT o_orderkey, list_transform(list_filter(regexp_split_to_array(t, '[^A-Za-z0-9_]+'), lambda p: regexp_full_match(p, '[0-9]{3,4}')), lambda p: CAST(p AS INTEGER)) AS y0, t FROM (
  SELECT o_orderkey, 'c. ' || year(o_orderdate) || '-' || (o_orderkey % 3000) || CASE WHEN o_orderkey % 7 = 0 THEN ' B.C.' ELSE '' END AS t FROM orders)),
z AS (SELECT o_orderkey, list_filter(y0, lambda v: v <= 2100) AS y, regexp_matches(t, '(?i)(^|[^a-z0-9_])b\\.?c\\.?(e?)([^a-z0-9_]|$)') AS bc FROM y)
SELECT o_orderkey, CASE WHEN bc THEN -list_max(y) ELSE list_min(y) END AS earliest, CASE WHEN bc THEN -list_min(y) ELSE list_max(y) END AS latest FROM z""")
def dat1_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = F.concat(F.lit("c. "), F.year("o_orderdate"), F.lit("-"), F.col("o_orderkey") % 3000, F.when(F.col("o_orderkey") % 7 == 0, " B.C.").otherwise(""))
    return o.select("o_orderkey", V.year_range(t).alias("y")).select("o_orderkey", "y.*")


@R.add("""WITH o AS (SELECT p_partkey, p_size * 40 - 1200 AS a, p_size * 40 - 1050 AS b FROM part), c AS (SELECT range AS century FROM range(-1000, 1901, 100))
SELECT p_partkey, CAST(century AS INTEGER) AS century FROM o JOIN c ON a <= century + 99 AND b >= century""")
def dat3_centuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 - 1200).alias("date_earliest"), (F.col("p_size") * 40 - 1050).alias("date_latest"))
    return C.centuries(o).select("p_partkey", "century")


RULES = (C.Rule("trade", ("the", "with"), ("thea",), ("anin",)), C.Rule("nature", ("and",), ("anin", "onst"), ("heed", "thea")), C.Rule("power", (), ("moron", "clown"), ()))
SQL_HIT = "CAST(regexp_matches(lower({c}), '(^|[^a-z0-9]){p}([^a-z0-9]|$)') AS INTEGER)"


def _sql_rules() -> str:
    rows = []
    for r in RULES:
        parts = [f"{w} * {SQL_HIT.format(c='title_text', p=p)}" for ps, w in ((r.patterns, 1.0), (r.strong, 3.0)) for p in ps]
        prose = " + ".join(SQL_HIT.format(c="text", p=p) for p in r.prose)
        rows.append(f"SELECT doc_id, '{r.label}' AS label, CAST({' + '.join(parts)}{f' + least(0.5 * ({prose}), 2.0)' if prose else ''} AS DOUBLE) AS score FROM obj")
    return "obj AS (SELECT doc_id, string_split(text, chr(10))[1] AS title_text, source, text FROM documents), lab AS (SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE score > 0)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled(catalogue(spark, sf_dir), "doc_id", RULES, F.col("title_text"), F.col("text"))


@R.add(f"WITH {_sql_rules()} SELECT * FROM lab")
def cls3_pattern_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@R.add("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, w[p] || ' ' || w[p + 1] AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w))) AS p FROM w)),
u AS (SELECT doc_id, '#' || regexp_replace(lower(text), '[^a-z0-9 ]', '#', 'g') || '#' AS u FROM documents)
SELECT doc_id, item_id, count(*) AS hits FROM u JOIN b ON contains(u, ' ' || phrase || ' ') OR contains(u, '#' || phrase || ' ') OR contains(u, ' ' || phrase || '#') OR contains(u, '#' || phrase || '#')
GROUP BY doc_id, item_id""")
def cls4_many_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLS-4: how many word pairs of each benchmark item occur in each document, all of them in one pass."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.col("w")[i + 1]))
    phrases = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).select("item_id", F.explode(F.array_distinct(pairs)).alias("phrase"))
    hits = P.matches(table(spark, sf_dir, "documents"), "doc_id", "text", phrases)
    return hits.join(phrases, "phrase").groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"))


@R.add(f"""WITH {_sql_rules()}, reg AS (SELECT * FROM (VALUES (0, 'trade'), (1, 'nature'), (2, 'power'), (3, 'none')) v(place, label))
SELECT place, label, count(doc_id) AS n, count(doc_id) >= 200 AS enough FROM reg LEFT JOIN lab USING (label) GROUP BY place, label""")
def agg3_registry_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(i, x) for i, x in enumerate([*(r.label for r in RULES), "none"])], "place int, label string")
    return C.registry_manifest(rules, _labels(spark, sf_dir), 200)


@R.add(f"""WITH {_sql_rules()}, o AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'full' ELSE 'thin' END AS depth, source AS pack FROM documents)
SELECT label, count(*) AS objects, count(*) FILTER (depth = 'full') AS "full", count(DISTINCT pack) AS packs, CASE WHEN count(*) FILTER (depth = 'full') >= 5 AND count(DISTINCT pack) >= 3 THEN 'supported' ELSE 'partial' END AS status
FROM lab JOIN o USING (doc_id) GROUP BY label HAVING count(*) >= 40""")
def sec17_question_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, "full").otherwise("thin").alias("depth"), F.col("source").alias("pack"))
    return C.question_cards(_labels(spark, sf_dir), o, "doc_id")


@R.add("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END), ''), trim(c_mktsegment)) AS title, trim(c_mktsegment) AS kind FROM customer WHERE c_custkey % 5 <> 0""")
def prj1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Key"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("x").alias("url"))
    out = C.normalised(c, {"c_custkey": ("id", "key"), "title": ("title", "name", "label"), "kind": ("kind", "label"), "url": ("url",)}, ("title", "url"))
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "title", "kind")


@R.add("""SELECT p_partkey, concat_ws(',', CASE WHEN p_name IS NOT NULL THEN p_partkey || '#name' END, CASE WHEN p_size > 20 THEN p_partkey || '#size' END, p_partkey || '#type') AS ids,
CASE WHEN p_size > 20 THEN 'full' ELSE 'thin' END AS depth FROM part""")
def prj2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ev = C.evidence_of({"name": F.col("p_name"), "size": F.when(F.col("p_size") > 20, F.col("p_size")), "type": F.col("p_type")}, F.col("p_partkey"))
    return p.withColumn("ev", ev).select("p_partkey", F.array_join(F.transform("ev", lambda x: x["evidence_id"]), ",").alias("ids"), C.evidence_depth(F.col("ev"), F.lit(True)).alias("depth"))


@R.add("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'CC0' WHEN s_nationkey IN (1, 2, 3) THEN 'open' END AS image, CASE WHEN s_nationkey IN (1, 2, 3) THEN 'open' END AS metadata, CASE WHEN s_nationkey IN (1, 2, 3) THEN 'open' END AS prose FROM supplier""")
def prj4_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    r = C.rights(F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 4 == 0, "CC0"), F.lit(None).cast("string"), F.lit("open"), ("1", "2", "3"))
    return s.select("s_suppkey", r.alias("r")).select("s_suppkey", "r.*")


@R.add("""SELECT p_partkey, concat_ws(chr(10), 'title: ' || p_name, CASE WHEN p_size > 25 THEN 'size: ' || p_size END, 'type: ' || p_type) AS text, substring(concat_ws(' | ', p_type, p_name, p_brand), 1, 30) AS judged FROM part""")
def prj8_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = C.search_text(title=F.col("p_name"), size=F.when(F.col("p_size") > 25, F.col("p_size")), type=F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), C.judge_text([F.col("p_type")], [F.col("p_name"), F.col("p_brand")], 30).alias("judged"))


@R.add("""SELECT n_nationkey, CASE WHEN n_name LIKE '%A' THEN 'west,north' WHEN n_name LIKE 'I%' THEN 'south,east' ELSE 'east,north' END AS packs FROM nation""")
def prj13_corrected_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = C.corrected_packs(F.array(F.lit("east"), F.lit("north")), F.col("n_name"), (("^I", "north", "south"),))
    fixed = F.when(F.col("n_name").rlike("A$"), F.array(F.lit("west"), F.lit("north"))).when(F.col("n_name").rlike("^I"), F.reverse(packs)).otherwise(packs)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(fixed, ",").alias("packs"))


@R.add("""SELECT l_partkey, l_suppkey, arg_max(l_orderkey, l_quantity * 100000000 - l_orderkey - l_linenumber / 10.0) AS l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_partkey, l_suppkey""")
def set1_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return C.richest(rows, ["l_partkey", "l_suppkey"], F.col("l_quantity"), "seq").drop("seq")


@R.add("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def set2_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@R.add("""WITH k AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents)
SELECT min(doc_id) AS doc_id, source FROM k GROUP BY source, CASE WHEN length(n) >= 120 THEN sha256(n) ELSE 'id:' || doc_id END""")
def set3_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("doc_id").alias("rank"))
    return C.folded(d, "source", "text", "rank", "doc_id").select("doc_id", "source")


@R.add("""SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE event_type = 'signup'""")
def set4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'purchase'").select("user_id").union(e.where("event_type = 'signup'").select("user_id")).distinct()


@R.add("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_acctbal > 0""")
def set5_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(o, "c_custkey", "left_semi").select("c_custkey")


@R.add("""SELECT user_id, event_type, string_agg(DISTINCT CAST(hour(ts) % 3 AS VARCHAR), ',' ORDER BY CAST(hour(ts) % 3 AS VARCHAR)) AS origins FROM events GROUP BY user_id, event_type""")
def set6_provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("o", (F.hour("ts") % 3).cast("string"))
    return e.groupBy("user_id", "event_type").agg(F.array_join(F.sort_array(F.collect_set("o")), ",").alias("origins"))


@R.add("""SELECT o_orderkey, o_custkey, 'new' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0""")
def set9_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return C.merged(o.where("o_orderkey % 2 = 0").withColumn("origin", F.lit("old")), o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("new")), ["o_orderkey"])


@R.add("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def agg1_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counted(table(spark, sf_dir, "part"), ["p_brand"])


@R.add("SELECT source, round(avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END), 4) AS english FROM documents GROUP BY source")
def agg2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg((F.col("lang") == "en").cast("double")), 4).alias("english"))


@R.add("""SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'size', CAST(CAST(floor(log10(n_chars + 1)) AS INTEGER) AS VARCHAR), count(*) FROM documents GROUP BY ALL""")
def agg26_collection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("size", F.floor(F.log10(F.col("n_chars") + 1)).cast("int"))
    return review.one_dimensional(d, ["lang", "source", "size"])


@R.add("""SELECT unnest(['text', 'lang', 'source']) AS "column", unnest([count(*) FILTER (coalesce(trim(text), '') = ''), count(*) FILTER (coalesce(trim(lang), '') = ''), count(*) FILTER (coalesce(trim(source), '') = '')]) AS missing FROM documents""")
def agg26_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.null_counts(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@R.add("SELECT coalesce(nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END), ''), 'not_recorded') AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def agg27_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")))
    return review.with_default(c, "c_mktsegment")


@R.add("""WITH k AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS p FROM k QUALIFY p <= 8)
SELECT p_brand, (SELECT count(*) FROM part x WHERE x.p_brand = b.p_brand) AS n, (SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM part x WHERE x.p_brand = b.p_brand ORDER BY p_partkey LIMIT 3)) AS samples,
(SELECT string_agg(p_type, ',' ORDER BY p) FROM t WHERE t.p_brand = b.p_brand) AS kinds FROM (SELECT DISTINCT p_brand FROM part) b""")
def agg28_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.landing(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type")


@R.add("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 10 ORDER BY n DESC, source")
def agg29_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counted(table(spark, sf_dir, "documents"), ["source"]).where("n >= 10").orderBy(F.desc("n"), "source")


@R.add("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def agg36_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@R.add("""SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())""")
def agg37_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupingSets([[F.col("p_brand")], [F.col("p_size")], []], "p_brand", "p_size").agg(F.count("*").alias("n"))


@R.add("""WITH w AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS w FROM orders)
SELECT o_orderkey, CAST(w AS BIGINT) AS "window", (SELECT max(o_orderkey) FROM w x WHERE x.w = y.w - 1) AS "cursor" FROM w y""".replace("(SELECT max(o_orderkey) FROM w x WHERE x.w = y.w - 1)", "e.m").replace("FROM w y", "FROM w y LEFT JOIN (SELECT w + 1 AS w1, max(o_orderkey) AS m FROM w GROUP BY w) e ON e.w1 = y.w"))
def src6_keyset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.keyset_windows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1000)


@R.add("SELECT doc_id, sha256(text) AS digest FROM documents")
def hsh1_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def jsn1_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@R.add("""SELECT o_orderkey AS object_id, 'missing' AS problem FROM orders WHERE o_orderkey % 10 = 0 AND o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'unexpected' FROM orders WHERE o_orderkey % 10 = 1 AND o_orderstatus = 'F'""")
def flt20_gold_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), "o_orderstatus").where("object_id % 10 < 2")
    return C.expected_versus_actual(o.where("object_id % 10 = 0"), o.where("(object_id % 10 = 0 AND o_orderstatus = 'F') OR (object_id % 10 = 1 AND o_orderstatus = 'F')"), ["object_id"])
