"""Queries of questions, audits, set repair, review details and the smaller record functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import answers as A
from quillspark.operators import catalogue as C
from quillspark.operators import dense, evidence, filters, fusion, ranking, retrieval, review, search
from quillspark.sources import readers
from quillspark.streaming import streams

from .search_queries import PLAN, SECOND, SQL_BM25, SQL_FTS, SQL_SCORED, _index, _searchable, _sql_terms
from .tables import FIELDS_SQL, Registry, catalogue, fields, table

R = Registry()

NORM = "lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


# --- strings -----------------------------------------------------------------------------------------------------------

SQL_CJK = "translate(lower(p_name), 'abcdefghijkl', '山水雲石木竹花鳥魚龍金玉')"


def _cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.translate(F.lower("p_name"), "abcdefghijkl", "山水雲石木竹花鳥魚龍金玉").alias("t"))


@R.add(f"""WITH r AS (SELECT p_partkey, regexp_extract_all({SQL_CJK}, '[㐀-鿿]+') AS runs FROM part)
SELECT p_partkey, array_to_string(flatten(list_transform(runs, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_concat(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3))) END)), ',') AS tokens FROM r""")
def str2_cjk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cjk(spark, sf_dir).select("p_partkey", F.array_join(T.cjk_tokens(F.col("t")), ",").alias("tokens"))


SPELT = "CASE f " + " ".join(f"WHEN '{a}' THEN '{b}' WHEN '{b}' THEN '{a}'" for a, b in T.SPELLINGS.items()) + " END"


@R.add(f"""WITH w AS (SELECT DISTINCT unnest(['color-' || lower(p_type[1:4]), lower(split_part(p_type, ' ', 1)) || '''s', 'centre', 'mold', lower(p_brand)]) AS word FROM part),
f AS (SELECT word, unnest([word] || list_filter(string_split(word, '-'), lambda p: length(p) > 1) || CASE WHEN length(word) > 3 THEN [regexp_replace(word, '''s$', '')] ELSE [] END) AS f FROM w),
g AS (SELECT word, f FROM f UNION SELECT word, {SPELT} FROM f)
SELECT word, string_agg(f, ',' ORDER BY f) AS forms FROM g WHERE f IS NOT NULL GROUP BY word""")
def str4_word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    words = F.array(F.concat(F.lit("color-"), F.lower(F.substring("p_type", 1, 4))), F.concat(F.lower(F.split("p_type", " ")[0]), F.lit("'s")), F.lit("centre"), F.lit("mold"), F.lower("p_brand"))
    w = p.select(F.explode(words).alias("word")).distinct()
    return w.select("word", F.array_join(F.array_sort(T.word_variants(F.col("word"))), ",").alias("forms"))




@R.add("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]+')) AS word FROM documents),
f AS (SELECT word, word AS form FROM w UNION SELECT word, CASE WHEN NOT regexp_full_match(word, '[a-z][a-z''-]{2,}') THEN word WHEN word LIKE '%ies' AND length(word) > 4 THEN word[1:-4] || 'y'
 WHEN word LIKE '%s' AND NOT (word LIKE '%is' OR word LIKE '%ss' OR word LIKE '%ics') THEN word[1:-2] WHEN NOT regexp_matches(word, '[sxz]$') THEN word || 's' ELSE word END FROM w) SELECT * FROM f""")
def str5_inflected(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).distinct()
    return words.select("word", F.explode(T.forms(F.col("word"))).alias("form"))


@R.add(f"SELECT p_partkey FROM part WHERE regexp_matches({SQL_CJK}, '(^|[^㐀-鿿]|的)花($|[^㐀-鿿]|山)')")
def str7_single_character(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cjk(spark, sf_dir).where(A.concept_present(F.col("t"), "花", left="的", right="山")).select("p_partkey")


@R.add("""WITH q(question) AS (SELECT DISTINCT n_name || ' Vases, ' || n_name || ' and  VASES of ' || repeat('x', 70) FROM nation)
SELECT DISTINCT question, substring(unnest(regexp_extract_all(lower(question), '\\w+')), 1, 64) AS word FROM q""")
def str9_query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_name")
    questions = table(spark, sf_dir, "nation").select(F.concat(n, F.lit(" Vases, "), n, F.lit(" and  VASES of " + "x" * 70)).alias("question")).distinct()
    return questions.select("question", F.explode(T.asked_words(F.col("question"))).alias("word"))


@R.add("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type, ' ') || [' '], lambda x: trim(x)), lambda x: x <> ''), '; ') AS shown FROM part")
def str12_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat(F.split("p_type", " "), F.array(F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", C.shown(parts, "array<string>").alias("shown"))


@R.add("""WITH n AS (SELECT n, n // 100 AS h, n // 10 % 10 AS t, n % 10 AS o, ['一', '二', '三', '四', '五', '六', '七', '八', '九'] AS d FROM (SELECT DISTINCT p_partkey % 999 + 1 AS n FROM part))
SELECT n, CASE WHEN h > 0 THEN d[h] || '百' ELSE '' END || CASE WHEN t > 0 THEN d[t] || '十' WHEN h > 0 AND o > 0 THEN '零' ELSE '' END || CASE WHEN o > 0 THEN d[o] ELSE '' END AS numeral, CAST(n AS INTEGER) AS value,
 CAST(CASE WHEN h > 0 AND t > 0 AND o > 0 THEN n END AS INTEGER) AS by_digit FROM n""")
def str16_chinese_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.array(*map(F.lit, "一二三四五六七八九"))
    at = lambda c: F.try_element_at(digit, F.col(c).cast("int"))
    own = table(spark, sf_dir, "part").select((F.col("p_partkey") % 999 + 1).alias("id")).distinct()
    n = own.select(F.col("id").alias("n"), F.floor(F.col("id") / 100).alias("h"), (F.floor(F.col("id") / 10) % 10).alias("t"), (F.col("id") % 10).alias("o"))
    nothing = F.lit("")
    tens = F.when(F.col("t") > 0, F.concat(at("t"), F.lit("十"))).when((F.col("h") > 0) & (F.col("o") > 0), "零").otherwise(nothing)
    filled = (F.col("h") > 0) & (F.col("t") > 0) & (F.col("o") > 0)
    hundreds = F.when(F.col("h") > 0, F.concat(at("h"), F.lit("百"))).otherwise(nothing)
    named = n.withColumn("numeral", F.concat(hundreds, tens, F.when(F.col("o") > 0, at("o")).otherwise(nothing))).withColumn("digits", F.when(filled, F.concat(at("h"), at("t"), at("o"))))
    return named.select("n", "numeral", T.chinese_numbers(F.col("numeral")).alias("value"), T.chinese_numbers(F.col("digits")).alias("by_digit"))


@R.add(f"SELECT p_partkey, replace(translate({SQL_CJK}, '雲鳥魚龍', '云鸟鱼龙'), '山水', '风景') AS simplified FROM part")
def str17_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cjk(spark, sf_dir).select("p_partkey", T.simplified(F.col("t"), {"山水": "风景"}, {"雲": "云", "鳥": "鸟", "魚": "鱼", "龍": "龙"}).alias("simplified"))


@R.add(f"""WITH p AS (SELECT p_partkey, {NORM.format(x="p_name || '; ' || p_brand || '. ' || p_type")} AS e, {NORM.format(x="CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name[1:4] WHEN 2 THEN p_type WHEN 3 THEN 'nothing of it' ELSE upper(p_brand) END")} AS q FROM part)
SELECT p_partkey, CASE WHEN length(q) >= 8 THEN contains(e, q) ELSE length(q) >= 3 AND (e = q OR list_contains(list_transform(regexp_split_to_array(e, '[;,.]'), lambda s: trim(s)), q)) END AS visible FROM p""")
def str18_quote_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    quote = F.when(k == 0, F.col("p_name")).when(k == 1, F.substring("p_name", 1, 4)).when(k == 2, F.col("p_type")).when(k == 3, "nothing of it").otherwise(F.upper("p_brand"))
    whole = F.concat("p_name", F.lit("; "), "p_brand", F.lit(". "), "p_type")
    return p.select("p_partkey", T.quote_visible(whole, quote).alias("visible"))


ALIASES = {"en": ("english", "anglais"), "fr": ("french",), "de": ("german", "en")}


@R.add("WITH a(lang, name) AS (VALUES " + ", ".join(f"('{k}', '{n}')" for k, v in ALIASES.items() for n in (k, *v)) + ") SELECT DISTINCT lang, coalesce(name, lang) AS name FROM documents LEFT JOIN a USING (lang)")
def str20_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in T.merged_aliases(ALIASES).items() for x in pair))
    also = F.coalesce(F.try_element_at(names, F.col("lang")), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("lang").distinct().select("lang", F.explode(F.array_distinct(F.concat(F.array("lang"), also))).alias("name"))


REGIONS = {"east": "(?i)china|japan|india", "west": "(?i)united|canada|brazil", "north": "(?i)russia|germany|france"}


@R.add("""SELECT n_nationkey, coalesce(CASE WHEN regexp_matches(n_name, '(?i)china|japan|india') THEN 'east' WHEN regexp_matches(n_name, '(?i)united|canada|brazil') THEN 'west' WHEN regexp_matches(n_name, '(?i)russia|germany|france') THEN 'north' END,
 CASE WHEN n_nationkey % 3 > 0 THEN 'pack' || n_regionkey END) AS origin FROM nation""")
def str21_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = F.when(F.col("n_nationkey") % 3 > 0, F.array(F.concat(F.lit("pack"), "n_regionkey"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    sole = F.when(F.size(packs) == 1, packs[0])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(T.first_match(F.col("n_name"), REGIONS), sole).alias("origin"))


LEGS = (A.Obligation("china", ("china", "chinese"), ("^CHINA",), ("p2",)), A.Obligation("iran", ("iran", "persia"), (), ("p4",)), A.Obligation("france", ("france", "french"), (), ("p3",)))


@R.add("""WITH o AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS origin, 'p' || n_regionkey AS pack, CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 1 END AS packs FROM nation),
l(leg, pat, p) AS (VALUES ('china', '(?i)^CHINA|china|chinese', 'p2'), ('iran', '(?i)iran|persia', 'p4'), ('france', '(?i)france|french', 'p3'))
SELECT n_nationkey, coalesce(string_agg(leg, ',' ORDER BY leg), '') AS legs FROM o LEFT JOIN l ON CASE WHEN origin IS NOT NULL THEN regexp_matches(origin, pat) OR (pack = p AND n_nationkey % 2 = 1) ELSE packs = 1 AND pack = p END GROUP BY n_nationkey""")
def str22_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k, pack = F.col("n_nationkey"), F.concat(F.lit("p"), "n_regionkey")
    origin = F.when(k % 4 != 0, F.col("n_name"))
    packs = F.when(k % 5 == 0, F.array(pack, F.lit("other"))).otherwise(F.array(pack))
    regions = F.when(k % 2 == 1, F.array(pack)).otherwise(F.array().cast("array<string>"))
    return n.select(k, F.array_join(F.array_sort(A.legs_of(origin, regions, packs, LEGS)), ",").alias("legs"))


CUES = {"delegate": ("surprise me", "you choose"), "browse": ("just looking", "show me"), "greeting": ("hello", "hi")}
FILLER = ("please", "um", "well")


@R.add("""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Hello, um... surprise me!' WHEN 1 THEN 'Well, please' WHEN 2 THEN 'hi: just looking' WHEN 3 THEN 'show me vases' WHEN 4 THEN 'hi hi hi' ELSE c_name END AS text FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'delegate' WHEN 1 THEN 'unsure' WHEN 2 THEN 'browse' WHEN 4 THEN 'greeting' END AS kind FROM t""")
def str23_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "Hello, um... surprise me!").when(k == 1, "Well, please").when(k == 2, "hi: just looking").when(k == 3, "show me vases").when(k == 4, "hi hi hi").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", A.opening_kind(text, CUES, FILLER).alias("kind"))


@R.add(f"SELECT s_suppkey, sha256({NORM.format(x='s_name')}) AS digest FROM supplier")
def hsh2_query_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.query_digest(F.col("s_name")).alias("digest"))


@R.add("""WITH w AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS p FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)),
c AS (SELECT *, CAST(coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM w)
SELECT doc_id, coalesce(string_agg(x[1:20 - b], ' ' ORDER BY p) FILTER (b < 20), '') AS kept FROM c GROUP BY doc_id""")
def sec27_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.within_budget(F.split("text", " ", -1), 20), " ").alias("kept"))


# --- numbers, arrays, maps ---------------------------------------------------------------------------------------------


@R.add("SELECT p_partkey, round(least(1.0, greatest(0.0, (p_size / 50.0 - 0.28) / 0.72)), 8) AS above FROM part")
def mth2_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.above_floor(F.col("p_size") / 50.0, 0.28), 8).alias("above"))


@R.add("SELECT p_partkey, round(100 * (0.55 * p_size / 50.0 + 0.25 * (p_partkey % 7) / 7.0 + 0.20 * p_retailprice / 3000), 6) AS blend FROM part")
def mth3_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(V.hybrid_blend(F.col("p_size") / 50.0, (F.col("p_partkey") % 7) / 7.0, F.col("p_retailprice") / 3000), 6).alias("blend"))


@R.add("SELECT doc_id, round(least(n_chars, 1600) / 8.0 + least(len(string_split(text, chr(10))), 12) * 20.0 + CASE WHEN doc_id % 3 = 0 THEN 80 ELSE 0 END, 6) AS score FROM documents")
def mth6_evidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = V.capped_score([(F.col("n_chars"), 1600, 0.125), (F.size(F.split("text", "\n", -1)), 12, 20.0)], [(F.col("doc_id") % 3 == 0, 80.0)])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score"))


@R.add(f"""WITH {FIELDS_SQL} SELECT doc_id, CAST(len(list_intersect(list_distinct(title), list_distinct(content))) AS INTEGER) AS shared, CAST(len(list_distinct(list_filter(content, lambda t: NOT list_contains(title, t)))) AS INTEGER) AS others,
 list_has_any(title, content) AS touch, array_to_string(list_sort(list_distinct(title)), ' ') AS title FROM fld""")
def arr1_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(catalogue(spark, sf_dir))
    return f.select("doc_id", F.size(F.array_intersect("title", "content")).alias("shared"), F.size(F.array_except("content", "title")).alias("others"), F.arrays_overlap("title", "content").alias("touch"), F.array_join(F.array_sort(F.array_distinct("title")), " ").alias("title"))


@R.add("SELECT p_partkey, array_to_string(flatten(list_transform(string_split(p_type, ' '), lambda w: string_split(w, 'A'))), '|') AS flat FROM part")
def arr2_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.transform(F.split("p_type", " ", -1), lambda w: F.split(w, F.lit("A"), -1))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.flatten(nested), "|").alias("flat"))


@R.add("""WITH w AS (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS p FROM (SELECT doc_id, string_split(text, ' ') AS s FROM documents)), f AS (SELECT doc_id, x, min(p) AS p FROM w GROUP BY doc_id, x)
SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS once FROM f GROUP BY doc_id""")
def arr3_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("once"))


@R.add("SELECT p_partkey, unnest(['size', 'price', 'name']) AS field, unnest([CAST(p_size AS DOUBLE), p_retailprice, CAST(length(p_name) AS DOUBLE)]) AS score FROM part")
def map1_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", V.score_map(size=F.col("p_size"), price=F.col("p_retailprice"), name=F.length("p_name")).alias("scores"))
    return p.select("p_partkey", F.explode("scores").alias("field", "score"))


# --- projections and records -------------------------------------------------------------------------------------------


@R.add("SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN 'CC BY' END, CASE WHEN p_size % 2 = 0 THEN 'CC0' END) AS license FROM part")
def prj3_default_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    chunks = F.array(F.struct(F.lit("e").alias("evidence_id"), F.when(F.col("p_size") % 3 == 0, "CC BY").alias("license")))
    out = p.select("p_partkey", C.licensed(chunks, F.when(F.col("p_size") % 2 == 0, "CC0")).alias("c"))
    return out.select("p_partkey", F.col("c")[0]["license"].alias("license"))


@R.add(f"WITH {FIELDS_SQL} SELECT doc_id, array_to_string(title, ' ') AS title, array_to_string(routing, ' ') AS routing, array_to_string(metadata, ' ') AS metadata, CAST(len(content) AS INTEGER) AS content FROM fld")
def prj5_search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fields(catalogue(spark, sf_dir))
    return f.select("doc_id", *(F.array_join(c, " ").alias(c) for c in ("title", "routing", "metadata")), F.size("content").alias("content"))


@R.add("SELECT p_partkey, substring(concat_ws(' | ', CASE WHEN p_size % 3 = 0 THEN p_type END, p_name, p_brand), 1, 30) AS judged FROM part")
def prj9_judge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence_text = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(" ")
    return table(spark, sf_dir, "part").select("p_partkey", C.judge_text([evidence_text], [F.col("p_name"), F.col("p_brand")], 30).alias("judged"))


SQL_RANKED = "ranked AS (SELECT 'q' || (p_partkey % 6) AS query_id, p_partkey AS object_id, row_number() OVER (PARTITION BY p_partkey % 6 ORDER BY p_retailprice DESC, p_partkey) AS rank, p_size, p_type, p_retailprice AS score FROM part)"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.col("p_partkey") % 6).alias("query_id"), F.col("p_partkey").alias("object_id"), "p_size", "p_type", F.col("p_retailprice").alias("score"))
    return search.ranked(p, "object_id")


@R.add(f"WITH {SQL_RANKED} SELECT query_id, string_agg(rank || ':' || object_id, ',' ORDER BY rank) AS results FROM ranked WHERE rank <= 10 GROUP BY query_id")
def prj10_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.result_rows(_ranked(spark, sf_dir).where("rank <= 10"), ["object_id"])
    return rows.select("query_id", F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["rank"], r["object_id"])), ",").alias("results"))


@R.add(f"WITH {SQL_RANKED} SELECT query_id, object_id, p_type FROM ranked")
def prj11_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blind(_ranked(spark, sf_dir), ("query_id", "object_id", "p_type"))


@R.add("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def prj12_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.blind(table(spark, sf_dir, "customer"), ("c_custkey", "c_name", "c_mktsegment", "no_such_column"))


@R.add("""SELECT n_nationkey, concat_ws('，', n_name, CASE WHEN r_name <> n_name THEN r_name END) AS place FROM nation JOIN region ON r_regionkey = n_regionkey""")
def sec22_joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", C.joined_parts(F.col("n_name"), F.col("r_name"), F.lit(" "), F.col("n_name")).alias("place"))


@R.add("""SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'name:' || p_name END, CASE WHEN p_size > 25 THEN 'type:' || p_type END, 'brand:' || p_brand], lambda x: x IS NOT NULL)) AS chunk FROM part""")
def sec21_evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, large = F.col("p_size") % 2 == 0, F.col("p_size") > 25
    chunks = C.evidence_of({"name": F.when(even, F.col("p_name")), "type": F.when(large, F.col("p_type")), "brand": F.col("p_brand")}, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(chunks).alias("c")).select("p_partkey", F.concat_ws(":", "c.supports", "c.text").alias("chunk"))


RULE = C.Rule("and", patterns=("that the", "anin"), strong=("thea",))


def _sql_hit(column: str, phrase: str) -> str:
    return f"CAST(regexp_matches(lower({column}), '(^|[^a-z0-9]){phrase}([^a-z0-9]|$)') AS DOUBLE)"


@R.add(f"SELECT doc_id, {_sql_hit('text', 'that the')} + {_sql_hit('text', 'anin')} + 3 * {_sql_hit('text', 'thea')} AS score FROM documents")
def cls1_pattern_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.pattern_score(F.col("text"), RULE).alias("score"))


PACKS = (C.Rule("p_en", ("en",)), C.Rule("p_src", ("src1", "src2"), ("fr",)))
SQL_PACK = f"""pack AS (SELECT doc_id, unnest(['p_en', 'p_src']) AS label, unnest([{_sql_hit("concat_ws(' ', lang, source)", 'en')}, {_sql_hit("concat_ws(' ', lang, source)", 'src1')} + {_sql_hit("concat_ws(' ', lang, source)", 'src2')} + 3 * {_sql_hit("concat_ws(' ', lang, source)", 'fr')}]) AS score FROM documents)"""


@R.add(f"WITH {SQL_PACK} SELECT doc_id, label, score FROM pack WHERE score > 0")
def cls2_culture_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled(table(spark, sf_dir, "documents"), "doc_id", PACKS, F.concat_ws(" ", "lang", "source"))


RELATIONS = (C.Rule("r_a", ("the", "of"), ("thea",)), C.Rule("r_b", ("anin", "heed"), ("onst",)), C.Rule("r_c", ("is",)))
SQL_RELATION = "rel AS (SELECT doc_id, unnest(['r_a', 'r_b', 'r_c']) AS label, unnest([{a} + {b} + 3 * {c}, {d} + {e} + 3 * {f}, {g}]) AS score FROM documents)".format(
    **{k: _sql_hit("text", v) for k, v in zip("abcdefg", ("the", "of", "thea", "anin", "heed", "onst", "is"), strict=True)}
)


@R.add(f"""WITH {SQL_RELATION}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place, max(score) OVER (PARTITION BY doc_id) AS best FROM rel WHERE score > 0)
SELECT doc_id, label, score, place FROM k WHERE place <= 3 AND score >= 0.5 * best""")
def cls4_relation_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.near_best(C.labelled(table(spark, sf_dir, "documents"), "doc_id", RELATIONS, F.col("text")), "doc_id", "label", 3, 0.5)


@R.add(f"""WITH {SQL_PACK}, {SQL_RELATION},
pk AS (SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, label) AS packs FROM (SELECT * FROM pack WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 2 AND score >= 0.5 * max(score) OVER (PARTITION BY doc_id)) GROUP BY doc_id),
rl AS (SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, label) AS relations FROM (SELECT * FROM rel WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) <= 3 AND score >= 0.5 * max(score) OVER (PARTITION BY doc_id)) GROUP BY doc_id)
SELECT doc_id, coalesce(packs, '') AS packs, coalesce(relations, '') AS relations FROM documents LEFT JOIN pk USING (doc_id) LEFT JOIN rl USING (doc_id)""")
def cls5_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    layers = {"packs": (C.labelled(d, "doc_id", PACKS, F.concat_ws(" ", "lang", "source")), 2, 0.5), "relations": (C.labelled(d, "doc_id", RELATIONS, F.col("text")), 3, 0.5)}
    return C.routed(d.select("doc_id"), "doc_id", layers).select("doc_id", F.array_join("packs", ",").alias("packs"), F.array_join("relations", ",").alias("relations"))


@R.add("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND len(string_split(text, chr(10))) >= 3 THEN 'full' ELSE 'thin' END AS depth FROM documents")
def cls7_evidence_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.evidence_depth(F.split("text", "\n", -1), F.col("doc_id") % 2 == 0).alias("depth"))


@R.add("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_partkey, CASE WHEN place = 1 THEN 'opening' WHEN place = n THEN 'closing' WHEN place = (n + 1) // 2 THEN 'pivot' ELSE 'support' END AS role FROM r""")
def cls9_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.roles(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey").select("p_partkey", "role")


# --- filters, joins, ranks ---------------------------------------------------------------------------------------------


@R.add("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey % 3 = 0")
def flt7_matching_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("date_earliest"), F.col("p_size").alias("date_latest"), F.lit("u").alias("image_url"), F.lit("full").alias("evidence_depth"))
    facets = spark.createDataFrame([], "p_partkey long, facet string, value_norm string")
    return filters.matching_ids(p, facets, filters.FilterSpec(date_start=10, date_end=20), "p_partkey", p.where("p_partkey % 3 = 0").select("p_partkey"))


SPECS = ({"date_start": 10, "date_end": 20}, {"date_start": 30, "date_end": 20}, {"colour": "red"}, {"cultures": ["Han"]}, {"cultures": "Han"}, {"image_required": 1}, None)


@R.add("SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS spec, unnest([true, false, false, true, false, false, false]) AS accepted")
def flt8_parsed_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, filters.parsed(s) is not None) for k, s in enumerate(SPECS)], "spec int, accepted boolean")


@R.add("SELECT p_brand, count(*) AS n, count(*) >= 5 AS enough FROM part WHERE p_size > 30 GROUP BY p_brand")
def flt14_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = filters.Gates({"has_evidence": F.col("p_size") > 30})
    n = gates.passing(table(spark, sf_dir, "part")).groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.withColumn("enough", F.col("n") >= 5)


@R.add("SELECT p_partkey FROM part WHERE p_size > 10 AND p_retailprice > 100 AND length(p_name) > 0")
def flt23_source_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = filters.Gates({"open": F.col("p_size") > 10, "image": F.col("p_retailprice") > 100, "title": F.length("p_name") > 0})
    return gates.passing(table(spark, sf_dir, "part")).select("p_partkey")


PREDICATES = (A.Predicate("repair", (("bronze",), ("rust", "corro"), ("repair",)), "^And|thea"), A.Predicate("sacred", (("museum",), ("sacred",)), None), A.Predicate("return", (("loot",), ("should",)), "heed", without="unsupported"))
SQL_ASKED = """asked AS (SELECT 'q' || (doc_id % 12) AS query_id, min(CASE doc_id % 4 WHEN 0 THEN 'Bronze: rust and repair?' WHEN 1 THEN 'still SACRED in a museum' WHEN 2 THEN 'should looted things go' ELSE 'cats' END) AS question FROM documents WHERE doc_id % 12 = doc_id % 4 + 4 * (doc_id % 12 // 4) GROUP BY doc_id % 12)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "Bronze: rust and repair?").when(k == 1, "still SACRED in a museum").when(k == 2, "should looted things go").otherwise("cats")
    return table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("q"), F.col("doc_id") % 12).alias("query_id")).agg(F.min(text).alias("question"))


@R.add("""WITH a AS (SELECT 'q' || (doc_id % 12) AS query_id, min(doc_id % 4) AS k FROM documents GROUP BY doc_id % 12),
r AS (SELECT 'q' || (doc_id % 12) AS query_id, doc_id, text FROM documents WHERE doc_id % 5 <> 0),
m AS (SELECT query_id, k, count(DISTINCT doc_id) FILTER (CASE k WHEN 0 THEN regexp_matches(text, '(?i)^And|thea') WHEN 2 THEN regexp_matches(text, '(?i)heed') ELSE false END) AS matched FROM a LEFT JOIN r USING (query_id) WHERE k < 3 GROUP BY ALL)
SELECT query_id, ['repair', 'sacred', 'return'][k + 1] AS predicate, CASE WHEN matched > 0 THEN 'partially_supported' ELSE 'unsupported' END AS status, matched FROM m""")
def cls8_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    results = d.select(F.concat(F.lit("q"), F.col("doc_id") % 12).alias("query_id"), F.col("doc_id").alias("object_id"), F.when(F.col("doc_id") % 5 == 0, "provenance").otherwise("curatorial").alias("source_kind"), "text")
    return A.assessed(_asked(spark, sf_dir), results, PREDICATES)


@R.add("SELECT doc_id, p AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents) WHERE p % 3 <> 0 AND regexp_matches(line, '(?i)heed|onst')")
def flt17_predicate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    kind = F.when(F.col("line") % 3 == 0, "provenance").otherwise("metadata")
    return rows.where((kind != "provenance") & A.any_pattern(F.col("text"), ("heed", "onst"))).select("doc_id", F.col("line").cast("long").alias("line"))


@R.add(f"""WITH {SQL_RANKED}, other AS (SELECT 'q' || (p_partkey % 6) AS query_id, p_partkey AS object_id, row_number() OVER (PARTITION BY p_partkey % 6 ORDER BY p_size, p_partkey) AS rank FROM part)
SELECT query_id, object_id, a.rank AS price_rank, b.rank AS size_rank FROM (SELECT * FROM ranked WHERE rank <= 40) a FULL JOIN (SELECT * FROM other WHERE rank <= 40) b USING (query_id, object_id)""")
def jon2_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = _ranked(spark, sf_dir)
    size = search.ranked(price.select("query_id", "object_id", (-F.col("p_size")).alias("score")), "object_id", 40)
    return fusion.channel_ranks({"price": price.where("rank <= 40"), "size": size}, "object_id").withColumnsRenamed({"price": "price_rank", "size": "size_rank"})


SQL_JUDGED = "judged AS (SELECT 'q' || (p_partkey % 6) AS query_id, p_partkey AS object_id, p_size % 4 AS relevance FROM part WHERE p_partkey % 3 = 0)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("q"), F.col("p_partkey") % 6).alias("query_id"), F.col("p_partkey").alias("object_id"), (F.col("p_size") % 4).alias("relevance"))


@R.add(f"WITH {SQL_RANKED}, {SQL_JUDGED} SELECT query_id, object_id, rank, coalesce(relevance, 0) AS grade, relevance IS NOT NULL AS is_judged FROM ranked LEFT JOIN judged USING (query_id, object_id)")
def jon3_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).join(_judged(spark, sf_dir), ["query_id", "object_id"], "left")
    return rows.select("query_id", "object_id", "rank", F.coalesce("relevance", F.lit(0)).alias("grade"), F.col("relevance").isNotNull().alias("is_judged"))


@R.add(f"WITH {SQL_RANKED} SELECT query_id, object_id FROM ranked WHERE object_id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45)")
def jon4_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("object_id"))
    return _ranked(spark, sf_dir).join(allowed, "object_id", "left_semi").select("query_id", "object_id")


@R.add(f"WITH {FIELDS_SQL}, {_sql_terms(PLAN)}, {SQL_FTS.format(src='fld')} SELECT query_id, doc_id, score, lang FROM fts JOIN obj USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 100")
def jon6_postings_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.ranked(search.fts_bm25(_index(spark, sf_dir), [PLAN]), "doc_id", 100)
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(best, "doc_id").select("query_id", "doc_id", "score", "lang")


@R.add("""WITH o AS (SELECT o_orderkey, sum(n) OVER (ORDER BY o_orderkey) - n AS low, sum(n) OVER (ORDER BY o_orderkey) AS high FROM (SELECT o_orderkey, o_orderkey % 4 AS n FROM orders))
SELECT CAST(row AS BIGINT) AS row, o_orderkey FROM (SELECT o_orderkey, unnest(range(CAST(low AS BIGINT), CAST(high AS BIGINT))) AS row FROM o)""")
def jon7_row_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("n"))
    return readers.row_owners(o, "o_orderkey", "n")


@R.add("""WITH p AS (SELECT p_partkey, p_brand, p_size * 30 AS a, p_size * 30 + p_partkey % 250 AS b FROM part)
SELECT p_brand, century, count(*) AS n FROM (SELECT p_brand, unnest(range(greatest(-1000, a // 100 * 100), least(1900, b // 100 * 100) + 1, 100)) AS century FROM p) GROUP BY ALL""")
def jon8_century_by_material(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 30).alias("date_earliest"), (F.col("p_size") * 30 + F.col("p_partkey") % 250).alias("date_latest"))
    return C.centuries(p).groupBy("p_brand", F.col("century").cast("long").alias("century")).agg(F.count("*").alias("n"))


@R.add(f"WITH {SQL_RELATION} SELECT label, count(*) AS n, sum(score) AS total FROM rel WHERE score > 0 GROUP BY label")
def jon9_objects_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.labelled(table(spark, sf_dir, "documents"), "doc_id", RELATIONS, F.col("text")).groupBy("label").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@R.add("""WITH f AS (SELECT p_partkey, list_distinct([p_brand] || string_split(p_type, ' ')) AS f FROM part), s AS (SELECT * FROM f WHERE p_partkey % 400 = 1)
SELECT f.p_partkey, round(max(len(list_intersect(f.f, s.f)) / len(list_distinct(f.f || s.f))), 8) AS redundancy FROM f, s WHERE f.p_partkey % 400 <> 1 GROUP BY f.p_partkey""")
def jon11_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.concat(F.array("p_brand"), F.split("p_type", " "))).alias("features"))
    chosen = p.where("p_partkey % 400 = 1")
    return ranking.redundancy(p.where("p_partkey % 400 <> 1"), chosen, "p_partkey").withColumn("redundancy", F.round("redundancy", 8))


@R.add("""WITH w AS (SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events WHERE value > 60 AND event_id % 2 = 0 AND event_id % 3 <> 0 GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS query_id, event_type AS requirement_id, 2 AS min_witnesses, coalesce(n, 0) AS witnesses, coalesce(n, 0) >= 2 AS satisfied FROM (SELECT DISTINCT user_id, event_type FROM events) LEFT JOIN w USING (user_id, event_type)""")
def jon12_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("requirement_id"), F.lit("t").alias("requirement_text"), F.when(F.col("event_id") % 3 == 0, "other words").otherwise("quote").alias("source_quote"), F.col("event_id").alias("object_id"), F.when(F.col("value") > 60, "supported").otherwise("no").alias("status"), F.lit(True).alias("source_bound"), F.lit("narrower").alias("relation"))
    req = e.select("query_id", "requirement_id").distinct().select("*", F.lit("t").alias("requirement_text"), F.lit("quote").alias("source_quote"), F.lit(2).alias("min_witnesses"))
    return evidence.set_coverage(req, e, e.where("object_id % 2 = 0").select("query_id", "object_id"))


@R.add("""WITH w AS (SELECT user_id, event_type, count(DISTINCT event_id) AS n FROM events WHERE value > 60 GROUP BY ALL), s AS (SELECT user_id, event_type, coalesce(n, 0) >= 3 AS ok FROM (SELECT DISTINCT user_id, event_type FROM events) LEFT JOIN w USING (user_id, event_type))
SELECT CAST(user_id AS VARCHAR) AS query_id, bool_and(ok) AND user_id % 4 <> 0 AS valid FROM s GROUP BY user_id""")
def qry14_coverage_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("requirement_id"), F.lit("t").alias("requirement_text"), F.lit("s").alias("source_quote"), F.col("event_id").alias("object_id"), F.when(F.col("value") > 60, "supported").otherwise("no").alias("status"), F.lit(True).alias("source_bound"), F.lit("exact").alias("relation"))
    req = e.select("query_id", "requirement_id", "requirement_text", "source_quote").distinct().withColumn("min_witnesses", F.lit(3))
    stored = evidence.set_coverage(req, e, e.select("query_id", "object_id")).select("query_id", "requirement_id", (F.col("witnesses") + (F.col("query_id").cast("long") % 4 == 0).cast("long")).alias("witnesses"))
    return evidence.coverage_valid(stored, req, e, e.select("query_id", "object_id"))


@R.add("SELECT p_brand AS query_id, p_partkey AS object_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 7")
def win1_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("object_id"), F.col("p_size").alias("score"))
    return search.ranked(p, "object_id", 7).drop("score")


@R.add(f"""WITH {SQL_RANKED}, o AS (SELECT query_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY p_size DESC, object_id) AS r2, rank FROM ranked),
c AS (SELECT query_id, object_id, round(CASE WHEN rank <= 30 THEN 1.0 / (60 + rank) ELSE 0 END + CASE WHEN r2 <= 30 THEN 1.15 / (60 + r2) ELSE 0 END, 8) AS score FROM o WHERE rank <= 30 OR r2 <= 30)
SELECT query_id, object_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, object_id) AS rank FROM c""")
def win2_consensus_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = _ranked(spark, sf_dir)
    size = search.ranked(price.select("query_id", "object_id", F.col("p_size").alias("score")), "object_id", 30)
    return fusion.consensus(price.where("rank <= 30"), size, "object_id").select("query_id", "object_id", "score", "rank")


@R.add("""WITH r AS (SELECT 'q' || (user_id % 5) AS query_id, event_id, event_type, row_number() OVER (PARTITION BY user_id % 5, event_type ORDER BY ts, event_id) AS rank FROM events),
f AS (SELECT query_id, event_id, min(rank * 10 + CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) AS p FROM r WHERE event_type IN ('click', 'view', 'purchase') AND rank <= 20 GROUP BY ALL)
SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY p, event_id) AS place FROM f""")
def win9_interleaved_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.col("user_id") % 5, "event_type").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("q"), F.col("user_id") % 5).alias("query_id"), "event_id", "event_type", place.alias("rank")).where("rank <= 20")
    return fusion.interleaved({a: e.where(F.col("event_type") == a) for a in ("click", "view", "purchase")}, "event_id")


@R.add(f"WITH {SQL_SCORED.format(which='vec_id % 50 = 0')} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE label % 2 = 0 QUALIFY rank <= 10")
def top2_evidence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 50 = 0").select(F.concat(F.lit("v"), "vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.top_k(v.where("label % 2 = 0").drop("label"), queries, 10, "vec_id")


@R.add("""WITH p AS (SELECT 'q' || (p_partkey % 4) AS query_id, p_partkey AS object_id, p_retailprice AS score, p_size % 6 AS axis FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, axis ORDER BY score DESC, object_id) <= 3 AS reserved FROM p)
SELECT query_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, score DESC, object_id) AS place FROM r QUALIFY place <= 30""")
def smp6_axis_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.col("p_partkey") % 4).alias("query_id"), F.col("p_partkey").alias("object_id"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 6).alias("axis"))
    return ranking.reserved_pool(p, "axis", 3, 30, "object_id").select("query_id", "object_id", "place")


@R.add(f"""WITH {SQL_RANKED}, a AS (SELECT query_id, object_id, rank, CASE WHEN p_size % 5 = 0 THEN p_size % 3 END AS leg, CASE WHEN p_size % 7 < 3 THEN p_size % 7 END AS axis, p_size > 40 AS rich FROM ranked),
b AS (SELECT *, CASE WHEN leg IS NOT NULL AND row_number() OVER (PARTITION BY query_id, leg ORDER BY rank, object_id) <= 2 THEN 0 WHEN axis IS NOT NULL AND row_number() OVER (PARTITION BY query_id, axis ORDER BY rank, object_id) <= 1 THEN 1 END AS s FROM a),
c AS (SELECT *, coalesce(s, CASE WHEN rich AND row_number() OVER (PARTITION BY query_id, s IS NULL AND rich ORDER BY rank, object_id) <= 2 THEN 2 ELSE 3 END) AS slot FROM b)
SELECT query_id, object_id, slot, row_number() OVER (PARTITION BY query_id ORDER BY slot, rank, object_id) AS place FROM c QUALIFY place <= 20""")
def smp7_audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = _ranked(spark, sf_dir).select("query_id", "object_id", "rank", F.when(size % 5 == 0, size % 3).alias("leg"), F.when(size % 7 < 3, size % 7).alias("axis"), (size > 40).alias("rich"))
    return A.audit_sample(rows, 20, 2).select("query_id", "object_id", "slot", "place")


def smp10_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy swaps; SQL has no equivalent, tests compare it with a plain loop."""
    rows = _ranked(spark, sf_dir).withColumn("legs", F.array((F.col("p_size") % 9).cast("string"), (F.col("object_id") % 7).cast("string"))).withColumn("full", F.col("p_size") % 4 == 0)
    chosen = rows.where("rank <= 5").select("query_id", "object_id", F.col("rank").alias("place"), "legs", "full")
    pool = rows.where("rank > 5").select("query_id", "object_id", "rank", "legs", "full")
    return A.repaired(chosen, pool, rows.select("query_id").distinct().withColumn("legs", F.array(*map(F.lit, "0238"))))


@R.add("SELECT o_orderkey AS query_id, o_totalprice FROM orders")
def set7_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), "o_totalprice")
    return readers.rejoined([o.where("query_id % 3 = 0"), o.where("query_id % 3 = 1"), o.where("query_id % 3 = 2")], o.select("query_id"))


@R.add(f"""WITH {SQL_RANKED}, {SQL_JUDGED}, b AS (SELECT 'q' || (p_partkey % 6) AS query_id, p_partkey AS object_id, row_number() OVER (PARTITION BY p_partkey % 6 ORDER BY p_size DESC, p_partkey) AS rank FROM part),
u AS (SELECT query_id, object_id, 'a' AS chain, rank FROM ranked WHERE rank <= 5 UNION ALL SELECT query_id, object_id, 'b', rank FROM b WHERE rank <= 5)
SELECT query_id, object_id, string_agg(chain || rank, ',' ORDER BY chain) AS sources, row_number() OVER (PARTITION BY query_id ORDER BY sha256('pool:' || query_id || ':' || object_id), object_id) AS place FROM u ANTI JOIN judged USING (query_id, object_id) GROUP BY query_id, object_id""")
def set8_pool_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _ranked(spark, sf_dir)
    b = search.ranked(a.select("query_id", "object_id", F.col("p_size").alias("score")), "object_id")
    out = A.pool_extension({"a": a, "b": b}, _judged(spark, sf_dir))
    return out.select("query_id", "object_id", F.array_join(F.transform("sources", lambda s: F.concat(s["chain"], s["rank"])), ",").alias("sources"), "place")


@R.add("SELECT CAST(count(DISTINCT source) AS BIGINT) AS houses, CAST(count(DISTINCT lang) AS BIGINT) AS packs, count(*) AS objects FROM documents")
def agg30_intro_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.intro_counts(table(spark, sf_dir, "documents"), "source", "lang")


# --- questions, audits, review -----------------------------------------------------------------------------------------

SQL_QUESTION = "question AS (SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'Chinese and Persian dogs' WHEN 1 THEN 'dogs of the world' WHEN 2 THEN 'Just  looking!' WHEN 3 THEN 'how is an unsigned work attributed' ELSE 'who owned the ' || lower(n_name) || ' vase' END AS text FROM nation)"


def _question(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    text = F.when(k == 0, "Chinese and Persian dogs").when(k == 1, "dogs of the world").when(k == 2, "Just  looking!").when(k == 3, "how is an unsigned work attributed").otherwise(F.concat(F.lit("who owned the "), F.lower("n_name"), F.lit(" vase")))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("text"))


@R.add(f"""WITH {SQL_QUESTION} SELECT query_id, regexp_matches(text, '(?i)of the world') OR CAST(regexp_matches(text, '(?i)china|chinese') AS INTEGER) + CAST(regexp_matches(text, '(?i)iran|persia') AS INTEGER) + CAST(regexp_matches(text, '(?i)france|french') AS INTEGER) >= 2 AS cross_cultural,
 regexp_matches(text, '(?i)owned|bought') AS provenance, regexp_full_match(lower(regexp_replace(text, '[\\s!,.]+', '', 'g')), 'justlooking') AS browse, regexp_matches(text, '(?i)unsigned|anonymous') AND regexp_matches(text, '(?i)attribut') AS attribution FROM question""")
def sec1_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.classified(_question(spark, sf_dir), "text", ["of the world"], LEGS, ["owned|bought"], ["justlooking"], [["unsigned", "anonymous"], ["attribut"]]).drop("text")


@R.add(f"WITH {SQL_QUESTION} SELECT query_id, CASE WHEN regexp_matches(text, '(?i)china|chinese') AND regexp_matches(text, '(?i)iran|persia') THEN 'china,iran' ELSE '' END AS legs FROM question")
def sec11_named_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _question(spark, sf_dir).select("query_id", F.array_join(A.named_legs(F.col("text"), LEGS), ",").alias("legs"))


@R.add("""WITH c AS (SELECT user_id, event_id, event_type FROM events), l AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS cand, max(event_id) FILTER (event_type = 'signup') AS fin FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS query_id, count(*) AS candidates, count(*) FILTER (event_type = 'click') AS reviewed, CASE WHEN any_value(fin) > any_value(coalesce(cand, -1)) THEN 'complete' WHEN count(*) FILTER (event_type = 'click') > 0 THEN 'in_progress' ELSE 'unreviewed' END AS status FROM c JOIN l USING (user_id) GROUP BY user_id""")
def sec3_question_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), F.col("event_id").alias("object_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "candidate").when(F.col("event_type") == "signup", "final").alias("kind"), F.lit("r").alias("reviewer"))
    return review.progress(e.select("query_id").distinct(), e.select("query_id", "object_id"), e.where("kind IS NOT NULL")).drop("delegated")


@R.add("""WITH c AS (SELECT user_id, event_type, min(event_id) AS object_id FROM events GROUP BY ALL), j AS (SELECT user_id, event_type, max_by(value, event_id) AS judgement FROM events WHERE event_id % 2 = 0 GROUP BY ALL), s AS (SELECT user_id, event_type, max_by(value, event_id) AS suggestion FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, event_type, judgement, suggestion, row_number() OVER (PARTITION BY user_id ORDER BY sha256('detail:' || event_type), event_type) AS place FROM c LEFT JOIN j USING (user_id, event_type) LEFT JOIN s USING (user_id, event_type)""")
def sec4_candidate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    keys = ["user_id", "event_type"]
    rows = e.select(*keys, F.col("event_id").alias("id"), "value")
    return review.candidate_detail(e.select(*keys).distinct(), rows.where("id % 2 = 0").withColumnRenamed("value", "judgement"), rows.where("id % 2 = 1").withColumnRenamed("value", "suggestion"), keys, "detail")


@R.add("SELECT event_id AS id, user_id, event_type, row_number() OVER (ORDER BY event_id) AS line FROM events")
def sec5_log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return review.exported(e)


@R.add("""SELECT n_regionkey AS query_id, CASE WHEN count(DISTINCT n_nationkey % 4) < 3 THEN 'partial' ELSE 'supported' END AS by_regions, CASE WHEN count(*) < 6 THEN 'partial' ELSE 'supported' END AS by_count FROM nation GROUP BY n_regionkey""")
def sec8_downgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("query_id")).agg(F.countDistinct(F.col("n_nationkey") % 4).alias("regions"), F.count("*").alias("n"))
    return n.select("query_id", A.downgraded(F.lit("supported"), F.lit(3), F.col("regions")).alias("by_regions"), A.downgraded(F.lit("supported"), F.lit(6), F.col("n")).alias("by_count"))


@R.add(f"""WITH {SQL_RANKED}, u AS (SELECT query_id, object_id, 0 AS turn, rank FROM ranked WHERE rank <= 8 AND p_size % 2 = 0 UNION ALL SELECT query_id, object_id, 1, rank FROM ranked WHERE rank <= 12), f AS (SELECT query_id, object_id, min(turn * 1000 + rank) AS p FROM u GROUP BY ALL)
SELECT query_id, object_id, row_number() OVER (PARTITION BY query_id ORDER BY p, object_id) AS rank FROM f""")
def sec10_merged_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return A.merged_audits(r.where("rank <= 8 AND p_size % 2 = 0"), r.where("rank <= 12"))


@R.add("""SELECT n_nationkey AS query_id, concat_ws('/', p, k, m) AS condition_id, p AS predicate, k AS kind, m AS material FROM nation, (VALUES ('made'), ('used')) a(p), (SELECT unnest(['vase', 'bowl']) AS k) b, (SELECT NULL::VARCHAR AS m) c WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'bronze', NULL, NULL, 'bronze' FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey % 3 > 0""")
def sec15_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    some = lambda test, *xs: F.when(test, F.array(*map(F.lit, xs))).otherwise(F.array().cast("array<string>"))
    q = table(spark, sf_dir, "nation").select(k.alias("query_id"), some(k % 2 == 0, "made", "used").alias("predicates"), some(k % 2 == 0, "vase", "bowl").alias("kinds"), some((k % 2 == 1) & (k % 3 > 0), "bronze").alias("materials"))
    return A.conditions(q, "predicates", "kinds", "materials")


@R.add(f"""WITH {SQL_RANKED} SELECT query_id, '[' || string_agg('{{"rank":' || rank || ',"object_id":' || object_id || ',"evidence":[{{"evidence_id":"e' || object_id || '","text":"' || p_type[1:9] || '"}}]}}', ',' ORDER BY rank) || ']' AS payload FROM ranked WHERE rank <= 4 GROUP BY query_id""")
def sec16_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return A.audit_payload(r, r.select("object_id", F.concat(F.lit("e"), "object_id").alias("evidence_id"), F.col("p_type").alias("text")), 4, 9)


@R.add("SELECT p_brand AS label, 'Which ' || p_brand || ' objects?' AS question, CASE WHEN count(*) FILTER (p_size > 25) >= 5 THEN 'supported' ELSE 'partial' END AS expected FROM part GROUP BY p_brand HAVING count(*) >= 8 UNION ALL SELECT 'none', 'Which lost objects?', 'unsupported'")
def sec18_regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("n"), F.when(F.count_if(F.col("p_size") > 25) >= 5, "supported").otherwise("partial").alias("status")).where("n >= 8")
    return C.regression_rows(cards.select("label", F.concat(F.lit("Which "), "label", F.lit(" objects?")).alias("question"), "status"), "status", [("none", "Which lost objects?", "unsupported")])


@R.add("WITH g AS (SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'CC0' WHEN p_size % 3 = 1 THEN 'restricted' ELSE 'not_recorded' END AS rights, count(*) AS n FROM part GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY p_brand), 4) AS share FROM g")
def sec19_rights_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    return C.rights_rollup(table(spark, sf_dir, "part").select("p_brand", F.when(k == 0, "CC0").when(k == 1, "restricted").alias("rights")), "p_brand", "rights")


@R.add("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') AND p_size > 5 AND p_retailprice IS NOT NULL")
def sec20_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gates = filters.Gates({"house": F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"), "evidence": F.col("p_size") > 5, "rights": F.col("p_retailprice").isNotNull()})
    return gates.passing(table(spark, sf_dir, "part")).select("p_partkey")


@R.add("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 3 OR max(event_id % 7) <> min(event_id % 7)")
def sec23_changed_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("model"), "event_type")
    many = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n > 3").select("user_id")
    return review.unlike_identity(e, "user_id", ["model"]).unionByName(many).distinct()


@R.add("""SELECT s_suppkey AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' WHEN s_suppkey % 7 = 0 THEN 'changed' END AS problem FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 UNION ALL SELECT -s_suppkey - 1, 'unexpected' FROM supplier WHERE s_suppkey % 11 = 0""")
def sec24_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.sha2("s_name", 256).alias("sha256"))
    files = s.where("name % 5 <> 0").withColumn("sha256", F.when(F.col("name") % 7 == 0, "x").otherwise(F.col("sha256")))
    return readers.manifest_problems(s, files.unionByName(s.where("name % 11 = 0").withColumn("name", -F.col("name") - 1)))


@R.add("SELECT DISTINCT p_brand, CASE WHEN p_size > 40 THEN 'TOO_LARGE' WHEN p_size < 3 THEN 'TOO_SMALL' END AS code FROM part WHERE p_size > 40 OR p_size < 3")
def sec26_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_brand", F.when(F.col("p_size") > 40, "TOO_LARGE").when(F.col("p_size") < 3, "TOO_SMALL").alias("code")).where("code IS NOT NULL").dropDuplicates(["p_brand", "code"])


@R.add("""WITH r AS (SELECT p_brand AS query_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part) SELECT query_id, p_partkey, place, CASE WHEN place <= 3 THEN 1 WHEN place <= 5 THEN 2 ELSE 3 END AS chapter FROM r WHERE place <= 7""")
def sec28_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), "p_partkey")
    return ranking.chapters(p, "p_partkey", V.chapter_sizes(7, 3))


@R.add("SELECT event_id, event_id % 2 = 0 AND NOT contains(props, '1') AS human FROM events")
def sec30_human_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", review.human_reviewed(F.col("event_id") % 2 == 0, F.col("props"), "1").alias("human"))


@R.add("SELECT user_id % 10 AS shard, count(*) AS planned, count(*) FILTER (value > 20) AS done, count(*) FILTER (value > 20) = count(*) AS complete FROM events GROUP BY user_id % 10")
def sec31_campaign_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("shard"), F.col("event_id").alias("query_id"), "value")
    return review.campaign_state(e.select("shard", "query_id"), e.where("value > 20").select("query_id"), "shard")


@R.add("""WITH d AS (SELECT p_partkey, p_size, p_size % 4 AS relevance, CASE WHEN p_size % 2 = 1 THEN 'supports' ELSE 'no' END AS verdict, CASE p_partkey % 3 WHEN 0 THEN 'visual_motif' WHEN 1 THEN 'open_theme' ELSE 'plain' END AS category FROM part),
c AS (SELECT *, CASE WHEN relevance = 3 AND verdict = 'supports' THEN 'high' WHEN relevance = 2 THEN 'medium' ELSE 'low' END AS confidence FROM d)
SELECT p_partkey, confidence, array_to_string(list_filter(['ai_draft', 'needs_human_confirmation', CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN category = 'visual_motif' OR (category = 'open_theme' AND relevance >= 1) THEN 'visual_review_required' END], lambda x: x IS NOT NULL), ',') AS risks,
 CASE WHEN relevance = 0 THEN 'unsupported' WHEN category = 'plain' AND p_size % 5 > 2 THEN 'partially_supported' ELSE 'supported' END AS status FROM c""")
def sec32_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    d = table(spark, sf_dir, "part").select("p_partkey", "p_size", (size % 4).alias("relevance"), F.when(size % 2 == 1, "supports").otherwise("no").alias("verdict"), F.when(k == 0, "visual_motif").when(k == 1, "open_theme").otherwise("plain").alias("category"))
    d = d.withColumn("confidence", A.confidence(F.col("relevance"), F.col("verdict")))
    flags = A.risks(F.col("confidence"), F.col("category"), F.col("relevance"), ["visual_motif"], ["open_theme"])
    cross = F.when(F.col("category") == "plain", "cross_cultural").otherwise(F.col("category"))
    status = A.consistent_status(F.lit("supported"), F.col("relevance"), F.when(size % 5 > 2, 1).otherwise(0), cross)
    return d.select("p_partkey", "confidence", F.array_join(flags, ",").alias("risks"), status.alias("status"))


@R.add("""WITH s AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS verdict, event_id % 9 = 0 AS stale, event_id % 10 = 0 AS copied FROM events)
SELECT event_id, CASE WHEN verdict IS NULL THEN 'invalid' WHEN stale THEN 'wrong_hash' ELSE 'accepted' END AS outcome FROM s""")
def sec7_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    frozen = e.select(F.col("user_id").cast("string").alias("query_id"), F.col("event_id").alias("object_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("dataset_sha256"))
    offered = frozen.withColumn("dataset_sha256", F.when(F.col("object_id") % 9 == 0, "x").otherwise(F.col("dataset_sha256"))).join(e.select(F.col("event_id").alias("object_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("verdict")), "object_id")
    return review.suggestion_outcomes(offered, frozen, ("signup", "purchase", "view", "click")).select(F.col("object_id").alias("event_id"), "outcome")


@R.add("""SELECT 'q' || (p_partkey % 6) AS query_id, count(*) AS pending, min(p_partkey) AS first FROM part WHERE p_partkey % 3 <> 0 GROUP BY p_partkey % 6""")
def sec6_pending_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.concat(F.lit("q"), F.col("p_partkey") % 6).alias("query_id"), F.col("p_partkey").alias("object_id"))
    grouped = readers.pending_pairs(pairs, _judged(spark, sf_dir))
    return grouped.select("query_id", F.size("pending").cast("long").alias("pending"), F.col("pending")[0].alias("first"))


@R.add("""WITH i AS (SELECT p_partkey, list_filter(string_split(lower(p_type), ' ') || [lower(p_brand), ''], lambda x: x <> '' AND contains('a promo anodized thing of brand#12 in steel', x)) AS hit FROM part), m AS (SELECT p_partkey, CAST(len(hit) AS INTEGER) AS mentions FROM i WHERE len(hit) > 0)
SELECT p_partkey, mentions FROM m ORDER BY mentions DESC, p_partkey LIMIT 1""")
def qry21_best_by_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.split("p_type", " "), F.array("p_brand", F.lit(""))).alias("labels"))
    return evidence.best_by_mentions(p, "A promo anodized thing of Brand#12 in STEEL", "labels", "p_partkey", "p_partkey")


@R.add("""SELECT 'dup' AS problem, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'orphan', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def qry16_dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("query_id"))
    twice = o.groupBy("query_id").count().where("count > 1").agg(F.lit("dup").alias("problem"), F.count("*").alias("n"))
    return twice.unionByName(o.join(c, "query_id", "left_anti").agg(F.lit("orphan").alias("problem"), F.count("*").alias("n")))


# --- searches as they are asked for -----------------------------------------------------------------------------------


@R.add(f"""WITH {FIELDS_SQL}, kept AS (SELECT * FROM fld WHERE doc_id % 2 = 0), {_sql_terms(SECOND)}, {SQL_BM25.format(src='kept')},
a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 JOIN kept USING (doc_id) WHERE list_contains(content, 'heed') AND list_contains(content, 'onst') QUALIFY rank <= 250),
b AS (SELECT 'all' AS query_id, doc_id, CASE WHEN doc_id % 4 = 0 THEN 1.1 ELSE 1.0 END AS score, row_number() OVER (ORDER BY doc_id % 4 <> 0, doc_id) AS rank FROM documents WHERE doc_id % 2 = 0) FROM a UNION ALL FROM b""")
def qry7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "full").otherwise("thin").alias("depth"))
    found = retrieval.searched(_index(spark, sf_dir), [SECOND], _searchable(), "bm25", allowed=even)
    return found.unionByName(retrieval.browsed(even, "doc_id", [search.QueryPlan("all", ())], "depth"))


@R.add(f"""WITH {FIELDS_SQL}, {_sql_terms(SECOND, search.QueryPlan('q9', ('tionha', 'anin')))}, {SQL_BM25.format(src='fld')},
p AS (SELECT query_id, doc_id, score, CASE query_id WHEN 'q2' THEN list_contains(content, 'heed') AND list_contains(content, 'onst') ELSE list_contains(content, 'tionha') AND list_contains(content, 'anin') END AS strict FROM bm25 JOIN fld USING (doc_id) WHERE doc_id % 3 = 0),
many AS (SELECT query_id, count(*) FILTER (strict) AS m FROM p GROUP BY query_id),
r AS (SELECT query_id, doc_id, score, NOT strict AS relaxed, row_number() OVER (PARTITION BY query_id ORDER BY NOT strict, score DESC, doc_id) AS rank FROM p JOIN many USING (query_id) WHERE strict OR m < 60)
SELECT * FROM r WHERE rank <= 250 UNION ALL SELECT 'again', doc_id, score, relaxed, rank FROM r WHERE rank <= 250 AND query_id = 'q9'""")
def qry8_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (("tionha",), ("anin",))
    plans = [SECOND, *(search.QueryPlan(name, ("tionha", "anin"), groups=both) for name in ("q9", "again"))]
    third = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    pool = third.select(F.explode(F.array(F.lit("q2"), F.lit("q9"))).alias("query_id"), "doc_id")
    return retrieval.search_many(_index(spark, sf_dir), plans, _searchable(), pool, 60)


@R.add(f"""WITH {SQL_RANKED} SELECT query_id, object_id, round(length(p_type) / 50.0, 6) AS relevance FROM ranked WHERE rank <= 60 AND rank % 2 = 1""")
def udf3_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).select("query_id", F.lit("which").alias("question"), "object_id", "rank", F.col("p_type").alias("text"))
    got = retrieval.judged(rows, lambda question, texts: [(k, len(t) / 50.0) for k, t in enumerate(texts) if k % 2 == 0], "object_id")
    return got.withColumn("relevance", F.round("relevance", 6))


@R.add(f"""WITH {SQL_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, p_size % 4 ORDER BY score DESC, object_id) <= 2 AS reserved FROM ranked WHERE query_id IN ('q2', 'q3'))
SELECT query_id, object_id, 3 AS relevance, 'gold' AS status FROM ranked WHERE query_id IN ('q0', 'q1') AND p_size = 7
UNION ALL SELECT query_id, object_id, NULL, 'pending' FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, score DESC, object_id) <= 12""")
def qry17_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir)
    k = F.substring("query_id", 2, 9).cast("int")
    questions = rows.select("query_id").distinct().withColumn("kind", F.when(k < 2, "rule").when(k < 4, "pooled").otherwise("boundary"))
    return retrieval.built_dataset(questions, rows.where("p_size = 7"), rows.select("query_id", "object_id", (F.col("p_size") % 4).alias("leg"), "score"))


# --- streams, as they are over a table at rest -------------------------------------------------------------------------


@R.add("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stm2_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.event_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("total", F.round("total", 6))


@R.add("""WITH o AS (SELECT user_id, ts, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS new FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN coalesce(new, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, s""")
def stm6_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@R.add("""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY event_id ORDER BY event_id) AS n FROM (SELECT user_id, event_id FROM events UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 5 = 0)) SELECT user_id, count(*) AS n FROM t WHERE n = 1 GROUP BY user_id""")
def stm5_once_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.unionByName(e.where("event_id % 5 = 0")).dropDuplicates(["event_id"]).groupBy("user_id").agg(F.count("*").alias("n"))


R.queries |= {"smp10_repaired": smp10_repaired}
