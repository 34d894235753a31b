"""Queries of filters, ranking and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import filters, ranking

from .tables import Registry, table

R = Registry()
# Names of the same region or culture.
CLASSES = (("europe", "european"), ("asia", "asian"), ("america", "the americas", "american"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as objects: brand the institution, name the material, size the year (before 10: missing start)."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("institution"), F.col("p_name").alias("material"), F.concat_ws("; ", "p_type", "p_brand").alias("kind"), F.when(size >= 10, size * 10).alias("date_earliest"), (size * 10 + 35).alias("date_latest"), F.when(size % 3 == 0, "").otherwise("u").alias("image_url"), F.when(size % 2 == 0, "full").otherwise("thin").alias("evidence_depth"))


SQL_OBJ = """
obj AS (SELECT p_partkey AS object_id, p_brand AS institution, p_name AS material, concat_ws('; ', p_type, p_brand) AS kind,
  CASE WHEN p_size >= 10 THEN p_size * 10 END AS date_earliest, p_size * 10 + 35 AS date_latest,
  CASE WHEN p_size % 3 = 0 THEN '' ELSE 'u' END AS image_url, CASE WHEN p_size % 2 = 0 THEN 'full' ELSE 'thin' END AS evidence_depth FROM part)
"""


def _facets(objects: DataFrame) -> DataFrame:
    return filters.facet_values(objects, "object_id", {"institution": ["institution"], "material": ["material"], "object_type": ["kind"]})


@R.add(f"""WITH {SQL_OBJ}, v AS (
  SELECT object_id, 'institution' AS facet, trim(institution) AS v FROM obj UNION ALL SELECT object_id, 'material', trim(material) FROM obj UNION ALL SELECT object_id, 'object_type', trim(kind) FROM obj),
f AS (SELECT object_id, facet, unnest([v, replace(v, '_', ' ')] || regexp_split_to_array(v, '\\s*(?:[;,；，|]|\\s/\\s)\\s*')) AS x,
             unnest(range(2 + len(regexp_split_to_array(v, '\\s*(?:[;,；，|]|\\s/\\s)\\s*')))) AS p FROM v)
SELECT object_id, facet, lower(trim(x)) AS value_norm, arg_min(x, p) AS value_display FROM f WHERE trim(x) <> '' GROUP BY ALL""")
def prj6_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facets(_objects(spark, sf_dir))


@R.add(f"WITH {SQL_OBJ} SELECT object_id FROM obj WHERE date_latest >= 200 AND date_earliest <= 300")
def flt2_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).where(filters.overlaps(F.col("date_earliest"), F.col("date_latest"), 200, 300)).select("object_id")


@R.add(f"WITH {SQL_OBJ} SELECT object_id FROM obj WHERE lower(institution) IN (SELECT lower(min(p_brand)) FROM part UNION ALL SELECT lower(max(p_brand)) FROM part)")
def flt3_facet_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    brands = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).select(F.explode(F.array("a", "b")).alias("b")).select(F.lower("b").alias("value_norm")).distinct()
    return o.join(_facets(o).where("facet = 'institution'").join(brands, "value_norm", "left_semi"), "object_id", "left_semi").select("object_id")


@R.add(f"WITH {SQL_OBJ} SELECT object_id FROM obj WHERE (' ' || trim(regexp_replace(lower(material), '[^\\w]+', ' ', 'g')) || ' ') LIKE '% ring %'")
def flt4_phrase_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).where(T.contains_phrase(F.col("material"), F.lit("ring"))).select("object_id")


@R.add("""SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) IN ('europe', 'european', 'america', 'the americas', 'american')""")
def flt5_equivalent_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.where(F.lower("r_name").isin(*filters.expanded(("european", "American"), CLASSES))).select("n_nationkey")


@R.add(f"""WITH {SQL_OBJ} SELECT object_id FROM obj WHERE date_latest >= 150 AND date_earliest <= 400 AND image_url <> '' AND evidence_depth = 'full'
AND (' ' || trim(regexp_replace(lower(material), '[^\\w]+', ' ', 'g')) || ' ') LIKE '% bolt %' ORDER BY object_id""")
def flt1_filter_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    spec = filters.parsed({"date_start": 150, "date_end": 400, "materials": ["bolt"], "image_required": True, "evidence_depth": ["full"]})
    return filters.matching_ids(o, _facets(o), spec, "object_id")


@R.add(f"WITH {SQL_OBJ} SELECT object_id FROM obj WHERE image_url <> '' AND evidence_depth IN ('full')")
def flt6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    return filters.matching(o, _facets(o), filters.FilterSpec(image_required=True, evidence_depth=("full",)), "object_id").select("object_id")


@R.add(f"WITH {SQL_OBJ}, f AS (SELECT object_id FROM obj WHERE date_latest >= 500 AND date_earliest <= 520) SELECT object_id, CAST(0.01 AS DOUBLE) AS score FROM f WHERE (SELECT count(*) FROM f) <= 100000")
def flt9_small_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _objects(spark, sf_dir)
    return filters.small_pool(o.where(filters.overlaps(F.col("date_earliest"), F.col("date_latest"), 500, 520)), "object_id", 100_000)


@R.add("SELECT vec_id FROM embeddings WHERE embedding[1] >= 0.1")
def flt16_score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("embedding")[0] >= F.lit(0.1).cast("float")).select("vec_id")


@R.add("""WITH c AS (SELECT count(*) FILTER (p_size > 49) AS n FROM part) SELECT p_partkey FROM part, c WHERE CASE WHEN n >= 5 THEN p_size > 49 ELSE p_size > 40 END""")
def flt18_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.widened(table(spark, sf_dir, "part"), F.col("p_size") > 49, F.col("p_size") > 40, 5).select("p_partkey")


@R.add("""SELECT unnest(['has_text', 'long_enough', 'english']) AS "check", unnest([count(*) FILTER (NOT coalesce(text <> '', false)), count(*) FILTER (NOT coalesce(n_chars >= 400, false)), count(*) FILTER (NOT coalesce(lang = 'en', false))]) AS violations FROM documents""")
def flt19_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.Gates({"has_text": F.col("text") != "", "long_enough": F.col("n_chars") >= 400, "english": F.col("lang") == "en"}).violations(table(spark, sf_dir, "documents"))


@R.add("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100")
def flt21_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O")).orderBy("o_orderkey").limit(100).select("o_orderkey")


@R.add("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1')")
def flt22_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.lower("c_name").contains("1")).select("c_custkey")


@R.add(f"WITH {SQL_OBJ} SELECT object_id, least(coalesce(date_earliest, date_latest), coalesce(date_latest, date_earliest)) AS earliest, greatest(coalesce(date_earliest, date_latest), coalesce(date_latest, date_earliest)) AS latest FROM obj")
def prj7_repaired_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(spark, sf_dir).select("object_id", V.repaired_dates(F.col("date_earliest"), F.col("date_latest")).alias("d")).select("object_id", "d.*")


@R.add("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def win3_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@R.add("""WITH s AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS place, max(score) OVER (PARTITION BY user_id) AS best FROM s)
SELECT user_id, event_type, score, place FROM p WHERE place <= 3 AND score >= 0.5 * best""")
def win5_near_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("score"))
    return ranking.near_best(s, "user_id", "event_type", 3, 0.5)


@R.add("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer ORDER BY turn, c_nationkey LIMIT 120")
def win6_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.round_robin(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 120).drop("c_acctbal")


@R.add("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS turn FROM lineitem ORDER BY turn, l_returnflag, l_linestatus LIMIT 200")
def win7_stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return ranking.round_robin(rows, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"], 200)


@R.add("""WITH s AS (SELECT c_nationkey, count(*) AS available FROM customer GROUP BY c_nationkey),
r AS (SELECT c_nationkey, available, unnest(range(1, available + 1)) AS turn FROM s),
d AS (SELECT c_nationkey FROM r ORDER BY turn, c_nationkey LIMIT 700)
SELECT c_nationkey, available, (SELECT count(*) FROM d WHERE d.c_nationkey = s.c_nationkey) AS quota FROM s""")
def smp1_water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("available"))
    return ranking.water_fill(sizes, "c_nationkey", 700)


@R.add("""WITH s AS (SELECT p_brand, count(*) AS total, least(count(*), 13) AS wanted FROM part GROUP BY p_brand)
SELECT p_brand, CAST(CASE WHEN wanted < 2 THEN 1 ELSE 1 + round_even(i * (total - 1) / CAST(wanted - 1 AS DOUBLE), 0) END AS BIGINT) AS page FROM s, range(13) t(i) WHERE i < wanted""")
def smp2_spread_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-2: of each brand's pages, one for each part, 13 that are evenly spread."""
    sizes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("total"))
    return sizes.select("p_brand", F.explode(V.spread(F.col("total"), 13)).alias("page"))


@R.add("SELECT c_custkey, sha256('q1:' || c_custkey) AS digest FROM customer ORDER BY digest, c_custkey LIMIT 50")
def top6_stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stable_sample(table(spark, sf_dir, "customer").select("c_custkey"), "q1", "c_custkey", 50)


@R.add("""WITH few AS (SELECT p_partkey, CASE WHEN p_size > 15 THEN p_size END AS year, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 60),
c AS (SELECT count(year) >= greatest(3, ceil(0.6 * count(*))) AS dated FROM few)
SELECT p_partkey, year, rank, CAST(CASE WHEN dated THEN coalesce(year, 2147483647) ELSE rank END AS BIGINT) AS order_key FROM few, c""")
def top5_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(60)
    from pyspark.sql import Window

    few = p.select("p_partkey", F.when(F.col("p_size") > 15, F.col("p_size")).alias("year"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))
    return ranking.chronological(few, "year", "rank")


@R.add("SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 250")
def top4_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(250).select("p_partkey")


@R.add("""WITH r AS (SELECT 's' || (s_suppkey % 4) AS query_id, s_nationkey AS leg, s_suppkey AS object_id, s_acctbal AS score FROM supplier),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, object_id) <= 1 AS reserved FROM r)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, score DESC, object_id) AS place FROM p QUALIFY place <= 12""")
def smp8_reserved_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 4).alias("query_id"), F.col("s_nationkey").alias("leg"), F.col("s_suppkey").alias("object_id"), F.col("s_acctbal").alias("score"))
    return ranking.reserved_pool(s, "leg", 1, 12, "object_id")


@R.add("SELECT o_orderpriority, o_orderkey, CAST(ceil(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) / 500.0) AS BIGINT) AS shard FROM orders")
def qry19_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.shards(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 500)


@R.add("""SELECT 'q' AS query_id, n_nationkey, n_nationkey + 1 AS place, CASE WHEN n_nationkey < 9 THEN 1 WHEN n_nationkey < 17 THEN 2 ELSE 3 END AS chapter FROM nation""")
def mth5_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.lit("q").alias("query_id"), "n_nationkey")
    return ranking.chapters(n, "n_nationkey", V.chapter_sizes(25, 3))


def smp5_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection; SQL has no equivalent, tests compare it with a plain loop."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.concat(F.lit("q"), F.col("p_partkey") % 3).alias("query_id"), F.col("p_partkey").alias("object_id"), F.col("p_retailprice").alias("score"), F.split("p_type", " ").alias("features"), F.col("p_brand").alias("origin"), F.array(F.concat(F.lit("k"), F.col("p_size") % 4)).alias("packs"), F.col("p_brand").alias("institution"), T.title_family(F.col("p_name")).alias("family"))
    return ranking.diverse(rows, 12, "object_id")


def smp3_themed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy selection with costs; SQL has no equivalent, tests compare it with a plain loop."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("theme"), F.col("p_partkey").alias("object_id"), (F.col("p_retailprice") / 10).alias("score"), F.col("p_type").alias("kind"), (F.col("p_size") % 5).alias("band"), (F.col("p_partkey") == 7).alias("pinned"))
    return ranking.themed(p, "theme", 8, "object_id", "kind", "band", 2)


R.queries |= {"smp5_diverse": smp5_diverse, "smp3_themed": smp3_themed}
