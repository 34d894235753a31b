"""Queries that run as streams or through the versioned log, over files that the tables land as; what comes out is held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import answer_loop, policies, ranking
from quillspark.sources.shared import landing
from quillspark.sources.versioned import Log
from quillspark.streaming import jobs, streams

from .evaluation_queries import R as EVALUATION
from .tables import Registry, table

R = Registry()
#: Files that the events land as, in order of time; a stream is stopped after half of them.
PARTS = 8


def _land(rows: DataFrame, path: str, which: str) -> None:
    rows.where(which).repartition("part").sortWithinPartitions("ts").drop("part").write.mode("append").parquet(path)


def _parts(events: DataFrame) -> DataFrame:
    """``part``: the eighth of the time in which an event falls."""
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    share = (F.col("ts").cast("double") - F.col("a").cast("double")) / F.greatest(F.col("b").cast("double") - F.col("a").cast("double"), F.lit(1.0))
    return events.join(F.broadcast(span)).withColumn("part", F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")).drop("a", "b")


@R.add(EVALUATION.oracles["stm3_job_state"])
def stm3_streamed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-3: the state of each job from a stream of its events, stopped half-way and started again."""
    root, v = landing(spark), F.col("value")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("step"), F.col("event_id").alias("id"), F.when(v > 50, "done").when(v > 10, "running").otherwise("failed").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    parts = _parts(events)
    for which in (f"part < {PARTS // 2}", f"part >= {PARTS // 2}"):
        _land(parts, f"{root}/in", which)
        stream = streams.events(spark, f"{root}/in", events.schema)
        jobs.appended(jobs.job_changes(stream, late="40 days"), f"{root}/out", f"{root}/checkpoint")
    return jobs.now(spark.read.parquet(f"{root}/out"))


@R.add("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def stm5_streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-1, STM-5: events appended once each from files with repeated rows, stopped half-way and started again."""
    root = landing(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    parts = _parts(events)
    again = parts.where("event_id % 5 = 0").withColumn("part", F.least(F.col("part") + 1, F.lit(PARTS - 1)))
    for which in (f"part < {PARTS // 2}", f"part >= {PARTS // 2}"):
        _land(parts.unionByName(again), f"{root}/in", which)
        streams.appended_once(streams.events(spark, f"{root}/in", events.schema), "event_id", f"{root}/out", f"{root}/checkpoint", late="40 days")
    return spark.read.parquet(f"{root}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@R.add("""WITH e AS (SELECT event_id, user_id, event_id % 4 AS b FROM events),
a AS (SELECT user_id, count(*) AS n FROM e WHERE b = 0 GROUP BY user_id),
s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM e WHERE b = 1)
SELECT event_id AS arrival, 'first' AS writer, 'accepted' AS status FROM e WHERE b IN (0, 2)
UNION ALL SELECT event_id, 'second', CASE WHEN n IS NULL THEN 'accepted' ELSE 'conflict' END FROM s LEFT JOIN a USING (user_id)""")
def win11_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: two writers race; the second one's batch, judged again after the first one's commit, conflicts; batches that are played again change nothing."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("request_id"))
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("request_id")).cast("long")
    log = Log(spark, landing(spark), "query_id long, revision long, request_id long", ["query_id"])
    first, stale, later = (e.where(f"request_id % 4 = {k}").withColumn("revision", turn).withColumn("arrival", F.col("request_id")) for k in range(3))
    log.append(stale, "second", 0, before_commit=lambda: log.append(first, "first", 0))
    last = log.rows().groupBy("query_id").agg(F.max("revision").alias("last"))
    later = later.join(last, "query_id", "left").withColumn("revision", F.col("revision") + F.coalesce("last", F.lit(0))).drop("last")
    log.append(later, "first", 1)
    log.append(stale, "second", 0)
    log.append(first, "first", 0)
    return log.judged().select("arrival", "writer", "status")


def smp4_starters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP-4: five starters for each language among the long documents; packs are what their text is made of."""
    d = table(spark, sf_dir, "documents").where("n_chars > 800")
    packs = F.array_compact(F.array(F.when(F.col("text").contains("<"), "markup"), F.when(F.col("text").contains("\n"), "lines"), F.when(F.col("text").rlike("[0-9]"), "numbers"), F.when(F.col("text").contains("@"), "mail"), F.concat(F.lit("size"), F.floor(F.log10("n_chars")))))
    return ranking.starters(d.select("lang", "doc_id", packs.alias("packs"), "source", F.size(F.split("text", "\n")).alias("lines")), "lang", "doc_id", "packs", "source", "lines")


def str8_policy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8: the opening of every document, and of every item told without its second word, met with those of benchmark items: of their texts (cards) and of their second sentences (regressions)."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    kinds = F.explode(F.array(F.struct(F.lit("question_card").alias("source"), F.substring("text", 1, 60).alias("question")), F.struct(F.lit("regression").alias("source"), F.substring(F.try_element_at(F.split("text", "[.] ", 2), F.lit(2)), 1, 60).alias("question"))))
    known = b.select("item_id", kinds.alias("k")).select(F.concat_ws("-", "k.source", "item_id").alias("policy_id"), "k.question", "k.source", F.col("item_id").cast("string").alias("place"))
    retold = b.select(F.concat(F.lit("item-"), "item_id").alias("query_id"), F.substring(F.regexp_replace("text", r"^(\S+) \S+", "$1"), 1, 58).alias("question"))
    asked = d.select(F.concat(F.lit("doc-"), "doc_id").alias("query_id"), F.substring("text", 1, 60).alias("question")).unionByName(retold)
    return policies.matched(asked, known.where("question IS NOT NULL"))


def qry20_answer_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QRY-20: a question for each user, answered from the user's own events, then from those of the next user."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.array("event_type").alias("legs"), "props")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "object_id"))

    def pool(who: F.Column, wanted: DataFrame | None = None) -> DataFrame:
        own = e.select(who.alias("query_id"), F.col("event_id").alias("object_id"), "value", "legs", F.when(F.col("event_id") % 3 == 0, F.repeat("props", 6)).otherwise(F.col("props")).alias("text"))
        own = own if wanted is None else own.join(wanted.select("query_id"), "query_id", "left_semi")
        return own.withColumn("rank", rank.cast("long")).drop("value")

    questions = e.select(F.col("user_id").alias("query_id")).distinct().select("query_id", (5 + F.col("query_id") % 4).cast("int").alias("count"), F.when(F.col("query_id") % 3 == 0, F.array(F.lit("signup"), F.lit("error"))).otherwise(F.array(F.lit("purchase"))).alias("required"))
    judge = lambda shown: shown.select("query_id", "object_id", (F.col("object_id") % 7 == 0).alias("accepted"), (F.col("object_id") % 100 / 100.0).alias("score"))
    expand = lambda ready: pool(F.col("user_id") - 1, ready)
    states, accepted = answer_loop.answered(questions, pool(F.col("user_id")), judge, expand)
    ids = accepted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "object_id"))), lambda x: x["object_id"]).alias("ids"))
    return states.join(ids, "query_id", "left").select("query_id", "status", "accepted", F.array_join("missing", ",").alias("missing"), "rounds", "expanded", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("object_ids"))


R.queries |= {f.__name__: f for f in (smp4_starters, str8_policy_match, qry20_answer_loop)}
