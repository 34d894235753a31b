"""Questions met with known ones: a similarity join that compares few pairs (STR-8, CLS-8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.dense import in_blocks
from quillspark.sources.shared import kept

# Shares of the two parts of the similarity, and the scores that count as the same question.
SEQUENCE_SHARE, PAIRS_SHARE = 0.65, 0.35
THRESHOLDS = {"question_card": 0.72, "regression": 0.9}
_SLACK = 1e-9
#: Words of 64 bits in which a set of pairs of characters is marked.
WORDS = 4
#: Hashes of pairs of characters whose counts say which pairs are rare.
BUCKETS = 4_096


def _profile(rows: DataFrame, text: str) -> DataFrame:
    """Each distinct key, its pairs of characters, and how often it has each character, in order of the character."""
    key = T.question_key(F.col(text))
    # dealt by number: what follows is much larger than the keys, by whose size Spark would choose few tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(key.alias("key")).where("key <> ''").repartition(tasks, "key").distinct()
    letters = F.array_sort(F.filter(F.split("key", ""), lambda c: c != ""))
    own = own.withColumn("letters", letters).withColumn("pairs", F.array_distinct(T.grams(F.col("key"), 2)))
    # a repeated letter is told apart by its place among its like, so that sets of them overlap as the multisets do
    first = F.transform("letters", lambda c, i: F.concat(c, (i + 1 - F.array_position("letters", c)).cast("string")))
    # the pairs as bits: sets whose bits differ in d places differ in d pairs at least
    bits = [F.expr(f"aggregate(pairs, 0L, (a, p) -> CASE WHEN pmod(xxhash64(p), {64 * WORDS}) div 64 = {k} THEN a | shiftleft(1L, cast(pmod(xxhash64(p), 64) AS int)) ELSE a END)").alias(f"bits{k}") for k in range(WORDS)]
    return own.withColumn("letters", first).select("*", F.length("key").alias("size"), *bits)


def _bound(shared: Column, n_left: Column, n_right: Column, left: Column, right: Column, share_of_letters: Column) -> Column:
    """No pair can be more alike: ``shared`` pairs of characters, and letters in common whatever their order."""
    union = n_left + n_right - shared
    return SEQUENCE_SHARE * 2.0 * share_of_letters / (left + right) + PAIRS_SHARE * F.when(union > 0, shared / union).otherwise(0.0)


def candidates(questions: DataFrame, policies: DataFrame, least: float, text: str = "question") -> DataFrame:
    """``(x, y)``: every pair of different keys of a question and a policy whose similarity can reach ``least``, and few others.

    Policies are a catalogue, some hundreds; questions may be as many as there are. Equal questions are one. The matching-blocks ratio is 1 at most, so the pairs of characters must be alike to
    (least - 0.65) / 0.35 at least; with a positive bound two such sets share one of their rarest pairs
    (a prefix of each, rarest first). Lengths, marks of the pairs in a few words, shared pairs and shared letters then bound the similarity from above.
    """
    alike = (least - SEQUENCE_SHARE) / PAIRS_SHARE
    if alike <= 0:
        raise ValueError("a similarity of 0.65 or less is possible without a common pair of characters")
    q, p = kept(_profile(questions, text)), kept(_profile(policies, text))
    # any order of the pairs will do if it is the same on both sides: rare ones first, by the counts of a hash
    place = lambda pair: F.pmod(F.hash(pair), F.lit(BUCKETS)).cast("int")
    counts = p.select(F.explode("pairs").alias("pair")).groupBy(place(F.col("pair")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    weights = F.broadcast(counts.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("weights")))

    def prefixed(rows: DataFrame) -> DataFrame:
        """The rarest pairs of each key: as many as two sets with that likeness can't both miss. Each row by itself, without a shuffle."""
        n = F.size("pairs")
        ordered = F.array_sort(F.transform("pairs", lambda x: F.struct(F.get("weights", place(x)).alias("w"), x.alias("pair"))))
        few = F.slice(ordered, F.lit(1), (n - F.ceil(F.lit(alike) * n - _SLACK) + 1).cast("int"))["pair"]
        return rows.crossJoin(weights).select("key", n.alias("n_pairs"), F.col("size").alias("n_chars"), *(f"bits{k}" for k in range(WORDS)), few.alias("few")).withColumn("pair", F.explode("few")).drop("few")

    a = prefixed(q).select(F.col("key").alias("x"), "pair", F.col("n_pairs").alias("na"), F.col("n_chars").alias("la"), *(F.col(f"bits{k}").alias(f"a{k}") for k in range(WORDS)))
    of_policies = lambda few: prefixed(few).select(F.col("key").alias("y"), "pair", F.col("n_pairs").alias("nb"), F.col("n_chars").alias("lb"), *(F.col(f"bits{k}").alias(f"b{k}") for k in range(WORDS)))
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(WORDS)))
    common = F.least("na", "nb", F.floor((F.col("na") + F.col("nb") - apart) / 2))
    longest = _bound(common, F.col("na"), F.col("nb"), F.col("la"), F.col("lb"), F.least("la", "lb"))
    # a pair that many questions have would be one task's: blocks of the policies are sent to the questions instead
    met = in_blocks(p, "key", lambda few: a.join(F.broadcast(of_policies(few)), "pair").where((longest >= least - _SLACK) & (F.col("x") != F.col("y"))).select("x", "y")).distinct()
    pairs = met.join(q.select(F.col("key").alias("x"), F.col("pairs").alias("px"), F.col("letters").alias("lx")), "x").join(p.select(F.col("key").alias("y"), F.col("pairs").alias("py"), F.col("letters").alias("ly")), "y")
    sizes = (F.size("px"), F.size("py"), F.size("lx"), F.size("ly"))
    counted = pairs.withColumn("shared", F.size(F.array_intersect("px", "py"))).where(_bound(F.col("shared"), *sizes, F.least(*sizes[2:])) >= least - _SLACK)
    letters = F.size(F.array_intersect("lx", "ly"))
    return counted.where(_bound(F.col("shared"), *sizes, letters) >= least - _SLACK).select("x", "y")


def matched(questions: DataFrame, policies: DataFrame, question_id: str = "query_id", text: str = "question") -> DataFrame:
    """``(query_id, policy_id, source, score)``: the policy that a question meets, if any.

    ``policies``: (policy_id, question, source, place). An equal question comes first, cards before regressions; then the
    most alike card if alike enough; then the most alike regression. Among equals the first in ``place``, then id.
    """
    asked = questions.select(question_id, T.question_key(F.col(text)).alias("x"))
    known = policies.select("policy_id", "source", "place", text, T.question_key(F.col(text)).alias("y"))
    kinds = list(THRESHOLDS)
    turn = F.create_map(*(F.lit(v) for k, s in enumerate(kinds) for v in (s, k)))
    found = asked.join(known.where(F.col("source").isin(*kinds)), F.col("x") == F.col("y")).select(question_id, "policy_id", "source", "place", F.lit(1.0).alias("score"), F.try_element_at(turn, F.col("source")).alias("turn"))
    for k, source in enumerate(kinds):
        own = known.where(F.col("source") == source)
        alike = kept(candidates(asked.select(F.col("x").alias(text)), own.select(F.col("y").alias(text)), THRESHOLDS[source], text=text))
        scored = alike.withColumn("score", T.question_similarity(F.col("x"), F.col("y"))).where(F.col("score") >= THRESHOLDS[source])
        found = found.unionByName(asked.join(scored, "x").join(own.select("policy_id", "source", "place", "y"), "y").select(question_id, "policy_id", "source", "place", "score", F.lit(len(kinds) + k).alias("turn")))
    order = F.struct(F.col("turn"), (-F.col("score")).alias("s"), F.col("place"), F.col("policy_id"))
    best = found.groupBy(question_id).agg(F.min_by(F.struct("policy_id", "source", "score"), order).alias("b"))
    return best.select(question_id, "b.policy_id", "b.source", F.round("b.score", 6).alias("score"))
