"""The answer loop against one question at a time in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import answer_loop as A
from quillspark.plans import stream_queries


def plain(count, required, pool, judge, more, configured=A.MOST_WINDOW):
    """pool, more: lists of (object, rank, legs, text)."""
    window = min(max(4 * count, 20), configured, 32)
    left, seen, accepted, number, last, expanded = list(pool), set(), [], 0, 0, False

    def missing():
        held = {leg for _, _, legs, _, _ in accepted for leg in legs}
        return [x for x in required if x not in held]

    while len(accepted) < count or missing():
        open_legs = set(missing())
        rows = [r for r in left if r[0] not in seen]
        if not rows:
            if expanded or more is None:
                break
            expanded = True
            behind = max((r[1] for r in left), default=0)
            have = {r[0] for r in left}
            left += [(o, k + behind, legs, t) for o, k, legs, t in more if o not in have]
            number += 1
            continue
        rows.sort(key=lambda r: (*((not (open_legs & set(r[2])), len(r[3] or "") < 40) if number else ()), r[1], r[0]))
        for o, k, legs, _ in rows[:window]:
            seen.add(o)
            if judge(o):
                accepted.append((o, k, legs, number, o % 100 / 100))
        number += 1
        last = number
    order = [o for o, k, _, n, s in sorted(accepted, key=lambda a: (a[3], -a[4], a[1], a[0]))]
    status = "supported" if len(accepted) >= count and not missing() else "partial" if accepted else "unsupported"
    return status, len(accepted), ",".join(sorted(missing())), last, expanded, order


@pytest.mark.parametrize("with_more", [True, False])
def test_loop_equals_one_question_at_a_time(spark, with_more):
    r = random.Random(5)
    questions = [(f"q{i}", r.randint(1, 8), r.choice([None, [], ["a"], ["a", "b"], ["z"]])) for i in range(40)]
    make = lambda n, first: [(first + k, k + 1, r.sample("abc", r.randint(0, 2)), r.choice([None, "short", "x" * 50])) for k in range(n)]
    pool = {q: make(r.choice([0, 3, 25, 90]), 0) for q, _, _ in questions}
    more = {q: make(r.choice([0, 10, 40]), 80) for q, _, _ in questions}
    flat = lambda rows: spark.createDataFrame([(q, *x) for q, xs in rows.items() for x in xs], "query_id string, object_id long, rank long, legs array<string>, text string")
    ok = {q: r.choice([2, 5, 11, 1000]) for q, _, _ in questions}
    share = spark.createDataFrame(list(ok.items()), "query_id string, m long")
    judge = lambda shown: shown.join(F.broadcast(share), "query_id").select("query_id", "object_id", (F.col("object_id") % F.col("m") == 1).alias("accepted"), (F.col("object_id") % 100 / 100.0).alias("score"))
    extra = flat(more)
    expand = (lambda ready: extra.join(ready.select("query_id"), "query_id", "left_semi")) if with_more else None
    states, accepted = A.answered(spark.createDataFrame(questions, "query_id string, count int, required array<string>"), flat(pool), judge, expand)
    got = {s.query_id: (s.status, s.accepted, ",".join(s.missing), s.rounds, s.expanded) for s in states.collect()}
    order = {}
    for a in sorted(accepted.collect(), key=lambda a: a.place):
        order.setdefault(a.query_id, []).append(a.object_id)
    for q, count, required in questions:
        want = plain(count, required or [], pool[q], lambda o, q=q: o % ok[q] == 1, more[q] if with_more else None)
        assert (*got[q], order.get(q, [])) == want, q
    assert {x[0] for x in got.values()} == {"supported", "partial", "unsupported"} and max(x[3] for x in got.values()) > 2


def test_loop_over_the_events(spark, sf_dir):
    rows = stream_queries.qry20_answer_loop(spark, sf_dir).collect()
    assert len(rows) >= 10 and {r.status for r in rows} & {"supported", "partial"}
    own = {r.event_id: r.user_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    for r in rows:
        ids = [int(x) for x in r.object_ids.split(",") if x]
        assert len(ids) == r.accepted and all(i % 7 == 0 and own[i] - r.query_id in (0, 1) for i in ids)
        assert r.expanded or all(own[i] == r.query_id for i in ids)


def test_no_questions(spark):
    none = spark.createDataFrame([], "query_id string, count int, required array<string>")
    pool = spark.createDataFrame([("q", 1, 1, ["a"], "t")], "query_id string, object_id long, rank long, legs array<string>, text string")
    states, accepted = A.answered(none, pool, lambda s: s.select("query_id", "object_id", F.lit(True).alias("accepted"), F.lit(1.0).alias("score")))
    assert states.collect() == [] and accepted.collect() == []


def shuffled_rows(spark):
    """Rows that all stages so far wrote for a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_rounds_do_not_move_the_pool(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 4_000, raising=False)
    sizes = {q: (15, 50, 170)[q % 3] for q in range(100)}
    pool = [(q, k, k + 1, ["a"] if k % 3 else [], "x" * (k % 60)) for q, n in sizes.items() for k in range(n)]
    schema = "query_id long, object_id long, rank long, legs array<string>, text string"
    questions = spark.createDataFrame([(q, 3, ["a"] if q % 2 else ["b"]) for q in sizes], "query_id long, count int, required array<string>")
    judge = lambda shown: shown.select("query_id", "object_id", (F.col("object_id") % 40 == 1).alias("accepted"), (F.col("object_id") / 1000.0).alias("score"))
    asked = []

    def expand(ready):
        asked.append(ready)
        return ready.select("query_id", F.explode(F.sequence(F.lit(165).cast("long"), F.lit(205).cast("long"))).alias("object_id"), F.lit(7).alias("rank"), F.array(F.lit("b")).alias("legs"), F.lit(None).cast("string").alias("text"))

    before = shuffled_rows(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        states, accepted = A.answered(questions, spark.createDataFrame(pool, schema), judge, expand)
        moved = sum(n for k, n in shuffled_rows(spark).items() if k not in before)
        got = {s.query_id: (s.status, s.accepted, ",".join(s.missing), s.rounds, s.expanded) for s in states.collect()}
        order = {}
        for a in sorted(accepted.collect(), key=lambda a: a.place):
            order.setdefault(a.query_id, []).append(a.object_id)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # both pools are dealt once (the first one for the join with the questions too), not once or more in each of some ten rounds
    assert 0 < moved <= 3 * len(pool)
    for q in sizes:
        more = [(k, 7, ["b"], None) for k in range(165, 206)]
        assert (*got[q], order.get(q, [])) == plain(3, ["a"] if q % 2 else ["b"], [r[1:] for r in pool if r[0] == q], lambda o: o % 40 == 1, more), q
    assert max(x[3] for x in got.values()) > 8 and len(asked) == 1
