"""Streams with restarts and timers, the versioned log with two writers, starter choice, question policies, longest-match conversion."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import policies, ranking
from quillspark.plans import stream_queries
from quillspark.sources.versioned import Log
from quillspark.streaming import jobs, streams

STEPS = "job_id long, step string, id long, status string, ts timestamp"


def test_job_timers(spark, tmp_path):
    """Day by day: job 1 ends, job 2 stalls and is overdue, job 3 goes on after a stall."""
    at = lambda day: f"2024-01-{day:02d} 00:00:00"
    files = [
        [(1, "a", 1, "running", at(1)), (2, "a", 2, "running", at(1)), (3, "a", 3, "running", at(1)), (2, "b", 4, "done", at(1))],
        [(1, "a", 5, "done", at(2)), (9, "x", 6, "running", at(6))],
        [(3, "a", 7, "failed", at(7)), (3, "a", 6, "running", at(8)), (9, "x", 8, "running", at(7))],
        [(9, "x", 9, "running", at(20))],
        [(9, "x", 10, "done", at(21))],
    ]
    for rows in files:
        spark.createDataFrame([(j, s, i, st, t) for j, s, i, st, t in rows], "job_id long, step string, id long, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.events(spark, f"{tmp_path}/in", STEPS)
        jobs.appended(jobs.job_changes(stream, stall="2 days", deadline="10 days", late="0 seconds"), f"{tmp_path}/out", f"{tmp_path}/check")
    out = spark.read.parquet(f"{tmp_path}/out")
    events = {(r.job_id, r.event) for r in out.where("event <> 'changed'").collect()}
    assert {(2, "stalled"), (3, "stalled"), (2, "overdue")} <= events and not any(j == 1 for j, _ in events)
    state = {r.job_id: (r.steps, r.settled, r.failed) for r in jobs.now(out).collect()}
    assert state[1] == (1, 1, False) and state[2] == (2, 1, False) and state[3] == (1, 1, True)


def test_stream_equals_batch_once_and_is_idempotent(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 9).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("ts"))
    for part in (rows.where("event_id < 200"), rows.where("event_id >= 150 AND event_id < 400"), rows.where("event_id < 10 OR event_id >= 300")):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            streams.appended_once(streams.events(spark, f"{tmp_path}/in", rows.schema), "event_id", f"{tmp_path}/out", f"{tmp_path}/check", late="2 days")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 500 and got.select("event_id").distinct().count() == 500


SCHEMA = "query_id string, revision long, request_id string, note string"


def _batch(spark, *rows):
    return spark.createDataFrame([(q, r, i, n, k) for k, (q, r, i, n) in enumerate(rows)], SCHEMA + ", arrival long")


def test_two_writers_and_replay(spark, tmp_path):
    log = Log(spark, str(tmp_path), SCHEMA, ["query_id"])
    assert log.append(_batch(spark, ("q1", 1, "a", "x"), ("q2", 1, "b", "x"), ("q1", 1, "c", "stale"), ("q2", 2, "a", "used")), "w1", 0) == 1
    other = Log(spark, str(tmp_path), SCHEMA, ["query_id"])
    mine = _batch(spark, ("q1", 2, "d", "mine"), ("q3", 1, "e", "mine"))
    version = log.append(mine, "w1", 1, before_commit=lambda: other.append(_batch(spark, ("q1", 2, "f", "theirs")), "w2", 0))
    assert version == 3 and [c["version"] for c in log.commits()] == [1, 2, 3]
    status = {r.request_id: (r.status, r.writer) for r in log.judged().where("request_id <> 'a'").collect()}
    assert status == {"b": ("accepted", "w1"), "c": ("conflict", "w1"), "d": ("conflict", "w1"), "e": ("accepted", "w1"), "f": ("accepted", "w2")}
    assert log.judged().where("request_id = 'a' AND status = 'duplicate'").count() == 1
    before = sorted(map(str, log.judged().collect()))
    assert log.append(mine, "w1", 1) == 3 and other.append(mine, "w2", 0) == 2  # known batches, whatever they hold now
    assert sorted(map(str, log.judged().collect())) == before
    per_key = log.rows().groupBy("query_id").agg(F.sort_array(F.collect_list("revision")).alias("r")).collect()
    assert {r.query_id: r.r for r in per_key} == {"q1": [1, 2], "q2": [1], "q3": [1]}


def test_log_follows_a_stream(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", SCHEMA, ["query_id"])
    for k in range(2):
        _batch(spark, (f"q{k}", 1, f"r{k}", None)).write.mode("append").parquet(f"{tmp_path}/in")
        log.follow(spark.readStream.schema(SCHEMA + ", arrival long").parquet(f"{tmp_path}/in"), "w", f"{tmp_path}/check")
    assert log.rows().count() == 2 and len(log.commits()) == 2


def test_starters_equal_a_plain_loop(spark):
    r = random.Random(8)
    rows = [(g, f"o{i}", [p for p in "pqrst" if r.random() < 0.3] or None, r.choice(["h1", "h2", "h3", None]), r.choice([None, 0, 1, 2, 5])) for i in range(300) for g in [r.choice("ABC")]]
    rows += [("D", "only", ["p", "p", None], None, 1), (None, "lost", ["p"], "h1", 1)]
    got = ranking.starters(spark.createDataFrame(rows, "g string, id string, packs array<string>, house string, ev int"), "g", "id", "packs", "house", "ev")
    want = []
    for g in "ABCD":
        left, seen, houses = [x for x in rows if x[0] == g], set(), set()
        for place in range(1, 6):
            if not left:
                break
            best = max(left, key=lambda x: (len({p for p in x[2] or [] if p} - seen), (x[3] or "") not in houses, x[4] or 0, x[1]))
            left.remove(best)
            seen |= {p for p in best[2] or [] if p}
            houses.add(best[3] or "")
            want.append((g, best[1], place))
    assert sorted(map(tuple, got.where("g IS NOT NULL").collect())) == sorted(want)


def test_starters_of_documents(spark, sf_dir):
    got = stream_queries.smp4_starters(spark, sf_dir).collect()
    assert {r.lang for r in got} >= {"en", "fr"} and all(1 <= r.place <= 5 for r in got) and len({r.doc_id for r in got}) == len(got)


def _key(s):
    return "".join(c for c in s.lower() if "a" <= c <= "z" or "0" <= c <= "9" or "㐀" <= c <= "鿿")


def _similar(x, y):
    if not x or not y:
        return 0.0
    a, b = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y))
    return 0.65 * SequenceMatcher(None, x, y).ratio() + 0.35 * (len(a & b) / len(a | b) if a | b else 0.0)


def _plain_match(questions, known):
    out = []
    kinds = [sorted((p for p in known if p[2] == s), key=lambda p: (p[3], p[0])) for s in ("question_card", "regression")]
    for q, text in questions:
        exact = next((p for ps in kinds for p in ps if _key(p[1]) == _key(text)), None)
        if exact:
            out.append((q, exact[0], exact[2], 1.0))
            continue
        for ps, least in zip(kinds, (0.72, 0.9), strict=True):
            scored = [(_similar(_key(text), _key(p[1])), p) for p in ps]
            best = max(scored, key=lambda x: x[0], default=(0, None))
            if best[0] >= least:
                out.append((q, best[1][0], best[1][2], round(best[0], 6)))
                break
    return sorted(out)


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(12)
    words = ["why", "bronze", "vessels", "shape", "trade", "routes", "silk", "glaze", "为什么", "青铜", "器物", "colour", "of", "the", "in", "empire", "river", "masks", "gold", "写字"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(3, 8))) for _ in range(150)]

    def changed(s):
        parts = s.split()
        k = r.randrange(len(parts))
        parts[k : k + 1] = r.choice([[], [parts[k] + "s"], [r.choice(words)], [parts[k], r.choice(words)]])
        return " ".join(parts).upper() if r.random() < 0.3 else " ".join(parts) + "?"

    known = [(f"p{i}", s, r.choice(["question_card", "regression"]), i % 40) for i, s in enumerate(base)] + [("empty", "?!", "question_card", 0), ("odd", "bronze", "other", 0), ("short", "a", "question_card", 3)]
    questions = [(f"q{i}", changed(r.choice(base)) if r.random() < 0.8 else r.choice(base)) for i in range(250)] + [("e", ""), ("x", "!!"), ("same", "bronze"), ("short", "A")]
    return questions, known


def test_policies_equal_all_pairs(spark, asked):
    questions, known = asked
    got = policies.matched(spark.createDataFrame(questions, "query_id string, question string"), spark.createDataFrame(known, "policy_id string, question string, source string, place long"))
    want, got = _plain_match(questions, known), got.collect()
    assert len(want) > 100 and sorted((r.query_id, r.policy_id, r.source) for r in got) == [w[:3] for w in want]
    assert {r.query_id: r.score for r in got} == pytest.approx({w[0]: w[3] for w in want}, abs=2e-6)


def test_few_pairs_of_the_tables_are_compared(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.explode(F.split("text", r"\n|(?<=\.) ")).alias("s")).select(F.substring("s", 1, 60).alias("question")).where(F.length("question") >= 30).distinct().limit(1500)
    keys = [(_key(r.question), r.question) for r in lines.collect()]
    known = spark.createDataFrame([(f"p{i}", q) for i, (_, q) in enumerate(keys[:150])], "policy_id string, question string")
    n = policies.candidates(lines, known, 0.72).count()
    assert n < 0.05 * len({k for k, _ in keys}) * len({k for k, _ in keys[:150]})


def test_conversion_takes_the_longest_phrase_once(spark):
    phrases = {"ab": "X", "abc": "bc", "bc": "Y", "頭髮": "头发", "髮頭": "?", "X": "never"}
    characters = {"a": "1", "b": "2", "頭": "头", "髮": "发", "c": "3", "-": "–"}
    texts = ["abcd", "aabc", "abab", "bcabc", "頭髮頭", "髮頭髮", "X-b]", "", None, "cab" * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.simplified(F.col("t"), phrases, characters).alias("s")).collect()
    assert [r.s for r in rows] == ["bcd", "1bc", "XX", "Ybc", "头发头", "?发", "never–2]", "", None, "3bcbcX"]
    assert T.converter({}, {})("abc") == "abc"
    assert spark.createDataFrame([("ab頭",)], "t string").select(T.simplified(F.col("t"), {}, characters).alias("s")).first().s == "12头"


def test_openings_of_documents_meet_items(spark, sf_dir):
    d, b = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    known = [x for r in b.collect() for x in ((f"question_card-{r.item_id}", r.text[:60], "question_card", str(r.item_id)), *([(f"regression-{r.item_id}", r.text.split(". ", 1)[1][:60], "regression", str(r.item_id))] if ". " in r.text else []))]
    import re

    retold = [(f"item-{r.item_id}", re.sub(r"^(\S+) \S+", r"\1", r.text)[:58]) for r in b.collect()]
    want = _plain_match([(f"doc-{r.doc_id}", (r.text or "")[:60]) for r in d.collect()] + retold, known)
    got = stream_queries.str8_policy_match(spark, sf_dir).collect()
    assert len(want) > 20 and sorted((r.query_id, r.policy_id) for r in got) == [w[:2] for w in want]
