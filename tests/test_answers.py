"""Questions, audits and set repair against plain loops and fixed cases."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import answers as A
from quillspark.operators import evaluation, evidence, search
from quillspark.plans import registry
from quillspark.sources import readers


def plain_repair(chosen, pool, wanted):
    room = list(chosen)
    cover = lambda rows: set().union(set(), *(wanted & set(r[1]) for r in rows))
    for c in pool:
        before = cover(room)
        if before == wanted:
            break
        if c[0] in {r[0] for r in room} or not (wanted & set(c[1])) - before:
            continue
        for k in range(len(room) - 1, -1, -1):
            trial = room[:k] + [c] + room[k + 1 :]
            if room[k][2] and not any(r[2] for r in trial):
                continue
            if len(cover(trial)) > len(before):
                room = trial
                break
    return [r[0] for r in room], cover(room) == wanted


def test_repaired_sets_equal_a_plain_loop(spark):
    r = random.Random(4)
    chosen, pool, need, want = [], [], [], {}
    for q in range(30):
        rows = [(i, [str(r.randint(0, 6)) for _ in range(2)], r.random() < 0.3) for i in range(20)]
        wanted = {str(x) for x in r.sample(range(7), 4)}
        chosen += [(f"q{q}", i, k + 1, legs, full) for k, (i, legs, full) in enumerate(rows[:4])]
        pool += [(f"q{q}", i, k + 1, legs, full) for k, (i, legs, full) in enumerate(rows[4:])]
        need.append((f"q{q}", sorted(wanted)))
        want[f"q{q}"] = plain_repair(rows[:4], rows[4:], wanted)
    rows = "query_id string, object_id long, {} int, legs array<string>, full boolean"
    got = A.repaired(spark.createDataFrame(chosen, rows.format("place")), spark.createDataFrame(pool, rows.format("rank")), spark.createDataFrame(need, "query_id string, legs array<string>")).collect()
    by = {}
    for x in sorted(got, key=lambda x: x.place):
        by.setdefault(x.query_id, ([], []))[0].append(x.object_id)
        by[x.query_id][1].append(x.complete)
    assert {q: (ids, done[0]) for q, (ids, done) in by.items()} == want
    assert sum(done for _, done in want.values()) > 5


def test_registered_repair_has_a_full_room(spark, sf_dir):
    rows = registry.QUERIES["smp10_repaired"](spark, sf_dir).collect()
    assert {r.query_id for r in rows} == {f"q{k}" for k in range(6)} and all(sum(x.query_id == r.query_id for x in rows) == 5 for r in rows)


def test_numerals():
    cases = {"一二": 12, "兩": 2, "两百": 200, "十": 10, "十二": 12, "一百零五": 105, "二〇": 20, "": None, "x": None, "12": 12, "百二十": 120}
    assert {k: T.chinese_number(k) for k in cases} == cases


def test_openings_and_single_characters(spark):
    cues, filler = {"delegate": ("surprise me",), "greeting": ("hello", "hi")}, ("um", "please")
    rows = [("Hello! Um, surprise me please", "delegate"), ("hi", "greeting"), ("um", "unsure"), ("hello vases", None), ("hi " * 30, None), ("...", "unsure")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", A.opening_kind(F.col("t"), cues, filler)).collect())
    one = spark.createDataFrame([("看花", False), ("看 花!", True), ("的花山", True), ("花", True), ("no", False)], "t string, want boolean")
    assert all(r.got == r.want for r in one.withColumn("got", A.concept_present(F.col("t"), "花", "的", "山")).collect())


def test_a_predicate_without_results(spark):
    q = spark.createDataFrame([("a", "bronze rust"), ("b", "cats")], "query_id string, question string")
    r = spark.createDataFrame([("a", 1, "provenance", "rusty")], "query_id string, object_id long, source_kind string, text string")
    got = A.assessed(q, r, [A.Predicate("p", (("bronze",), ("rust",)), "rust")]).collect()
    assert [tuple(x) for x in got] == [("a", "p", "unsupported", 0)]


def test_many_plans_with_exclusions_equal_one_at_a_time(spark, sf_dir):
    from quillspark.plans.search_queries import _index, _searchable

    index = _index(spark, sf_dir)
    plans = [search.QueryPlan("a", ("thea", "anin"), ("thea",), (("thea", "anin"),), (("the",),)), search.QueryPlan("b", ("heed", "onst"), (), (("heed",),)), search.QueryPlan("c", ("lyed",), title_terms=("the",))]
    for find in (search.lexical_search, lambda i, p, s: search.two_stage_search(i, p, s, recall=30)):
        together = sorted(tuple(r) for r in find(index, plans, _searchable()).collect())
        alone = sorted(tuple(r) for p in plans for r in find(index, [p], _searchable()).collect())
        assert together == alone and together


def test_lexical_search_shuffles_no_tokens(spark, sf_dir):
    from quillspark.plans.search_queries import PLAN, _index, _searchable

    plan = search.lexical_search(_index(spark, sf_dir), [PLAN], _searchable())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("FileScan") == 2


def test_windows_of_text_keys(spark):
    df = spark.createDataFrame([(f"k{i:05d}",) for i in range(6000)], "id string").repartition(5)
    got = sorted(readers.keyset_windows(df, "id", 1000).collect(), key=lambda r: r.id)
    assert [r.window for r in got] == [i // 1000 for i in range(6000)]
    assert all(r.cursor == (None if r.window == 0 else f"k{1000 * r.window - 1:05d}") for r in got)


def test_long_reports_are_whole(spark):
    assert evaluation.markdown(spark.range(1500), "t").count("\n") == 1504


@pytest.mark.parametrize("members", [1, 3])
def test_distance_of_small_groups(spark, members):
    df = spark.createDataFrame([("g", m, i) for m in range(members) for i in range(m, m + 2)], "grp string, m int, i int")
    got = evidence.mean_distance(df, "grp", "m", "i").first().distance
    assert got == (0.0 if members == 1 else pytest.approx((2 / 3 + 1 + 2 / 3) / 3, abs=1e-6))


def parts(spark, sf_dir):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]


def test_themed_selection_equals_a_plain_loop(spark, sf_dir):
    themes = {}
    for p in parts(spark, sf_dir):
        themes.setdefault(p["p_brand"], []).append((p["p_partkey"] == 7, p["p_retailprice"] / 10, p["p_partkey"], p["p_type"], p["p_size"] % 5))
    want = set()
    for theme, rows in themes.items():
        left, taken = sorted(rows, key=lambda r: (-r[0], -r[1], r[2]))[:250], []
        while left and len(taken) < 8:
            worth = [(r[0], r[1] - 18 * sum(t[3] == r[3] for t in taken) - 7 * sum(t[4] == r[4] for t in taken)) if r[0] or sum(t[3] == r[3] for t in taken) < 2 else None for r in left]
            if not any(worth):
                break
            k = max((k for k, w in enumerate(worth) if w), key=lambda k: (worth[k], -k))
            taken.append(left.pop(k))
        want |= {(theme, t[2], n + 1) for n, t in enumerate(taken)}
    assert {tuple(r) for r in registry.QUERIES["smp3_themed"](spark, sf_dir).collect()} == want


def test_diverse_selection_equals_a_plain_loop(spark, sf_dir):
    family = {r.p_partkey: r.f for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.title_family(F.col("p_name")).alias("f")).collect()}
    queries = {}
    for p in parts(spark, sf_dir):
        queries.setdefault(f"q{p['p_partkey'] % 3}", []).append((p["p_partkey"], p["p_retailprice"], set(p["p_type"].split(" ")) - {""}, p["p_brand"], f"k{p['p_size'] % 4}"))
    want = {}
    for q, rows in queries.items():
        left, taken = sorted(rows, key=lambda r: (-r[1], r[0]))[:250], []
        top = left[0][1]

        def utility(r, taken=taken, top=top):
            alike = max((len(r[2] & t[2]) / len(r[2] | t[2]) for t in taken), default=0.0)
            new_house = r[3] not in {t[3] for t in taken}
            return 0.68 * r[1] / top + (0.34 + 0.06) * new_house + 0.12 * (r[4] not in {t[4] for t in taken}) - 0.22 * alike

        while left and len(taken) < 12:
            fresh = [r for r in left if r[3] not in {t[3] for t in taken}]
            room = [r for r in fresh if r[4] not in {t[4] for t in taken}] or fresh or left
            room = [r for r in room if not family[r[0]] or sum(family[t[0]] == family[r[0]] for t in taken) < 2] or room
            pick = max(room, key=lambda r: (round(utility(r), 9), r[0]))
            taken.append(pick)
            left.remove(pick)
        want[q] = [t[0] for t in taken]
    got = {}
    for r in sorted(registry.QUERIES["smp5_diverse"](spark, sf_dir).collect(), key=lambda r: r.place):
        got.setdefault(r.query_id, []).append(r.object_id)
    assert got == want


def test_question_similarity_equals_difflib(spark, sf_dir):
    import difflib
    import re

    fold = lambda t: re.sub("[^a-z0-9㐀-鿿]+", "", t.lower())
    other = fold("a steel plate from the north")
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    got = {r.p_partkey: r.similarity for r in registry.QUERIES["str8_question_similarity"](spark, sf_dir).collect()}
    for p in parts(spark, sf_dir):
        t = fold(p["p_name"])
        want = 0.65 * difflib.SequenceMatcher(None, t, other).ratio() + 0.35 * len(pairs(t) & pairs(other)) / len(pairs(t) | pairs(other))
        assert got[p["p_partkey"]] == pytest.approx(want, abs=2e-6)
