"""Many phrases in one pass, against one regular expression for each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import phrases as P

PHRASES = ["red", "red bolt", "the red", "bolt's", "o'red", "-red", "red-", "café", "é", "a", "a b", "a  b", "雲山", "山", "雲山 red", "3", "+", "red bolt of", "x" * 50, "Red", "b\nc"]
PIECES = ["red", "bolt", "bolt's", "o'red", "the", "-", "café", "é", "a", "b", "雲", "山", "雲山", "3", "3d", "+", " ", "  ", "\n", "c", "of", "RED", "Bolt", "x" * 50, "x" * 51, "."]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(PIECES) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (902, "red " * 50_000)]
    return spark.createDataFrame(rows, "id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def wanted(texts):
    each = F.array(*(F.when(T.phrase_present(F.col("text"), p), F.lit(p)) for p in PHRASES))
    return {(r.id, p) for r in texts.select("id", each.alias("f")).collect() for p in r.f if p is not None}


def test_occurring_equals_single_patterns(texts, wanted):
    got = texts.select("id", P.occurring(F.col("text"), PHRASES).alias("f")).collect()
    assert {(r.id, p) for r in got for p in r.f} == {(i, P.as_found(p)) for i, p in wanted}
    assert all(len(r.f) == len(set(r.f)) for r in got)


@pytest.mark.parametrize("sent", [P.SENT_PHRASES, 5])
def test_matches_equal_single_patterns(spark, texts, wanted, sent, monkeypatch):
    rows = spark.createDataFrame([(p,) for p in [*PHRASES, "red", " ", None]], "phrase string")
    if sent == 5:
        with pytest.raises(ValueError):
            P.matches(texts, "id", "text", rows.union(spark.createDataFrame([(x,) for x in "!?;:,"], "phrase string")), sent=sent).count()
    got = P.matches(texts, "id", "text", rows, sent=sent).collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_no_phrases(spark, texts):
    assert P.matches(texts, "id", "text", spark.createDataFrame([], "phrase string")).collect() == []
    assert texts.select(P.occurring(F.col("text"), []).alias("f")).where("size(f) > 0").count() == 0


def test_holding_equals_contains(spark, texts):
    terms = spark.createDataFrame([("red",), ("ed b",), ("r",), ("",), ("雲山",), ("lt's",), ("x" * 51,), ("zzz",)], "term string")
    got = P.holding(texts, F.lower("text"), terms).select("id", "term").collect()
    want = texts.crossJoin(terms).where((F.col("term") != "") & F.lower("text").contains(F.col("term"))).select("id", "term").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_a_thousand_phrases_cost_less_than_three_times_ten(spark, sf_dir):
    d = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").cache()
    d.count()
    many = [f"th{k} er{k % 7}" for k in range(600)] + [f"word{k}" for k in range(400)]

    def cost(ps):
        took = []
        for _ in range(3):
            began = time.time()
            d.select(F.size(P.occurring(F.col("text"), ps)).alias("n")).agg(F.sum("n")).collect()
            took.append(time.time() - began)
        return min(took)

    cost(many)
    assert cost(many) < 3 * cost([*many[:5], *many[-5:]])
