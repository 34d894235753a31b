import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import search


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_word_variants(spark):
    got = column(spark, ["hand-built", "king's", "colour", "x"], T.word_variants)
    assert [sorted(g) for g in got] == [["built", "hand", "hand-built"], ["king", "king's"], ["color", "colour"], ["x"]]


def test_cjk_tokens(spark):
    got = column(spark, ["雲山圖", "山", "a", "雲山 b 圖"], T.cjk_tokens)
    assert got == [["雲山", "山圖", "雲山圖"], ["山"], [], ["雲山", "圖"]]


def test_tokens_keep_order_and_drop_stopwords(spark):
    assert column(spark, ["The hand-built 雲山"], lambda c: T.tokens(c, ["the"])) == [["built", "hand", "hand-built", "雲山"]]


def test_whole_word_containment(spark):
    rows = spark.createDataFrame([("limestone", "stone"), ("stone, carved", "stone"), ("silk", " ")], "v string, p string")
    assert [r[0] for r in rows.select(T.contains_phrase(F.col("v"), F.col("p"))).collect()] == [False, True, False]


def test_inflections():
    assert T.inflected(["berries", "pots", "glass", "box", "cat"]) == {"berries", "berry", "pots", "pot", "glass", "box", "cat", "cats"}


@pytest.mark.parametrize(("text", "number"), [("十二", 12), ("二十", 20), ("一百零五", 105), ("7", 7), ("x", None), ("", None), ("两", 2)])
def test_chinese_numbers(text, number):
    assert T.chinese_number(text) == number


def test_question_similarity(spark):
    pairs = [("Which cats?", "which cat"), ("", "a"), ("dogs in snow", "dogs in the snow")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(T.question_similarity(F.col("a"), F.col("b"))).collect()

    def plain(a, b):
        x, y = ("".join(c for c in s.lower() if c.isalnum()) for s in (a, b))
        if not x or not y:
            return 0.0
        g, h = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (x, y))
        return 0.65 * SequenceMatcher(None, x, y).ratio() + 0.35 * (len(g & h) / len(g | h) if g | h else 0)

    assert [round(r[0], 9) for r in rows] == [round(plain(a, b), 9) for a, b in pairs]


def test_nfkc(spark):
    assert column(spark, ["ﬁne", "１２", None], T.nfkc) == ["fine", "12", None]


def test_year_range(spark):
    got = column(spark, ["c. 1600–1650", "Tang (618–907)", "300 B.C.E. - 12", "no year", None], V.year_range)
    assert [tuple(g) for g in got] == [(1600, 1650), (618, 907), (-300, -300), (None, None), (None, None)]


def test_pages_and_chapters():
    assert V.spread_pages(100, 4) == [1, 34, 67, 100]
    assert V.spread_pages(3, 9) == [1, 2, 3] and V.spread_pages(9, 1) == [1] and V.spread_pages(0, 2) == []
    assert V.chapter_sizes(8, 3) == [3, 3, 2]


def test_repaired_dates(spark):
    rows = spark.createDataFrame([(None, 5), (9, 3), (None, None)], "a int, b int").select(V.repaired_dates(F.col("a"), F.col("b")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in rows] == [(5, 5), (3, 9), (None, None)]


def test_unit_of_zero(spark):
    assert column(spark, [[0.0, 0.0], [3.0, 4.0]], V.unit, "array<float>") == [[0.0, 0.0], [0.6, 0.8]]


def test_excerpt_matches_plain_loop(spark):
    random.seed(3)
    texts = ["".join(random.choice("ab .;!?。") for _ in range(random.randint(0, 120))) for _ in range(300)]

    def plain(t, limit=50):
        t = " ".join(t.split())
        if len(t) <= limit:
            return t
        w = t[:limit]
        for end in T.SENTENCE_ENDS:
            cut = w.rfind(end)
            if cut > limit * 0.6:
                return w[: cut + 1].strip()
        return w.rstrip() + "…"

    assert column(spark, texts, lambda c: T.excerpt(c, 50)) == [plain(t) for t in texts]


def test_spread_pages_by_row(spark):
    rows = spark.createDataFrame([(t,) for t in range(-1, 60)], "t long")
    for wanted in (0, 1, 2, 7, 13):
        got = rows.select("t", V.spread(F.col("t"), wanted).alias("pages")).collect()
        assert {r.t: r.pages for r in got} == {t: V.spread_pages(t, wanted) for t in range(-1, 60)}


def test_plans_by_row_equal_those_of_single_questions(spark):
    asked = ["Old RED bowls, a box of old berries", "", "glass", "Basis of physics; 12 x", "wort wort Ünder", None]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", search.planned(F.col("q")).alias("p"), search.atomically_planned(F.col("q")).alias("a")).collect()
    for r in rows:
        one, atomic = search.plan("q", r.q or ""), search.atomic_plan("q", r.q or "")
        assert (tuple(r.p.exact), tuple(map(tuple, r.p.groups)), tuple(r.p.terms)) == (one.exact, one.groups, one.terms)
        assert (tuple(r.a.exact), tuple(map(tuple, r.a.groups)), tuple(r.a.terms)) == (atomic.exact, atomic.groups, atomic.terms)
