"""The stored index: the same answers as a search of the texts, from few rows; damage is noticed."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import posting_runs, search, text_index
from quillspark.plans.tables import catalogue, fields

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    pick = lambda n: [WORDS[int(60 * r.random() ** 3)] for _ in range(n)]
    rows = [(f"d{i}", pick(r.randint(0, 5)), pick(1), pick(r.randint(0, 2)), pick(r.choice([3, 10, 40, 400]))) for i in range(900)] + [("none", [], [], [], [])]
    return spark.createDataFrame(rows, "id string, title array<string>, routing array<string>, metadata array<string>, content array<string>").cache()


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return text_index.build(search.Index(docs, "id"), str(tmp_path_factory.mktemp("index")), "v1")


PLANS = [
    [search.QueryPlan("a", ("w1", "w30", "w59"), ("w30",))],
    [search.QueryPlan("a", ("w20", "w5"), (), (("w20", "w21"), ("w5",)), (), ("w1", "w2", "w3"))],
    [search.QueryPlan("a", ("w9", "w11"), ("w9",), (), (("w0", "w44"),)), search.QueryPlan("b", ("w9",), (), (("w9",),)), search.QueryPlan("c", ("nowhere",))],
    [search.QueryPlan("a", ("w2", "w50")), search.QueryPlan("b", ("w40", "w41"), ("w41",), (("w40", "w41"),))],
]


@pytest.mark.parametrize("plans", PLANS)
@pytest.mark.parametrize("limit", [None, 1, 7])
def test_same_answers_as_the_texts_give(docs, stored, plans, limit, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 4)
    want = search.lexical_search(search.Index(docs, "id"), plans, F.concat("title", "routing", "metadata", "content"), limit).collect()
    got = text_index.lexical_search(stored, plans, limit).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted((r.query_id, r.id, r.score, r["rank"]) for r in want)


def test_blocks_bound_their_documents(stored):
    plans = [search.QueryPlan("a", ("w2", "w31"), ("w31",))]
    stats = text_index._stored_statistics(stored, ["w2", "w31"])
    bounds = {r.block: r.bound for r in text_index.block_bounds(stored, plans, stats).collect()}
    scores = text_index.lexical_search(stored, plans).join(stored.table("postings").where("term = ''").select("id", "block"), "id").collect()
    assert scores and all(r.score <= bounds[r.block] + 1e-5 for r in scores)
    assert len({round(b, 3) for b in bounds.values()}) > 5


def _rows_read(df):
    """Rows that the scan of the postings handed on, by its own metric."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    todo = [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        elif "QueryStage" in node.nodeName():
            inner = node.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
    return total


def test_a_look_up_reads_its_row_groups_only(spark, tmp_path):
    many = spark.range(4000).select(F.col("id"), *(F.array(F.concat(F.lit(x), F.col("id") % n)).alias(f) for f, x, n in (("title", "t", 700), ("routing", "r", 3), ("metadata", "m", 50))), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.concat(F.lit("c"), F.pmod(F.xxhash64("id", k), F.lit(3000)))).alias("content"))
    stored = text_index.build(search.Index(many, "id"), str(tmp_path), "v1")
    total = stored.table("postings").count()
    assert _rows_read(stored.postings(["c17", "t5"])) < 0.2 * total
    assert stored.postings(["c17", "t5"]).where("term = 'c17'").count() == many.where(F.array_contains("content", "c17")).count()


def test_manifest_notices_damage(spark, docs, tmp_path):
    stored = text_index.build(search.Index(docs, "id"), str(tmp_path), "v1")
    assert all(r.ok for r in stored.check().collect())
    changed = stored.table("postings").withColumn("tf_content", F.when(F.col("id") == "d7", F.col("tf_content") + 1).otherwise(F.col("tf_content")))
    changed.write.parquet(f"{tmp_path}/v2/postings")
    for name in ("blocks", "terms", "manifest"):
        stored.table(name).write.parquet(f"{tmp_path}/v2/{name}")
    bad = text_index.TextIndex(spark, f"{tmp_path}/v2", "id", stored.fields)
    assert {r.name: r.ok for r in bad.check().collect()} == {"postings": False, "blocks": True, "terms": True}


def test_versions_are_not_overwritten(docs, tmp_path):
    text_index.build(search.Index(docs.limit(3), "id"), str(tmp_path), "v1")
    with pytest.raises(OSError):
        text_index.build(search.Index(docs.limit(3), "id"), str(tmp_path), "v1")


def test_an_empty_corpus(docs, tmp_path):
    stored = text_index.build(search.Index(docs.where("false"), "id"), str(tmp_path), "v1")
    assert text_index.lexical_search(stored, PLANS[0]).collect() == [] and text_index.lexical_search(stored, PLANS[0], 5).collect() == []
    assert all(r.ok for r in stored.check().collect())


def test_the_catalogue_has_the_same_answers(spark, sf_dir, tmp_path):
    index = search.Index(fields(catalogue(spark, sf_dir)), "doc_id")
    plan = search.QueryPlan("q", ("heed", "the", "onst"), ("heed",), (("heed", "onst"),), (("thea",),))
    got = text_index.lexical_search(text_index.build(index, str(tmp_path), "v1"), [plan])
    want = search.lexical_search(index, [plan], F.concat("title", "routing", "metadata", "content"))
    assert sorted(map(str, got.select("doc_id", "score", "rank").collect())) == sorted(map(str, want.select("doc_id", "score", "rank").collect()))


def test_repeated_null_and_missing_tokens(spark, tmp_path):
    rows = [("a", ["x", None, "x"], None, [], ["x", "y"]), ("b", [], ["y"], None, None), (None, ["z"], [], [], ["x"])]
    docs = spark.createDataFrame(rows, "id string, title array<string>, routing array<string>, metadata array<string>, content array<string>")
    stored = text_index.build(search.Index(docs, "id"), str(tmp_path), "v1")
    got = {(r.term, r.id): (r.tf_title, r.tf_routing, r.tf_content, r.len_title, r.len_content) for r in stored.table("postings").where("term <> ''").collect()}
    assert got == {("x", "a"): (2, 0, 1, 3, 2), ("y", "a"): (0, 0, 1, 3, 2), ("y", "b"): (0, 1, 0, 0, 0), ("z", None): (1, 0, 0, 1, 1), ("x", None): (0, 0, 1, 1, 1)}
    assert {r.term: r.df for r in stored.table("terms").collect()} == {"x": 2, "y": 2, "z": 1}


def test_small_runs_and_frequent_terms(spark, docs, tmp_path, monkeypatch):
    want = {tuple(r) for r in text_index.build(search.Index(docs, "id"), str(tmp_path), "v1").table("postings").collect()}
    monkeypatch.setattr(posting_runs, "RUN_TOKENS", 700)
    monkeypatch.setattr(posting_runs, "RUN_DOCUMENTS", 11)
    packer = posting_runs.packer(list(search.FIELD_WEIGHTS))
    rows = docs.select("id", *search.FIELD_WEIGHTS).toArrow().combine_chunks().to_batches()
    opener = posting_runs.opener(list(search.FIELD_WEIGHTS))
    got = [tuple(r.values()) for b in opener(packer(iter(rows))) for r in b.to_pylist()]
    assert len(got) == len(want) and {r[:3] for r in got} == {(r[0], r[1], r[2]) for r in want}
