import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E
from quillspark.operators import filters, ranking, review, search
from quillspark.sources import readers, writers
from quillspark.streaming import streams


def test_golden_scores(spark):
    """Two scored questions, one found at the top and one missed: every mean is one half."""
    qrels = spark.createDataFrame([("q1", "a", 3, True), ("q2", "b", 3, True), ("q3", "c", 3, False)], "query_id string, object_id string, relevance int, scored boolean")
    run = spark.createDataFrame([("q1", "a", 1), ("q2", "x", 1), ("q3", "c", 1)], "query_id string, object_id string, rank int")
    m = E.macro_means(E.per_query(run, qrels)).first()
    assert (m.queries, m.recall, m.ndcg, m.mrr, m.success) == (2, 0.5, 0.5, 0.5, 0.5)


def test_nearest_rank(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 11)], "s string, v double")
    r = E.percentiles(rows, ["s"], "v").first()
    assert (r.p50, r.p95, r["max"]) == (5.0, 10.0, 10.0)


@pytest.mark.parametrize(("sizes", "target", "quotas"), [({"Huge": 1000, "Small": 2, "Medium": 20}, 9, {"Huge": 4, "Medium": 3, "Small": 2}), ({"a": 1, "b": 1}, 9, {"a": 1, "b": 1}), ({"a": 5, "b": 5}, 0, {"a": 0, "b": 0}), ({"a": 0, "b": 3}, 2, {"a": 0, "b": 2})])
def test_water_fill(spark, sizes, target, quotas):
    df = spark.createDataFrame(list(sizes.items()), "g string, available long")
    assert {r.g: r.quota for r in ranking.water_fill(df, "g", target).collect()} == quotas


def test_batched_search_equals_single_searches(spark, sf_dir):
    from quillspark.plans.tables import catalogue, fields

    index = search.Index(fields(catalogue(spark, sf_dir)), "doc_id")
    plans = [search.plan("a", "the thing"), search.plan("b", "that of"), search.atomic_plan("c", "the of")]
    both = search.lexical_search(index, plans, F.col("content")).collect()
    each = [r for p in plans for r in search.lexical_search(index, [p], F.col("content")).collect()]
    assert both and sorted(map(tuple, both)) == sorted(map(tuple, each))


def test_excluded_documents_leave_the_statistics(spark):
    docs = spark.createDataFrame([(1, ["cat"], ["cat"]), (2, ["dog"], ["dog", "cat"]), (3, ["cat"], ["cat", "bad"])], "id int, title array<string>, content array<string>")
    index = search.Index(docs, "id", {"title": 5.0, "content": 1.0})
    found = search.lexical_search(index, [search.QueryPlan("q", ("cat",), excluded=(("bad",),))], F.col("content")).collect()
    assert {r.id for r in found} == {1, 2}


def test_filter_parsing():
    assert filters.parsed({"date_start": 100, "surprise": 1}) is None
    assert filters.parsed({"date_start": True}) is None
    assert filters.parsed({"date_start": 5, "date_end": 1}) is None
    assert filters.parsed({"cultures": ["china"], "date_end": None}) == filters.FilterSpec(cultures=("china",))
    assert filters.parsed({}).empty


def test_unknown_dates_never_overlap(spark):
    rows = spark.createDataFrame([(None, None), (1, 5), (8, 9)], "a int, b int").select(filters.overlaps(F.col("a"), F.col("b"), 4, 8)).collect()
    assert [r[0] for r in rows] == [False, True, True]


def test_diverse_selection_prefers_new_origins(spark):
    rows = spark.createDataFrame([("q", i, 10.0 - i, ["f"], "x" if i < 3 else "y", ["p"], "h", "same") for i in range(5)], "query_id string, object_id int, score double, features array<string>, origin string, packs array<string>, institution string, family string")
    assert [r.object_id for r in ranking.diverse(rows, 3, "object_id").orderBy("place").collect()] == [0, 3, 1]


def test_latest_revision_and_conflicts(spark):
    log = spark.createDataFrame([("q", 1, "r1", 1), ("q", 2, "r2", 2)], "query_id string, revision int, request_id string, id int")
    new = spark.createDataFrame([("q", 3, "r3", 1), ("q", 3, "r3", 2), ("q", 9, "r4", 3), ("p", 1, "r5", 4), ("q", 1, "r1", 5)], "query_id string, revision int, request_id string, arrival int")
    got = {(r.request_id, r.arrival): r.status for r in review.accepted_appends(log, new, ["query_id"]).collect()}
    assert got == {("r3", 1): "accepted", ("r3", 2): "duplicate", ("r4", 3): "conflict", ("r5", 4): "accepted", ("r1", 5): "duplicate"}
    assert review.revisions_gapless(log, ["query_id"]).count() == 0


def test_jsonl_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{bad\n')
    rows = readers.json_lines(spark, str(tmp_path), "a int").collect()
    assert [(r.a, r[readers.CORRUPT]) for r in rows] == [(1, None), (None, "{bad")]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path), "a int", strict=True).collect()


def test_snapshots_and_publication(spark, tmp_path):
    raw = spark.createDataFrame([("p1.json", '{"data": [{"id": 1}, {"id": 2}]}'), ("p2.json", '{"data": [{"id": 3}]}')], "name string, text string")
    manifest = writers.snapshot(raw, str(tmp_path / "bronze"))
    for r in raw.collect():
        (tmp_path / r["name"]).write_text(r.text)
    ok = readers.verified_snapshot(spark, str(tmp_path / "*.json"), manifest)
    assert ok.count() == 2 and ok.where("text LIKE '%data%'").count() == 2
    pages = readers.json_pages(spark, str(tmp_path / "*.json"), "data array<struct<id:int>>")
    assert sorted(r.id for r in pages.collect()) == [1, 2, 3]
    (tmp_path / "p1.json").write_text("changed")
    with pytest.raises(Exception):  # noqa: B017
        readers.verified_snapshot(spark, str(tmp_path / "*.json"), manifest).where("length(text) > 0").collect()
    path = writers.publish({"objects": raw, "cards": raw}, str(tmp_path / "gold"), "v1")
    assert spark.read.parquet(f"{path}/objects").count() == 2
    writers.traces(spark.createDataFrame([("q", 1)], "question string, n int").withColumn("searched_at", F.timestamp_seconds(F.lit(0))), str(tmp_path / "traces"))
    assert "question" not in spark.read.json(str(tmp_path / "traces")).columns


def test_shards_fit_the_plan(spark):
    a, b = (spark.createDataFrame([(q, 1)], "query_id string, x int") for q in ("q1", "q2"))
    plan = a.unionByName(b).select("query_id")
    assert readers.rejoined([a, b], plan).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.rejoined([a, a], plan).select("x").collect()


def test_streams(spark, tmp_path, sf_dir):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in/e.parquet")
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = streams.events(spark, str(tmp_path / "in"), batch.schema)
    counts = streams.drained(streams.event_counts(stream), "counts", str(tmp_path / "c1"), "complete")
    assert counts.agg(F.sum("n")).first()[0] == batch.count()
    once = streams.drained(streams.once_each(streams.events(spark, str(tmp_path / "in"), batch.schema), "user_id"), "once", str(tmp_path / "c2"))
    assert once.count() == batch.select("user_id").distinct().count()
    sessions = streams.drained(streams.sessions(streams.events(spark, str(tmp_path / "in"), batch.schema)), "sessions", str(tmp_path / "c3"), "complete")
    assert sessions.agg(F.sum("events")).first()[0] == batch.count()


def test_markdown(spark):
    df = spark.createDataFrame([("a", 1)], "metric string, value int")
    assert E.markdown(df, "Report").endswith("| a | 1 |\n")
