"""Registered queries over tables whose ids go past the numbers that their SQL names."""

import pytest

from quillspark.operators import dense
from quillspark.plans import registry


@pytest.fixture(scope="session")
def late_documents(spark, tmp_path_factory):
    """700 documents; the longest have the highest ids."""
    d = str(tmp_path_factory.mktemp("late"))
    rows = [(i, f"first {i}\nsecond line", "en", "s1", 100 + i) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, f"l{i % 3}", [1.0, float(i)]) for i in range(150)], "vec_id long, label string, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


def test_lexical_channel_ranks_every_document(spark, late_documents):
    best = set(range(620, 700))
    got = {r.object_id: r.share for r in registry.QUERIES["agg10_share_of_best"](spark, late_documents).collect()}
    assert got == {i: round((100 + i) / 799, 6) for i in best}
    for name in ("agg9_reciprocal_rank", "qry6_hybrid", "qry9_reranked", "qry10_fused_queries", "win8_interleaved"):
        assert best <= {r.object_id for r in registry.QUERIES[name](spark, late_documents).collect()}, name


@pytest.fixture(scope="session")
def late_rows(spark, tmp_path_factory):
    """Events, order lines, orders and documents with ids past 4000 too."""
    d = str(tmp_path_factory.mktemp("rows"))
    ids = [*range(20), *range(2990, 3010), *range(4500, 4600)]
    events = [(i, i % 30, f"2024-01-01 {i % 24:02}:00:00") for i in ids]
    spark.createDataFrame(events, "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "CAST(ts AS timestamp) AS ts").write.parquet(f"{d}/events.parquet")
    spark.createDataFrame([(k, n, "A", "F") for k in (1, 9000) for n in range(1, 6)], "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in (1, 5000, 5700, 6400)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0, 3, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, f"text of document {i}") for i in (1, 2, 400, 5000)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, events


def test_queries_read_past_id_prefixes(spark, late_rows):
    d, events = late_rows
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {r.arrival: r.status for r in run("win11_appends")} == {i: "accepted" if i % 10 else "conflict" for i, _, _ in events if i >= max(e[0] for e in events) * 3 // 5}
    assert {r.object_id for r in run("qry11_visible_evidence")} == {1, 9000}
    assert {r.object_id for r in run("qry12_bound_checks")} == {1, 2, 400, 5000}
    assert [tuple(r) for r in run("src10_benchmark_problems") if r.problem == "repeated_question"] == [("q100", "repeated_question")]
    sets = {}
    for i, user, _ in events:
        sets.setdefault(user % 10, {}).setdefault(user, set()).add(i % 24 % 8)
    want = {}
    for group, members in sets.items():
        pairs = [1 - len(members[a] & members[b]) / len(members[a] | members[b]) for a in members for b in members if a < b]
        want[group] = round(sum(pairs) / len(pairs), 6)
    assert {r.grp: r.distance for r in run("agg34_mean_distance")} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("block", [2_000, 1])
def test_vector_searches_take_every_fiftieth_row(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", block)
    rows = [(i, f"l{i % 4}", [float(i * 37 % 11), float(i * 53 % 7) - 3, 1.0]) for i in range(201)]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    best, groups = set(), set()
    for q, _, v in rows[::50]:
        order = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i, label) for i, label, u in rows)
        best |= {(f"v{q}", i, k + 1) for k, (_, i, _) in enumerate(order[:20])}
        groups |= {(f"v{q}", i, k + 1) for g in range(4) for k, (_, i, _) in enumerate([x for x in order if x[2] == f"l{g}"][:5])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in registry.QUERIES["top1_cosine_topk"](spark, str(tmp_path)).collect()} == best
    assert {(r.query_id, r.vec_id, r.place) for r in registry.QUERIES["top3_best_per_group"](spark, str(tmp_path)).collect()} == groups
