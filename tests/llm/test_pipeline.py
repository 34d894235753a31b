"""The pipeline, stage by stage, against plain versions of each stage."""

import corpus_pipeline
import numpy as np

from quillspark.llm import line_dedup, near_duplicates, quality_rules
from quillspark.llm.common import table, written
from tests.llm import brute
from tests.llm.test_llm_operators import check_packing, plain_lines, texts


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    bench = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near-duplicates", "decontamination", "packing"]

    kept = written(stages["quality rules"](spark, docs, sf_dir))
    judged = quality_rules.report(docs, quality_rules.fitted(docs, table(spark, sf_dir, "labels")))
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in judged.where("kept").collect())

    lines = written(stages["line dedup"](spark, kept, sf_dir))
    rows = [(r.doc_id, r.text, r.source) for r in kept.collect()]
    want = dict(zip([r[0] for r in rows], plain_lines(rows, line_dedup.MAX_RATIO, line_dedup.MIN_PAGES), strict=True))
    assert lines.columns == columns and dict(texts(lines)) == want

    single = written(stages["near-duplicates"](spark, lines, sf_dir))
    groups = brute.groups(texts(lines), near_duplicates.WIDTH)
    assert single.columns == columns and {d for d, _ in texts(single)} == {d for d, c in groups.items() if d == c}

    clean = written(stages["decontamination"](spark, single, sf_dir))
    before = {d: brute.contaminated(t, bench) for d, t in texts(single)}
    after = dict(texts(clean))
    assert clean.columns == columns and all(after[d] == t for d, t in texts(single) if not before[d][4])
    assert set(after) == {d for d, b in before.items() if b[1] <= 0.5 * b[0]}
    assert all(brute.contaminated(after[d], bench)[0] == b[0] - b[1] for d, b in before.items() if d in after)

    sequences, tokens = check_packing(clean, stages["packing"](spark, clean, sf_dir).collect())
    assert sequences <= tokens / 2048 + 2


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(pieces) and pieces.groupby("sequence_id").length.sum().max() <= 2048
    assert np.isin(["doc_id", "sequence_id", "offset"], pieces.columns).all()
