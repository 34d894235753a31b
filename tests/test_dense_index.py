import glob
import os

import pytest
from pyspark.sql import functions as F

from quillspark.operators.dense_index import PARTS, DenseIndex

BLOCKS = 12
SCHEMA = "id long, content long, embedding array<float>, seal long"


def encode(texts):
    return [[float(len(t)), float(t.count("a"))] for t in texts]


def refuse(texts):
    raise RuntimeError("cut off")


@pytest.fixture()
def texts(spark):
    return spark.createDataFrame([(i, None if i == 5 else "a" * (i % 7) + "b" * (i % 11 + 1)) for i in range(400)] + [(7, "abb"), (None, "aa"), (2**60 + 1, "ba")], "id long, words string")


def built(spark, texts, tmp_path):
    index = DenseIndex(spark, str(tmp_path), "id", "long", BLOCKS)
    assert index.resume(texts, "words", encode).made == list(range(BLOCKS))
    return index


def files(index, block):
    return sorted(glob.glob(f"{index.root}/*/job=*/block={block}/part-*"))


def right(index, texts):
    want = sorted((str(i), round(len(t or "") / (n or 1), 4)) for i, t, n in [(r.id, r.words, (len(r.words or "") ** 2 + (r.words or "").count("a") ** 2) ** 0.5) for r in texts.collect()])
    got = sorted((str(r.id), round(r.embedding[0], 4)) for r in index.vectors(texts, "words").collect())
    assert got == want


def test_nothing_is_made_twice(spark, texts, tmp_path):
    index = built(spark, texts, tmp_path)
    assert index.resume(texts, "words", refuse).made == []
    right(index, texts)


def test_torn_missing_and_non_unit_blocks_are_made_anew(spark, texts, tmp_path):
    index = built(spark, texts, tmp_path)
    with open(files(index, 1)[0], "r+b") as f:
        f.truncate(os.path.getsize(f.name) // 2)
    os.remove(files(index, 4)[0])
    where = os.path.dirname(files(index, 6)[0])
    scaled = spark.createDataFrame(spark.read.schema(SCHEMA).parquet(where).collect(), SCHEMA).withColumn("embedding", F.transform("embedding", lambda x: (x * 3).cast("float")))
    scaled.withColumn("seal", F.xxhash64("content", "embedding")).coalesce(1).write.mode("overwrite").parquet(where)  # sealed, yet of another length
    where = os.path.dirname(files(index, 8)[0])
    turned = spark.createDataFrame(spark.read.schema(SCHEMA).parquet(where).collect(), SCHEMA).withColumn("embedding", F.reverse("embedding"))
    turned.coalesce(1).write.mode("overwrite").parquet(where)  # of length one, but not what was sealed
    with pytest.raises(ValueError, match=r"\[1, 4, 6, 8\]"):
        index.vectors(texts, "words")
    progress = index.resume(texts, "words", encode)
    assert progress.made == [1, 4, 6, 8] and len(progress.kept) == BLOCKS - 4
    right(index, texts)


def test_changed_new_and_deleted_rows(spark, texts, tmp_path):
    index = built(spark, texts, tmp_path)
    now = texts.where("id IS NULL OR id <> 20").withColumn("words", F.when(F.col("id") == 30, "aaaa").otherwise(F.col("words"))).unionByName(texts.where("id = 40"))
    touched = {r.b for r in spark.createDataFrame([(20,), (30,), (40,)], "id long").select(index._block().alias("b")).collect()}
    assert set(index.resume(now, "words", encode).made) == touched
    right(index, now)


def test_a_build_that_is_cut_off_keeps_its_finished_jobs(spark, texts, tmp_path, monkeypatch):
    from quillspark.operators import dense

    index, real, calls = DenseIndex(spark, str(tmp_path), "id", "long", BLOCKS), dense.encoded, []

    def cut(rows, f, *rest):
        calls.append(1)
        return real(rows, f if len(calls) < 4 else refuse, *rest)

    monkeypatch.setattr(dense, "encoded", cut)
    with pytest.raises(Exception, match="cut off"):
        index.resume(texts, "words", encode)
    monkeypatch.setattr(dense, "encoded", real)
    done = {b for k in range(3) for b in range(BLOCKS)[k::PARTS]}
    progress = index.resume(texts, "words", encode)
    assert set(progress.kept) == done and set(progress.made) == set(range(BLOCKS)) - done
    right(index, texts)


def test_empty_table(spark, texts, tmp_path):
    index = DenseIndex(spark, str(tmp_path), "id", "long", BLOCKS)
    none = texts.limit(0)
    assert index.resume(none, "words", encode).made == [] and index.vectors(none, "words").count() == 0
