"""Writing results (SNK-*): versioned folders, daily traces, resumable appends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot(rows: DataFrame, path: str, name: str = "name", content: str = "text") -> DataFrame:
    """SNK-1: append raw answers with their SHA-256; returns the manifest rows."""
    out = rows.select(F.col(name).alias("name"), F.col(content).alias("text"), F.sha2(F.col(content), 256).alias("sha256"))
    out.write.mode("append").parquet(path)
    return out.select("name", "sha256")


def move_into_place(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):  # a rename would go into it
        raise FileExistsError(f"{new} exists")
    if not fs.rename(a, b):
        raise OSError(f"could not move {old} to {new}")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """SNK-2..5: write all tables to a staging folder and move it into place, so readers see all or none."""
    spark = next(iter(tables.values())).sparkSession
    staging = f"{root}/.staging-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
    move_into_place(spark, staging, f"{root}/{version}")
    return f"{root}/{version}"


def filter_tables(objects: DataFrame, facets: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """SNK-5: the filter layout; facets in the order of look-ups, so that files are skipped by their statistics."""
    counts = objects.agg(F.count("*").alias("objects"))
    return {"objects": objects, "object_facets": facets.sortWithinPartitions("facet", "value_norm"), "evidence_docs": evidence, "metadata": counts}


def resumed(todo: DataFrame, done: DataFrame, key: str = "query_id") -> DataFrame:
    """SNK-7: what is left to do of a run."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def traces(searches: DataFrame, path: str, question: str = "question", at: str = "searched_at") -> None:
    """SNK-8, M19: daily JSON lines; the question itself is not kept, only its digest."""
    from quillspark.functions.text import query_digest

    searches.withColumn("question_sha256", query_digest(F.col(question))).withColumn("date", F.to_date(at)).drop(question).write.mode("append").partitionBy("date").json(path)
