"""Reading landed files (SRC-*). Fetching over the network is not a Spark operation: files are landed first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
#: Ranges of keys that rows are counted in, and about how many keys are looked at to choose them.
KEY_RANGES, KEY_SAMPLE = 256, 4096


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """SRC-9: one object a line. Lines that don't parse fail the read if ``strict``, else stand in ``_corrupt_record``."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    full = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_pages(spark: SparkSession, path: str, schema: str, items: str = "data", lines: bool = False) -> DataFrame:
    """SRC-2..7: answers of a paged interface, one document a file or, with ``lines``, one a line, exploded to their records."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.input_file_name().alias("page_file"), F.explode(items).alias("record")).select("page_file", "record.*")


def collections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-8: objects of all collections under a folder, with the collection's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{path}/*/objects.json")
    return rows.withColumn("collection", F.regexp_extract(F.input_file_name(), "([^/]+)/objects[.]json(?:/[^/]*)?$", 1))


def land_collections(bodies: DataFrame, path: str) -> None:
    """A folder for each (collection, value): ``objects.json`` below it holds the value. One task writes each."""
    staged = bodies.select("value", F.concat(F.col("collection"), F.lit("/objects.json")).alias("at"))
    names = [r["at"] for r in staged.select("at").distinct().collect()]  # a catalogue has some dozens of collections
    for name in sorted(names):
        staged.where(F.col("at") == name).select("value").coalesce(1).write.text(f"{path}/{name}")


def verified_snapshot(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SRC-12: raw files whose SHA-256 is what the manifest says; others stop the job when the result is used.

    Digests are made where the files are read, and names and digests alone decide.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("found"))
    return _verified(files, manifest)


def replayed(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """SRC-12 for answers that were landed as a table (``writers.snapshot``)."""
    rows = spark.read.parquet(path)
    return _verified(rows.select("name", "text", F.sha2("text", 256).alias("found")), manifest)


def _verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the manifest with the text of their file; the check joins digests only, and then stops a text that differs or is not there."""
    wanted = manifest.select("name", "sha256")
    state = wanted.join(files.select("name", "found"), "name", "left")
    wrong = F.raise_error(F.concat(F.lit("snapshot differs: "), F.col("name")))
    checked = state.select("name", F.when(F.col("found").eqNullSafe(F.col("sha256")), F.col("sha256")).otherwise(wrong).alias("sha256"))
    return checked.join(files.select("name", "text", F.col("found").alias("sha256")), ["name", "sha256"]).select("name", "sha256", "text")


def latest_snapshot(names: DataFrame, column: str = "snapshot") -> DataFrame:
    """SRC-13."""
    return names.agg(F.max(column).alias(column))


def _key_range(rows: DataFrame, key: str) -> Column:
    """Number of the key range that a row is in; ranges follow the order of keys, nulls come first."""
    every = max(1, rows.count() // KEY_SAMPLE)
    seen = sorted(r[0] for r in rows.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0)).select(key).distinct().collect())
    bounds = F.array(*map(F.lit, seen[:: max(1, len(seen) // KEY_RANGES)])) if seen else F.array().cast(f"array<{dict(rows.dtypes)[key]}>")
    return F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(key))))


def keyset_windows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """SRC-6: window number and cursor (largest key before it) of rows in windows of ``size`` by key.

    Rows are counted in key ranges first, so windows follow without ordering all rows in one task. The ranges'
    bounds are keys chosen by hash, so every evaluation has the same ones.
    """
    ranged = rows.withColumn("__part", _key_range(rows, key))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("before")
    numbered = ranged.join(F.broadcast(starts), "__part").withColumn("window", F.floor(place / size).cast("long"))
    ends = numbered.groupBy("window").agg(F.max(key).alias("__end"))
    cursor = ends.select((F.col("window") + 1).alias("window"), F.col("__end").alias("cursor"))
    return numbered.join(cursor, "window", "left").drop("__part", "before")


def benchmark_problems(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """SRC-10, QRY-16: what is wrong with a benchmark: repeated ids, bad grades, judgements of unknown questions."""
    twice = questions.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated_question").alias("problem"))
    pairs = qrels.groupBy("query_id", "object_id").count().where("count > 1").select("query_id", F.lit("repeated_judgement").alias("problem"))
    grades = qrels.where(F.col("relevance").isNull() | F.isnan(F.col("relevance").cast("double")) | (F.col("relevance") < 0)).select("query_id", F.lit("bad_grade").alias("problem"))
    unknown = qrels.join(questions, "query_id", "left_anti").select("query_id", F.lit("unknown_question").alias("problem"))
    return twice.unionByName(pairs).unionByName(grades).unionByName(unknown).distinct()


def run_rows(runs: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-11: ranked results of each run (positions from 1), and questions that a run leaves out (JON-5)."""
    ranked = runs.select("query_id", F.posexplode("results").alias("p", "r")).select("query_id", F.col("r.object_id").alias("object_id"), (F.col("p") + 1).alias("rank"))
    return ranked, questions.join(runs, "query_id", "left_anti").select("query_id")


def rejoined(shards: Sequence[DataFrame], plan: DataFrame) -> DataFrame:
    """SET-7: rows of all shards, each question once; a repeated, missing or foreign one stops the job when used."""
    rows = shards[0]
    for s in shards[1:]:
        rows = rows.unionByName(s)
    rest = [c for c in rows.columns if c != "query_id"]
    one = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.any_value(F.struct(*rest)).alias("r"))
    joined = plan.select("query_id", F.lit(True).alias("planned")).join(one, "query_id", "full_outer")
    ok = F.coalesce(F.col("planned"), F.lit(False)) & (F.coalesce("n", F.lit(0)) == 1)
    return joined.withColumn("r", F.when(ok, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("shards don't fit the plan at "), "query_id")))).select("query_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def row_owners(objects: DataFrame, id_col: str, count: str) -> DataFrame:
    """JON-7: ``(row, id)``: which object each evidence row belongs to, from the objects' numbers of rows in id order.

    The first row of each object comes from sums in key ranges, so no join by range is needed.
    """
    numbered = objects.where(F.col(count) > 0).select(id_col, F.col(count).cast("long").alias("n"))
    ranged = numbered.withColumn("__part", _key_range(numbered, id_col))
    sums = ranged.groupBy("__part").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("__part", before.alias("before")))
    own = F.sum("n").over(Window.partitionBy("__part").orderBy(id_col)) - F.col("n")
    first = ranged.join(starts, "__part").withColumn("first", own + F.col("before"))
    return first.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("row"), id_col)


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SEC-24: files that a manifest names and that are missing or changed, and files that it doesn't name."""
    both = manifest.select("name", F.col("sha256").alias("said")).join(files.select("name", F.col("sha256").alias("found")), "name", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "unexpected").when(F.col("said") != F.col("found"), "changed")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def pending_pairs(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """SEC-6: the pairs of a frozen dataset that wait for a judgement, by question."""
    left = pairs.join(judged.select("query_id", "object_id"), ["query_id", "object_id"], "left_anti")
    return left.groupBy("query_id").agg(F.sort_array(F.collect_set("object_id")).alias("pending"))
