"""The driver's tables, and the catalogue view that the search queries work on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries of one module and the SQL of those that SQL can express."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects: their first line is the title, language and source the routing and metadata fields."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.split("text", "\n")[0].alias("title_text"), "lang", "source", "text")


def fields(objects: DataFrame) -> DataFrame:
    """PRJ-5: the four search fields as token arrays."""
    return objects.select("doc_id", T.words(F.col("title_text")).alias("title"), T.words(F.col("lang")).alias("routing"), T.words(F.col("source")).alias("metadata"), T.words(F.col("text")).alias("content"))


#: The same fields in SQL, as a common table expression.
FIELDS_SQL = """
obj AS (SELECT doc_id, string_split(text, chr(10))[1] AS title_text, lang, source, text FROM documents),
fld AS (
  SELECT doc_id, regexp_extract_all(lower(title_text), '[a-z0-9][a-z0-9''-]+') AS title,
         regexp_extract_all(lower(lang), '[a-z0-9][a-z0-9''-]+') AS routing,
         regexp_extract_all(lower(source), '[a-z0-9][a-z0-9''-]+') AS metadata,
         regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]+') AS content FROM obj)
"""
