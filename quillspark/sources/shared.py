"""Folders below the one that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def landing(spark: SparkSession) -> str:
    """A new folder; it is deleted at the end of the process, or by ``clean_up``. A local session may have no shared folder set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="quillspark-landing-")
    _made.append(f"{shared}/landing-{uuid.uuid4().hex}")
    return _made[-1]


def kept(rows: DataFrame) -> DataFrame:
    """The rows written and read back: what follows starts from files that any executor can read."""
    path = landing(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows written and read back like ``kept``, in ``parts`` parts by the hash of ``keys``: groups of ``keys``, and joins of tables dealt alike, move no rows."""
    spark, name = rows.sparkSession, f"dealt_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, *keys).option("path", landing(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; no name is left behind
    return out


def clean_up() -> None:
    """Delete the folders made so far; results that still read them are gone."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _made:
        with suppress(Exception):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made[-1])
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.pop()


atexit.register(clean_up)
