"""A versioned append log for several writers (WIN-11): a commit succeeds for one writer only.

The log is a folder of data folders and a folder of commits, numbered without gaps. A writer judges its batch against
the commits that it has read, writes the judged rows, and creates the next commit if it is absent (file systems such as
HDFS do that atomically). If another writer was first, the batch is judged anew against the longer log. A
batch is known by writer and number: played again, it changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import review

ATTEMPTS = 100


class Log:
    """Rows of ``schema``: the ``keys``, ``revision``, ``request_id`` and whatever else belongs to a row."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root, schema, keys
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("commits"))

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def commits(self) -> list[dict]:
        """What was committed, in order."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("commits")))
        rows = self.spark.read.text([f"{self.root}/commits/{n}" for n in names]).collect() if names else []
        return sorted((json.loads(r.value) for r in rows), key=lambda c: c["version"])

    def _create(self, version: int, commit: dict) -> bool:
        """Write the commit if there is none of that version; false if there is."""
        path = self._path(f"commits/{version:020d}")
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or self._fs.exists(path):
                return False
            raise
        out.write(bytearray(json.dumps(commit | {"version": version}).encode()))
        out.close()
        return True

    def judged(self, commits: list[dict] | None = None) -> DataFrame:
        """Every row that a writer brought, with its status, writer and arrival."""
        found = self.commits() if commits is None else commits
        schema = f"{self.schema}, arrival long, status string, writer string"
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/data/{c['data']}" for c in found)) if found else self.spark.createDataFrame([], schema)

    def rows(self, commits: list[dict] | None = None) -> DataFrame:
        """The log itself: accepted rows."""
        return self.judged(commits).where("status = 'accepted'").drop("arrival", "status", "writer")

    def append(self, batch: DataFrame, writer: str, number: int, before_commit: Callable[[], None] | None = None) -> int:
        """Judge and append a batch with a column ``arrival``; its version. ``before_commit`` lets tests put another writer first."""
        for _ in range(ATTEMPTS):
            commits = self.commits()
            for c in commits:
                if (c["writer"], c["number"]) == (writer, number):
                    return c["version"]
            name = uuid.uuid4().hex
            judged = review.accepted_appends(self.rows(commits), batch, self.keys)
            judged.select(*(c.split()[0] for c in self.schema.split(", ")), "arrival", "status", F.lit(writer).alias("writer")).write.parquet(f"{self.root}/data/{name}")
            if before_commit:
                before_commit()
                before_commit = None
            if self._create(len(commits) + 1, {"writer": writer, "number": number, "data": name}):
                return len(commits) + 1
            self._fs.delete(self._path(f"data/{name}"), True)
        raise RuntimeError(f"another writer was first {ATTEMPTS} times")

    def follow(self, stream: DataFrame, writer: str, checkpoint: str) -> None:
        """Append every batch of a stream that there is now; a batch that runs again after a failure is known."""
        stream.writeStream.foreachBatch(lambda batch, number: self.append(batch, writer, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
