"""A dense index that is resumed by its content (SNK-6).

Rows are dealt to blocks by their id. A block is whole if it holds exactly the rows of the texts as they are now, every
row bears the seal that it was written with, and every vector has length one (zero is allowed for a text that the encoder
gives zero for). Blocks that are torn, missing, stale or hold such a row are made anew; others are kept. A build goes in
``PARTS`` jobs, each of which writes its blocks or nothing, so a build that is cut off loses one job at most. Only a row
for each block reaches the driver; ``blocks`` should be such that a block fits a task.

Repeated rows are kept as often as they occur; null texts count as empty; a null id is an id of its own; a very long text
is one row of one task; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.values import dot, unit

from . import dense

PARTS = 8
OFF_UNIT = 1e-3


@dataclass
class Progress:
    kept: list[int]
    made: list[int]


@dataclass
class DenseIndex:
    spark: SparkSession
    root: str
    id_col: str
    id_type: str
    blocks: int

    def _block(self) -> Column:
        return F.pmod(F.xxhash64(self.id_col), F.lit(self.blocks)).cast("int")

    @property
    def _at(self) -> str:
        return f"{self.root}/blocks-{self.blocks}"

    def stored(self) -> DataFrame:
        """Every row that can be read, with the job that wrote it; files that are torn give none."""
        schema = f"`{self.id_col}` {self.id_type}, content long, embedding array<float>, seal long, job string, block int"
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(self._at)

    def whole(self, texts: DataFrame, text_col: str) -> dict[int, str]:
        """For each block that is whole the job that wrote it."""
        digest = lambda c: (F.count("*").alias("n"), F.sum(F.col(c).cast("decimal(38,0)")).alias("total"), F.bit_xor(c).alias("mixed"))
        wanted = texts.select(self._block().alias("block"), self._content(text_col).alias("content")).groupBy("block").agg(*digest("content"))
        norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
        sound = (F.col("seal") == self._seal()) & ((F.abs(norm - 1) < OFF_UNIT) | (norm == 0)) & (F.col("block") == self._block())
        there = self.stored().groupBy("job", "block").agg(*digest("content"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound")).where("sound")
        found = there.join(wanted, ["block", "n", "total", "mixed"], "left_semi").groupBy("block").agg(F.min("job").alias("job"))
        return {r.block: r.job for r in found.collect()}

    def _content(self, text_col: str) -> Column:
        return F.xxhash64(self.id_col, F.coalesce(text_col, F.lit("")))

    @staticmethod
    def _seal() -> Column:
        return F.xxhash64("content", "embedding")

    def resume(self, texts: DataFrame, text_col: str, encode: Callable[[list[str]], list[list[float]]]) -> Progress:
        """Make the blocks that are not whole. The first build is a resumed one of nothing."""
        kept = self.whole(texts, text_col)
        own = texts.select(self.id_col, F.coalesce(text_col, F.lit("")).alias("text"), self._block().alias("block"), self._content(text_col).alias("content"))
        todo = sorted({r.block for r in own.select("block").distinct().collect()} - set(kept))
        for k in range(PARTS):
            part = todo[k::PARTS]
            if not part:
                break
            numbers = self.spark.createDataFrame([(b,) for b in part], "block int")
            rows = own.join(F.broadcast(numbers), "block", "left_semi").select(F.struct(self.id_col, "content", "block").alias("of"), "text")
            made = dense.encoded(rows, encode, "of", "text").select("of.*", F.transform(unit(F.col("embedding")), lambda x: x.cast("float")).alias("embedding"))
            made.withColumn("seal", self._seal()).repartition("block").write.partitionBy("block").parquet(f"{self._at}/job={uuid.uuid4().hex}")
        return Progress(sorted(kept), todo)

    def vectors(self, texts: DataFrame, text_col: str) -> DataFrame:
        """``(id, embedding)`` of the whole blocks; an error names those that are not."""
        jobs = self.whole(texts, text_col)
        lost = {r.block for r in texts.select(self._block().alias("block")).distinct().collect()} - set(jobs)
        if lost:
            raise ValueError(f"blocks {sorted(lost)[:20]} are not whole: resume the index")
        chosen = self.spark.createDataFrame([(b, j) for b, j in jobs.items()], "block int, job string")
        return self.stored().join(F.broadcast(chosen), ["block", "job"], "left_semi").select(self.id_col, "embedding")
