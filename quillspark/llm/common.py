"""Reading the tables, cutting lineage and small frame helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_own: list[str] = []


#: Bytes of rows handed to a Python worker at a time; long texts would make large batches of a fixed number of rows.
BATCH_BYTES = 4_000_000
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand rows to Python workers in batches of ``BATCH_BYTES`` at most."""
    if int(spark.conf.get(_BATCHES).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session, as in tests, gets one of its own; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quillspark-"))
        folder = _own[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> None:
    """Delete what is left of written tables; call it before the session is stopped. The end of the process does so, too."""
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        with suppress(Exception):
            _delete(spark, _written[-1])
        _written.pop()
    for folder in _own:
        shutil.rmtree(folder, ignore_errors=True)


atexit.register(clean_up)


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from files that any executor can read."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/quillspark-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` gives, and delete the tables that were written on the way to it."""
    before = len(_written)
    out = written(make())
    for path in _written[before:-1]:
        _delete(out.sparkSession, path)
    del _written[before:-1]
    return out


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_schema(fields: str) -> pa.Schema:
    """A schema from text such as ``doc_id long, kept boolean``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in fields.split(","))])


def batch(fields: str, *columns) -> pa.RecordBatch:
    """A record batch of the columns in the order of ``fields``."""
    schema = arrow_schema(fields)
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array,)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)




def lower_az(column):
    """Fold A-Z only, as the contracts ask; other letters stay as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())
