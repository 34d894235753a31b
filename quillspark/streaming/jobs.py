"""STM-3 as a stream: the state of each job from its step events, with timers for jobs that stall or run out of time."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What ends a step.
SETTLED = ("done", "failed", "skipped")
#: A row for each batch with events of the job, and one for each timer that goes off.
CHANGES = "job_id long, event string, seen long, steps long, settled long, progress double, failed boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class JobProcessor(StatefulProcessor):
    """Keeps the last status of each step of a job, when it began and when it was last heard of.

    A job that is not settled is reported ``stalled`` when nothing came for ``stall_ms``, and ``overdue`` when it is not
    settled ``deadline_ms`` after its first event; its state goes with the latter. Times are event times.
    """

    def __init__(self, stall_ms: int, deadline_ms: int):
        self.stall_ms, self.deadline_ms = stall_ms, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value: each call to the store goes to the JVM and back, and a job has few steps
        self.about = handle.getValueState("about", "began long, heard long, seen long, stall_at long, steps string")

    def _change(self, job: int, event: str, seen: int, steps: list) -> pd.DataFrame:
        last = [status for _, _, status in steps]
        settled = sum(s in SETTLED for s in last)
        return pd.DataFrame({"job_id": [job], "event": [event], "seen": [seen], "steps": [len(last)], "settled": [settled], "progress": [settled / max(len(last), 1)], "failed": ["failed" in last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.about.get()
        known = held is not None
        began, heard, seen, stall_at, kept = held if known else (None, None, 0, 0, "[]")
        steps = {step: (i, status) for step, i, status in json.loads(kept)}
        for part in rows:
            seen += len(part)
            first, last = (int(t.value) // 10**6 for t in (part["ts"].min(), part["ts"].max()))
            began = first if began is None else min(began, first)
            heard = last if heard is None else max(heard, last)
            for step, i, status in zip(part["step"].tolist(), part["id"].tolist(), part["status"].tolist(), strict=True):
                if step not in steps or steps[step][0] < i:
                    steps[step] = (i, status)
        if not known:
            self.handle.registerTimer(began + self.deadline_ms)
        if stall_at != heard + self.stall_ms:
            if stall_at:
                self.handle.deleteTimer(stall_at)
            stall_at = heard + self.stall_ms
            self.handle.registerTimer(stall_at)
        now = [(step, i, status) for step, (i, status) in steps.items()]
        self.about.update((began, heard, seen, stall_at, json.dumps(now)))
        yield self._change(key[0], "changed", seen, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.about.get()
        if held is None:
            return
        began, heard, seen, stall_at, kept = held
        overdue = expiredTimerInfo.getExpiryTimeInMs() >= began + self.deadline_ms
        change = self._change(key[0], "overdue" if overdue else "stalled", seen, json.loads(kept))
        if overdue:
            if stall_at:
                self.handle.deleteTimer(stall_at)
            self.about.clear()
        else:
            self.about.update((began, heard, seen, 0, kept))
        if (change["settled"] < change["steps"]).any():
            yield change

    def close(self) -> None:
        pass


def job_changes(steps: DataFrame, stall: str = "2 days", deadline: str = "60 days", late: str = "1 day") -> DataFrame:
    """The changes of each job of a stream of (job_id, step, id, status, ts)."""
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    return steps.withWatermark("ts", late).groupBy("job_id").transformWithStateInPandas(JobProcessor(ms(stall), ms(deadline)), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def now(changes: DataFrame) -> DataFrame:
    """The jobs as the last change of each leaves them: what the batch aggregate gives."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seen")))
    last = changes.where("event = 'changed'").withColumn("n", place).where("n = 1")
    return last.select("job_id", "steps", "settled", F.round("progress", 4).alias("progress"), "failed")


@contextmanager
def state_store(spark: SparkSession):
    """Within it, streams start with the state store that such operators need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def appended(changes: DataFrame, sink: str, checkpoint: str) -> None:
    """Append what there is to Parquet files; a later call with the same checkpoint goes on where this one ended."""
    with state_store(changes.sparkSession):
        changes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
