"""One terminal event for each job, from its heartbeats: state and timers, no scan of all jobs.

State of a job is its latest heartbeat and whether it ended. Each heartbeat moves a
timer to ``stale_after`` beyond it; when the watermark passes the timer, the job is
reported as stale. A heartbeat that comes later than that reports it too, at the same
moment. A terminal status reports itself. After that a job's rows are ignored: a job
that was given up stays so.

Rows of a job may come in any order inside a trigger; across triggers those behind the
watermark drop. Null jobs, times and statuses are left out. Needs a state store with
timers: :func:`configure` sets RocksDB for the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .progress import TERMINAL

SCHEMA = "job_id string, event string, at timestamp"
STALE = "stale"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def configure(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Watch(StatefulProcessor):
    def __init__(self, stale_ms: int) -> None:
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "last long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, done = self.state.get() if self.state.exists() else (None, False)
        if not done:
            before, found = last, None
            beats = sorted((int(ms), status) for part in rows for ms, status in zip(part["ms"], part["status"], strict=True))
            for ms, status in beats:
                if last is not None and ms - last > self.stale_ms:
                    found = (STALE, last + self.stale_ms)
                elif status in TERMINAL:
                    found = (status, ms)
                if found:
                    break
                last = ms if last is None else max(last, ms)
            if before is not None and (found or last != before):
                self.handle.deleteTimer(before + self.stale_ms + 1)
            if not found and last is not None and last != before:
                self.handle.registerTimer(last + self.stale_ms + 1)
            self.state.update((last if last is not None else found[1], found is not None))
            if found:
                yield self._event(key, *found)
        else:
            for _ in rows:
                pass

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, done = self.state.get()
        if not done and expiredTimerInfo.getExpiryTimeInMs() == last + self.stale_ms + 1:
            self.state.update((last, True))
            yield self._event(key, STALE, last + self.stale_ms)

    @staticmethod
    def _event(key, event: str, ms: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "event": [event], "at": pd.to_datetime([ms], unit="ms")})

    def close(self) -> None:
        pass


def watch(beats: DataFrame, stale_after: float = 90.0, lateness: str = "10 seconds") -> DataFrame:
    """Terminal events ``(job_id, event, at)`` of a stream ``(job_id, ts, status)``: a status of :data:`TERMINAL`, or ``stale``."""
    rows = beats.where("job_id IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL").withWatermark("ts", lateness)
    rows = rows.select("job_id", "ts", "status", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=Watch(round(stale_after * 1000)), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")
