"""Streams by event time: state of bounded size, late rows that are counted, and counts of days."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def unique_within(stream: DataFrame, delay: str, keys: list[str], at: str = "posted_at") -> DataFrame:
    """The first row of each key. A key is forgotten when the latest row is `delay` past it; rows later than that are dropped, since what they
    might repeat is forgotten. Where no row is later and repeats are no further apart, it is the exact first row of each key."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


class Progress(StreamingQueryListener):
    """What queries told of their batches, by query id: rows read, rows dropped as too late, rows of state, and the failure of those that ended
    with one. Registered with attach(); the last batches that a query itself remembers are fewer."""

    def __init__(self):
        self.lock, self.by = threading.Lock(), {}

    def attach(self, spark: SparkSession) -> Progress:
        spark.streams.addListener(self)
        return self

    def _of(self, query_id) -> dict:
        return self.by.setdefault(str(query_id), {"name": None, "batches": 0, "rows": 0, "late": 0, "state": 0, "ended": False, "error": None})

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self._of(event.id).update(name=event.name, ended=False, error=None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            told = self._of(p.id)
            told["batches"] += 1
            told["rows"] += p.numInputRows
            told["late"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            told["state"] = sum(o.numRowsTotal for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self._of(event.id).update(ended=True, error=event.exception)

    def told(self, query_id) -> dict:
        with self.lock:
            return dict(self._of(query_id))


def day_counts(stream: DataFrame, at: str, delay: str, *keys: str) -> DataFrame:
    """(keys, day, n) of windows of a day, for append mode: a day is told once, when the latest row is `delay` past its end. State is the days
    that aren't over. Undated rows are in no day."""
    windows = stream.withWatermark(at, delay).groupBy(*keys, F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"))
    return windows.select(*keys, F.to_date("w.start").alias("day"), "n")


def write_days(stream: DataFrame, at: str, delay: str, path: str, checkpoint: str, *keys: str, **trigger):
    """A streaming query that appends the days that are over to a folder of Parquet."""
    out = day_counts(stream, at, delay, *keys).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def days_so_far(spark: SparkSession, path: str, checkpoint: str, *keys: str) -> DataFrame:
    """All days of write_days: those told, and those still open, which the query's state holds. For a query that is between its batches."""
    told = spark.read.parquet(path).select(*keys, "day", "n")
    state = spark.read.format("statestore").load(checkpoint)
    names = state.schema["key"].dataType.names
    window = next(n for n in names if n not in keys)
    held = state.select(*(F.col(f"key.{k}").alias(k) for k in keys), F.to_date(F.col(f"key.`{window}`.start")).alias("day"), F.col("value.count").alias("n"))
    return told.unionByName(held.join(told, [*keys, "day"], "left_anti"))
