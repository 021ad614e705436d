"""The registered queries of streams and of counts that are kept up to date: the driver's tables are replayed as batches."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events, ingest, jobs
from ..tables import shared_dir
from . import roles
from .catalog import _CELLS, _t, query
from .read_queries import _W, _said

# Where the replay of the events is cut into batches.
CUTS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _utc(ts: str) -> F.Column:
    """A time without a zone as that of UTC, whatever the session's zone."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def _batches() -> list[F.Column]:
    edges = [F.lit(c).cast("timestamp_ntz") for c in CUTS]
    ts = F.col("ts")
    return [ts < edges[0], *((ts >= a) & (ts < b) for a, b in zip(edges, edges[1:])), ts >= edges[-1]]


def replayed(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """A stream of the frames, each a batch: files in the order in which they were written, one at a time."""
    path = _folder(spark, "replay")
    for df in batches:
        df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"""WITH e AS (SELECT event_id, ts, value FROM events WHERE ts IS NOT NULL), late AS (SELECT count(*) AS n FROM e WHERE ts < TIMESTAMP '{CUTS[0]}' - INTERVAL 2 DAY AND event_id % 7 = 0)
SELECT count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 2) AS total, (SELECT n FROM late) AS late FROM e""")
def stream_unique(spark, sf_dir):
    """Events week by week, every fifth one told again with the next week's; at the end some of the first week's again, which are too late: they are
    dropped and counted."""
    rows = _t(spark, sf_dir, "events").where("ts IS NOT NULL").select("event_id", "ts", _utc("ts").alias("at"), "value")
    weeks = [rows.where(w) for w in _batches()]
    again = [w.where("event_id % 5 = 0") for w in weeks[:-1]]
    early = weeks[0].where((F.col("ts") < F.lit(CUTS[0]).cast("timestamp_ntz") - F.expr("INTERVAL 2 DAYS")) & (F.col("event_id") % 7 == 0))
    batches = [weeks[0], *(w.unionByName(a) for w, a in zip(weeks[1:], again)), early]
    progress = events.Progress().attach(spark)
    path = _folder(spark, "unique")
    stream = events.unique_within(replayed(spark, [b.drop("ts") for b in batches]), "8 days", ["event_id"], "at")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", _folder(spark, "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    spark.streams.removeListener(progress)
    told = spark.read.parquet(path).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total"))
    return told.withColumn("late", F.lit(late).cast("long"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_days(spark, sf_dir):
    """Events by day as a stream counts them: the days that are over from its output, the others from its state."""
    rows = _t(spark, sf_dir, "events").select("event_type", "ts", _utc("ts").alias("at"))
    path, checkpoint = _folder(spark, "days"), _folder(spark, "check")
    stream = replayed(spark, [rows.where(w).drop("ts") for w in _batches()])
    events.write_days(stream, "at", "1 hour", path, checkpoint, "event_type").awaitTermination()
    return events.days_so_far(spark, path, checkpoint, "event_type")


@query(f"""{_W}, pairs AS (SELECT drug, event, posted_at FROM records r JOIN sources s ON r.source_id = s.id WHERE project_id = '{roles.PROJECT}'), {_CELLS}
SELECT drug, event, n, prr, chi2, ic, (SELECT strftime(min(posted_at), '%Y-%m-%d %H:%M:%S') FROM pairs) AS window_since, (SELECT strftime(max(posted_at), '%Y-%m-%d %H:%M:%S') FROM pairs) AS window_until FROM stat""")
def incremental_signals(spark, sf_dir):
    """Three batches of records, each of which adds to the counts of pairs; the statistics are of these counts alone."""
    from ..store import Store

    t, store = roles.tables(spark, sf_dir), Store(spark, _folder(spark, "store"))
    store.commit(replaced={"sources": roles.whole(t, "sources")})
    own = t("sources").where(F.col("project_id") == roles.PROJECT).select(F.col("id").alias("source_id"))
    rows = roles.whole(t, "records").join(own, "source_id", "left_semi").withColumn("content_hash", F.sha2("external_id", 256))
    for k in range(3):
        ingest.store_batch(store, rows.where(F.col("id") % 3 == k).drop("id"), 0, datetime(2024, 1, 1 + k, tzinfo=timezone.utc))
    now = datetime(2030, 1, 1, tzinfo=timezone.utc)
    jobs.compute_signals(store, roles.PROJECT, now)
    found = store.table("signals")
    return found.select("drug", "event", "n", "prr", "chi2", "ic", _said("window_since"), _said("window_until"))
