"""The hash-chained audit log: appending folds, verifying is parallel."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TABLES

FIELDS = ("prev_hash", "ts", "actor", "action", "target", "payload_json")


def payload(d: dict) -> str:
    return json.dumps(d, sort_keys=True, ensure_ascii=False)


def link(prev: str, ts: str, actor: str, action: str, target: str | None, payload_json: str | None) -> str:
    return hashlib.sha256("|".join((prev, ts, actor, action, target or "", payload_json or "")).encode()).hexdigest()


def hash_of(prev: Column) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in FIELDS[1:]]
    return F.sha2(F.concat_ws("|", F.coalesce(prev, F.lit("")), *parts), 256)


def last_of(log: DataFrame) -> tuple[int, str]:
    """Id and hash of the last row; 0 and nothing of an empty log."""
    last = log.agg(F.max("id").alias("id"), F.max_by("hash", "id").alias("hash")).first()
    return last["id"] or 0, last["hash"] or ""


def append(log: DataFrame, events: list[tuple[str, str, str, str | None, dict]], last: tuple[int, str] | None = None) -> DataFrame:
    """Rows for (ts, actor, action, target, payload) events after the last row of log, which is looked up unless it is given. A chain is
    serial: events of a run, not of a corpus."""
    spark: SparkSession = log.sparkSession
    (at, prev), rows = last or last_of(log), []
    for ts, actor, action, target, body in events:
        text = payload(body)
        at, was, prev = at + 1, prev, link(prev, ts, actor, action, target, text)
        rows.append((at, ts, actor, action, target, text, was, prev))
    return spark.createDataFrame(rows, TABLES["audit_log"])


def chain(events: DataFrame, group: str, order: str) -> DataFrame:
    """A chain for each group of events, folded over its events in order: (group, last hash, length). For groups of bounded size."""
    entry = F.struct(order, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS[1:]))
    fold = F.aggregate(F.array_sort(F.collect_list(entry)), F.lit(""), lambda acc, x: F.sha2(F.concat_ws("|", acc, *(x[c] for c in FIELDS[1:])), 256))
    return events.groupBy(group).agg(fold.alias("hash"), F.count("*").alias("n"))


def checked(log: DataFrame, chunk: int = 100_000) -> DataFrame:
    """log with `ok`. The predecessor of a row is in its chunk of ids, or is the last of an earlier chunk: windows are over
    chunks, and only the chunks' last rows are ordered as a whole."""
    part = F.floor(F.col("id") / chunk)
    w = Window.partitionBy("_part").orderBy("id")
    rows = log.withColumn("_part", part)
    ends = rows.groupBy("_part").agg(F.max_by("hash", "id").alias("_end"))
    # One row a chunk.
    before = ends.select("_part", F.lag("_end", 1, "").over(Window.orderBy("_part")).alias("_before"))
    linked = rows.join(before, "_part").withColumn("_prev", F.coalesce(F.lag("hash").over(w), "_before"))
    good = F.coalesce(F.col("prev_hash"), F.lit("")).eqNullSafe(F.col("_prev")) & F.col("hash").eqNullSafe(hash_of(F.col("prev_hash")))
    return linked.withColumn("ok", good).drop("_part", "_prev", "_before")


def verify(log: DataFrame) -> DataFrame:
    """One row: ok, broken_at (the first broken id), total."""
    return checked(log).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), F.min(F.when(~F.col("ok"), F.col("id"))).alias("broken_at"), F.count("*").alias("total"))


def tail(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("id")).limit(n).orderBy("id")


# Label of each action; targets whose entries aren't listed.
ACTION_LABELS = {"run.start": "Run Started", "run.end": "Run Completed", "ingest": "Records Ingested", "redact": "Record Redacted", "signal.flagged": "Signal Flagged", "signal.dismissed": "Signal Dismissed", "project.created": "Project Created", "project.deleted": "Project Deleted", "connector.discovered": "Connector Discovered", "connector.approved": "Connector Approved"}
SCRATCH = ("qa-%", "qa %", "test%", "smoke%")


def labelled(value: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), value), value)


def listed(log: DataFrame, n: int = 8, scratch: tuple[str, ...] = SCRATCH) -> DataFrame:
    """The last entries for reading, without those of scratch projects (in any letter case)."""
    kept = log
    for pattern in scratch:
        kept = kept.where(~F.ilike(F.coalesce("target", F.lit("")), F.lit(pattern)))
    kind = F.when(F.startswith("action", F.lit("signal")), "SIG").when(F.contains("action", F.lit("redact")) | F.contains("action", F.lit("ingest")), "LOG").otherwise("EVT")
    at = F.try_to_timestamp("ts")
    return kept.orderBy(F.desc("id")).limit(n).select("id", F.date_format(at, "HH:mm:ss").alias("time"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("time_full"), labelled(F.col("action"), ACTION_LABELS).alias("action_label"), F.col("actor").alias("user"), "target", F.concat_ws("-", kind, F.lpad(F.col("id").cast("string"), F.greatest(F.lit(3), F.length(F.col("id").cast("string"))), F.lit("0"))).alias("trace"), F.substring("hash", 1, 12).alias("hash_short"))
