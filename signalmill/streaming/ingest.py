"""Ingestion: gate, redact, enrich, de-duplicate against all stored records, append, move the watermark.

The same function takes a batch of a file source and the micro-batches of a stream (foreachBatch). A batch is one commit, appending it twice
inserts nothing, and a stream's batch is remembered by its number, so one that is tried again after a failure is stored once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import ConnectorError
from ..functions import extract, text
from ..functions.keywords import expand_layered
from ..lexicon import TRUSTED
from ..operators import changes
from ..project import Project, SourceConfig
from ..schemas import TABLES
from ..sources import registry
from ..store import Snapshot, Store
from ..tables import settled
from ..windows import in_any
from . import scoring
from .events import unique_within


def gated(raw: DataFrame, source: SourceConfig, keywords: list[str], bounds: list[tuple[datetime, datetime]]) -> DataFrame:
    """Within the windows, and from a curated connector or with a keyword, drug or symptom; with matched_keywords."""
    hits = text.keyword_hits(F.coalesce("text", F.lit("")), keywords)
    rows = raw.where(in_any(F.col("posted_at"), bounds)).withColumn("matched_keywords", hits)
    if source.reader in TRUSTED:
        return rows
    return rows.where((F.size("matched_keywords") > 0) | text.has_mention(F.coalesce("text", F.lit("")), [*text.DRUG_NAMES, *text.SYMPTOM_NAMES]))


def enriched(rows: DataFrame, source_id: int, now: datetime, model: extract.Model | None = None) -> DataFrame:
    """The stored columns: enrichment is of the original text, and only the redacted text is stored. model: names of a trained model
    count beside those of the lists."""
    t = F.coalesce("text", F.lit(""))
    out = rows.withColumns({"_mood": extract.sentiment_of(t), "_found": extract.ner_of(model)(t), "_pii": extract.pii_counted(t)}).withColumn("text_redacted", F.col("_pii.redacted"))
    return out.select(
        F.lit(source_id).cast("long").alias("source_id"), "external_id", text.content_hash(t).alias("content_hash"), "url", "posted_at", "text_redacted", "author_handle", "language_hint", "source_kind", "matched_keywords", F.lit(now).alias("ingested_at"),
        F.col("_mood.score").alias("sentiment_score"), F.col("_mood.label").alias("sentiment_label"), F.col("_pii.hits").alias("pii_hits_count"), F.when(F.size("_found.entities") > 0, F.col("_found.entities")).alias("entities"),
    )


def store_batch(store: Store, rows: DataFrame, source_id: int, now: datetime, batch_id: tuple[str, str] | None = None) -> dict[str, int]:
    """Counts of fetched and inserted rows (the rest are duplicates), of late ones, dated before the source's watermark, and of ones whose
    redaction failed, which are stored without a text. Records, their keys, what they add to the counts of pairs and the
    watermark are one commit: after a failure anywhere before it nothing is stored. Only the buckets of keys are read that the batch's are in.
    The counts are observed on the two writes that the batch takes, of its rows and of those that are new."""
    first = store.snapshot()
    last = first.table("watermarks").where(F.col("source_id") == source_id).select("last_seen_ts").first()
    late = F.count_if(F.col("posted_at") < F.lit(last["last_seen_ts"])) if last and last["last_seen_ts"] else F.sum(F.lit(0).cast("long"))
    seen = Observation()
    batch = settled(rows.observe(seen, F.count(F.lit(1)).alias("fetched"), late.alias("late"), F.count_if(F.col("text_redacted").isNull()).alias("failed")))
    told = {k: v or 0 for k, v in seen.get.items()}
    # An id from the source and the content: the same however often the batch is tried.
    ident = F.abs(F.xxhash64("source_id", "external_id"))

    def change(at: Snapshot) -> dict:
        told["inserted"] = 0
        marks = at.table("watermarks")
        if not told["fetched"]:
            if batch_id:  # a stream's batch without rows, which only moves its state on
                return None
            mark = store.spark.createDataFrame([(source_id, None, None, now, 0, 0)], TABLES["watermarks"])
            return {"replaced": {"watermarks": settled(changes.advance(marks, mark))}, "batch": batch_id}
        added = Observation()
        new = changes.unknown_records(batch, at.table("record_keys")).withColumn("id", ident)
        folder, stored = store.staged("records", new.observe(added, F.count(F.lit(1)).alias("inserted")))
        inserted = told["inserted"] = added.get["inserted"] or 0
        appended = {"records": folder, "record_keys": changes.keys_of(stored), **scoring.added(at, stored)} if inserted else {}
        if not inserted:
            store.discard("records", folder)
        mark = changes.high_water(batch).select("source_id", "last_seen_id", "last_seen_ts").withColumns({"last_run_at": F.lit(now), "last_fetched": F.lit(told["fetched"]).cast("long"), "last_inserted": F.lit(inserted).cast("long")})
        return {"replaced": {"watermarks": settled(changes.advance(marks, mark))}, "appended": appended, "batch": batch_id}

    inserted = told["inserted"] if not first.done(batch_id) and store.transact(change) else 0
    return {"fetched": told["fetched"], "inserted": inserted, "duplicates": told["fetched"] - inserted, "late": told["late"], "failed": told["failed"]}


def run_source(store: Store, project: Project, source: SourceConfig, source_id: int, keywords: list[str], now: datetime, model: extract.Model | None = None) -> dict:
    """model: for entities; by default the one that the source's `ner_model` names. Each window is a run of its own: one that fails is told in `errors` and doesn't stop the others; if all fail, the first failure is raised."""
    mark = store.table("watermarks").where(F.col("source_id") == source_id).select("last_seen_ts").first()
    last = mark["last_seen_ts"].replace(tzinfo=now.tzinfo) if mark and mark["last_seen_ts"] else None
    bounds = [w.effective(now, last) for w in project.windows(source)]
    model = model or extract.named_model(source.params.get("ner_model"))
    done, errors = [], []
    for since, until in bounds:
        try:
            raw = registry.read(store.spark, source, F.lit(now), since)
            done.append(store_batch(store, enriched(gated(raw, source, keywords, [(since, until)]), source_id, now, model), source_id, now))
        except Exception as e:
            errors.append((since, e))
    if errors and not done:
        raise errors[0][1]
    out = {"source": source.name, "since": min(b[0] for b in bounds).isoformat(), "until": max(b[1] for b in bounds).isoformat(), "windows": len(bounds)}
    out |= {k: sum(d[k] for d in done) for k in ("fetched", "inserted", "duplicates", "late", "failed")}
    return out | ({"errors": [{"since": at.isoformat(), "error": f"{type(e).__name__}: {str(e)[:300]}"} for at, e in errors]} if errors else {})


def run_project(store: Store, project_id: str, now: datetime, only: set[int] | None = None, model: extract.Model | None = None) -> dict:
    """All enabled sources; one that fails is told in the audit log and doesn't stop the others. Returns the run's manifest, which is also
    written beside the tables."""
    project = store.load_project(project_id)
    keywords, provenance = expand_layered(project.keywords)
    store.append_audit("runner", "run.start", project_id, {"sources": len(project.sources)})
    store.set_fields(project_id, last_started_at=now)
    ids = {r["name"]: r["id"] for r in store.table("sources").where(F.col("project_id") == project_id).select("name", "id").collect()}
    done = []
    for source in project.sources:
        if not source.enabled or only is not None and ids[source.name] not in only:
            continue
        try:
            done.append(run_source(store, project, source, ids[source.name], keywords, now, model))
            store.append_audit("runner", "source.done", source.name, done[-1])
        except Exception as e:
            done.append({"source": source.name, "error": f"{type(e).__name__}: {str(e)[:300]}"})
            store.append_audit("runner", "source.error", source.name, {"error": done[-1]["error"]})
    totals = {k: sum(d.get(k, 0) for d in done) for k in ("fetched", "inserted", "duplicates")}
    store.append_audit("runner", "run.end", project_id, totals)
    store.set_fields(project_id, last_completed_at=now)
    manifest = {"project": project_id, "keywords": [dict(zip(("keyword", "term", "source", "confidence"), p)) for p in provenance], "sources": done, **totals}
    store.write_file(f"runs/{project_id}/{now.strftime('%Y%m%dT%H%M%S')}.json", json.dumps(manifest, ensure_ascii=False, indent=1))
    return manifest


def stream_records(store: Store, source: SourceConfig, source_id: int, keywords: list[str], raw: DataFrame, checkpoint: str, now: datetime | Callable[[], datetime], bounds: list | Callable[[datetime], list] | None = None, delay: str | None = None, name: str | None = None, model: extract.Model | None = None, **trigger):
    """A streaming query that stores each micro-batch of a streaming raw-record frame. now, bounds: times, or what gives them for a batch. delay: repeats are dropped in the stream's own state already,
    which holds no more than so much event time; rows later than that are dropped and counted (events.Progress)."""
    if not raw.isStreaming:
        raise ConnectorError("not a stream")
    rows = unique_within(raw, delay, ["external_id"]) if delay else raw

    def batch(df: DataFrame, number: int) -> None:
        at = now() if callable(now) else now
        limits = (bounds(at) if callable(bounds) else bounds) or [(datetime(1970, 1, 1, tzinfo=at.tzinfo), at)]
        store_batch(store, enriched(gated(df, source, keywords, limits), source_id, at, model), source_id, at, (checkpoint, str(number)))

    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (out.queryName(name) if name else out).start()


def backfill(store: Store, force: bool = False) -> int:
    """Enriches stored records without a label (or all) from their redacted text, in one pass."""
    records = store.table("records")
    wanted = F.lit(True) if force else F.coalesce("sentiment_label", F.lit("")) == ""
    t = F.coalesce("text_redacted", F.lit(""))
    todo = records.where(wanted)
    n = todo.count()
    if n:
        done = todo.withColumns({"_mood": extract.sentiment_of(t), "_found": extract.ner_entities(t)}).withColumns({"sentiment_score": F.col("_mood.score"), "sentiment_label": F.col("_mood.label"), "entities": F.when(F.size("_found.entities") > 0, F.col("_found.entities"))})
        store.replace("records", records.where(~wanted).unionByName(done.select(*records.columns)))
    return n
