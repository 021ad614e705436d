"""The signal job and the scheduler's tick."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes, counters, search
from ..operators import disproportionality as dp
from ..store import Store
from ..tables import settled
from .ingest import run_project
from .scoring import adverse_label, labels, pair_counts, pairs_of


def record_pairs(store: Store, project_id: str, adverse_only: bool = False) -> DataFrame:
    """Pairs of all records of a project; materialise it to serve several readings."""
    sources = store.table("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"))
    rows = store.table("records").join(sources, "source_id", "left_semi")
    return pairs_of(rows.where(adverse_label(labels())) if adverse_only else rows)


def compute_signals(store: Store, project_id: str, now: datetime, adverse_only: bool = False, min_n: int = dp.MIN_N, prr: float = dp.PRR, chi2: float = dp.CHI2) -> dict:
    """Statistics of the project's pairs, from the counts that each batch of records adds to: what it costs follows the number of pairs, and no
    record is read. All pairs are scored, since each new record changes the total that all are held against."""
    counted = settled(pair_counts(store, project_id, adverse_only))
    stats = settled(counters.compute(counted, min_n, prr, chi2))
    window = counted.agg(F.min("first_at").alias("window_since"), F.max("last_at").alias("window_until"), F.sum("n").alias("n")).first()
    rows = stats.withColumns({"project_id": F.lit(project_id), **{c: F.lit(window[c]).cast("timestamp") for c in ("window_since", "window_until")}, "computed_at": F.lit(now)})
    rows = rows.withColumn("id", F.abs(F.xxhash64("project_id", "drug", "event", "computed_at")))
    at = store.snapshot()
    new = rows.join(at.table("signals").select("id"), "id", "left_anti")
    # What the index lacks where signals are stored that it doesn't know is made up for when it is next asked for.
    known = {"signal_grams": search.postings(names_of(stats))} if at.has("signal_grams") or not at.has("signals") else {}
    store.commit(appended={"signals": new, **known})
    counts = stats.agg(F.count("*").alias("rows"), F.count_if("is_signal").alias("flagged")).first().asDict()
    store.append_audit("signals", "signals.computed", project_id, counts)
    examples = counted.select("drug", "event", F.transform("examples", lambda e: e["text"]).alias("examples"))
    top = stats.join(examples, ["drug", "event"], "left").orderBy(F.desc("is_signal"), F.desc("prr")).limit(20)
    return {**counts, "pairs": window["n"] or 0, "top": [r.asDict() for r in top.collect()]}


def names_of(signals: DataFrame) -> DataFrame:
    return signals.select(F.explode(F.array("drug", "event")).alias("name")).distinct()


def name_index(store: Store) -> DataFrame:
    """Trigrams of the names in signals (operators/search.py), as they were kept with the commits; made anew where they weren't."""
    at = store.snapshot()
    if at.has("signals") and not at.has("signal_grams"):
        store.transact(lambda now: {"replaced": {"signal_grams": search.postings(names_of(now.table("signals")))}})
        at = store.snapshot()
    return at.table("signal_grams")


#: Seconds after which a tick's lease ends by itself, should its process be lost.
LEASE = 3_600


class Scheduler:
    """One tick at a time, over all processes on a store: who ticks holds a lease there. A tick runs what is due of each project, then computes its signals again. start() ticks every few seconds in the
    background, until stop()."""

    def __init__(self, store: Store):
        self.store, self.owner = store, uuid.uuid4().hex
        self.lock, self.ended, self.thread = threading.Lock(), threading.Event(), None

    def start(self, seconds: float = 300, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> None:
        """A tick that fails is told in the audit log, and the next one comes all the same."""

        def loop() -> None:
            while not self.ended.is_set():
                try:
                    self.tick(now())
                except Exception as e:
                    self.store.append_audit("scheduler", "tick.error", None, {"error": f"{type(e).__name__}: {str(e)[:300]}"})
                self.ended.wait(seconds)

        self.ended.clear()
        self.thread = threading.Thread(target=loop, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        self.ended.set()
        if self.thread is not None:
            self.thread.join()

    def tick(self, now: datetime) -> dict:
        if not self.lock.acquire(blocking=False):
            return {"skipped": True}
        try:
            if not self.store.lease("tick", self.owner, LEASE):
                return {"skipped": True}
            try:
                return self._tick(now)
            finally:
                self.store.lease("tick", self.owner, 0)
        finally:
            self.lock.release()

    def _tick(self, now: datetime) -> dict:
        s = self.store
        rows = changes.due(s.table("sources"), s.table("projects"), s.table("watermarks"), F.lit(now)).select("project_id", "id").collect()
        by: dict[str, set[int]] = {}
        for r in rows:
            by.setdefault(r["project_id"], set()).add(r["id"])
        out = {"projects": 0, "sources": len(rows), "inserted": 0, "flagged": 0}
        for project_id, ids in by.items():
            run = run_project(s, project_id, now, ids)
            out["projects"] += 1
            out["inserted"] += run["inserted"]
            out["flagged"] += compute_signals(s, project_id, now)["flagged"]
            s.lease("tick", self.owner, LEASE)  # still at work
        s.append_audit("scheduler", "tick.run", None, out)
        return out
