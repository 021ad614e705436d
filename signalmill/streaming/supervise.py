"""Streams of projects, started and stopped by what the tables say: the control table is that of projects, with their status."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.extract import named_model
from ..functions.keywords import expand_layered
from ..project import Project, SourceConfig
from ..sources import registry
from ..store import Store
from .events import Progress
from .ingest import stream_records

#: Seconds after which a supervisor's lease ends by itself; it is renewed at each look.
LEASE = 120
Start = Callable[[Store, Project, SourceConfig, int, str], StreamingQuery]


def _utc_now() -> datetime:
    return datetime.now(timezone.utc)


def start_source(store: Store, project: Project, source: SourceConfig, source_id: int, name: str, now: Callable[[], datetime] = _utc_now, delay: str = "7 days", **trigger) -> StreamingQuery:
    """A source's stream: its checkpoint is beside the tables, so that it goes on where it was; what it gates by is asked anew for each batch."""
    windows = project.windows(source)
    return stream_records(
        store, source, source_id, expand_layered(project.keywords)[0], registry.read_stream(store.spark, source, F.current_timestamp()), f"{store.path}/_checkpoints/{project.id}/{source_id}", now,
        lambda at: [w.resolve(at) for w in windows], delay, name, named_model(source.params.get("ner_model")), **(trigger or {"processingTime": "30 seconds"}),
    )


class Supervisor:
    """Keeps the streams of running projects' enabled sources running, and no others. One supervisor at a time over all processes on a store: who
    holds the lease. A stream that fails is told in the log and started again at the next look."""

    def __init__(self, store: Store, start: Start = start_source):
        self.store, self.begin, self.owner = store, start, uuid.uuid4().hex
        self.progress = Progress().attach(store.spark)
        self.queries: dict[str, StreamingQuery] = {}
        self.ended, self.thread = threading.Event(), None

    def wanted(self) -> dict[str, tuple[str, int, str]]:
        """(project, source id, source) by the query's name, of sources whose connector streams."""
        at = self.store.snapshot()
        running = at.table("projects").where("status = 'running' AND coalesce(cadence, 'daily') <> 'manual'").select(F.col("id").alias("project_id"))
        rows = at.table("sources").where("enabled").join(running, "project_id").select("project_id", "id", "name", "connector").collect()  # configurations
        return {f"{r['project_id']}:{r['id']}": (r["project_id"], r["id"], r["name"]) for r in rows if SourceConfig(r["name"], r["connector"]).reader in registry.STREAMS}

    def look(self) -> dict[str, list[str]]:
        """Compares and acts once."""
        if not self.store.lease("streams", self.owner, LEASE):
            self._stop_all()
            return {"skipped": [], "started": [], "stopped": [], "failed": []}
        wanted, out = self.wanted(), {"started": [], "stopped": [], "failed": []}
        for name, q in list(self.queries.items()):
            if q.isActive and name not in wanted:
                q.stop()
                self.store.append_audit("supervisor", "stream.stopped", name, {"rows": self.progress.told(q.id)["rows"]})
                out["stopped"].append(name)
            elif not q.isActive and (error := q.exception()) is not None:
                self.store.append_audit("supervisor", "stream.error", name, {"error": str(error)[:300]})
                out["failed"].append(name)
            if name not in wanted or not q.isActive:
                del self.queries[name]
        projects: dict[str, Project] = {}
        for name, (project_id, source_id, source) in wanted.items():
            if name in self.queries:
                continue
            project = projects.setdefault(project_id, self.store.load_project(project_id)) if project_id not in projects else projects[project_id]
            config = next(s for s in project.sources if s.name == source)
            try:
                self.queries[name] = self.begin(self.store, project, config, source_id, name)
            except Exception as e:  # one source's settings don't keep the others from running
                self.store.append_audit("supervisor", "stream.error", name, {"error": f"{type(e).__name__}: {str(e)[:300]}"})
                out["failed"].append(name)
                continue
            self.store.append_audit("supervisor", "stream.started", name)
            out["started"].append(name)
        return out

    def _stop_all(self) -> None:
        for q in self.queries.values():
            q.stop()
        self.queries.clear()

    def start(self, seconds: float = 30) -> None:
        """Looks every few seconds in the background, until stop()."""

        def loop() -> None:
            while not self.ended.is_set():
                try:
                    self.look()
                except Exception as e:
                    self.store.append_audit("supervisor", "look.error", None, {"error": f"{type(e).__name__}: {str(e)[:300]}"})
                self.ended.wait(seconds)

        self.ended.clear()
        self.thread = threading.Thread(target=loop, daemon=True)
        self.thread.start()

    def stop(self) -> None:
        """Ends the looks and the streams, and gives the lease back."""
        self.ended.set()
        if self.thread is not None:
            self.thread.join()
        self._stop_all()
        self.store.spark.streams.removeListener(self.progress)
        self.store.lease("streams", self.owner, 0)
