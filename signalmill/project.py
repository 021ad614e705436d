"""Project configurations: YAML or JSON to objects to rows."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from .errors import ValidationError
from .lexicon import CADENCE_SECONDS, CONNECTORS
from .schemas import CADENCES
from .windows import TimeWindow, effective_windows


@dataclass
class SourceConfig:
    name: str
    connector: str
    params: dict = field(default_factory=dict)
    latency: str = "daily"
    time_window: TimeWindow | None = None
    time_windows: list[TimeWindow] = field(default_factory=list)
    enabled: bool = True

    @property
    def reader(self) -> str | None:
        return CONNECTORS.get(self.connector)

    def reader_params(self) -> dict:
        """Several subreddits as a list, one or none as "all"; at most 100 posts unless set."""
        params = dict(self.params)
        if self.reader == "reddit":
            if not params.get("subreddits"):
                params.pop("subreddits", None)
                params.setdefault("subreddit", "all")
            params.setdefault("limit", 100)
        return params


@dataclass
class Project:
    id: str
    name: str
    keywords: list[str]
    sources: list[SourceConfig]
    description: str = ""
    time_window: TimeWindow = field(default_factory=TimeWindow)
    time_windows: list[TimeWindow] = field(default_factory=list)

    def windows(self, source: SourceConfig) -> list[TimeWindow]:
        return effective_windows(source.time_windows, source.time_window, self.time_windows, self.time_window)

    @classmethod
    def from_dict(cls, d: dict) -> "Project":
        window = lambda x: TimeWindow.from_dict(x) if x else None
        many = lambda xs: [TimeWindow.from_dict(x) for x in xs or []]
        sources = [SourceConfig(s["name"], s["connector"], s.get("params") or {}, s.get("latency") or "daily", window(s.get("time_window")), many(s.get("time_windows")), s.get("enabled", True)) for s in d.get("sources") or []]
        return cls(d["id"], d.get("name") or d["id"], list(d.get("keywords") or []), sources, d.get("description") or "", TimeWindow.from_dict(d.get("time_window")), many(d.get("time_windows")))

    def to_dict(self) -> dict:
        out = asdict(self)
        shape = lambda w: w.to_dict() if w else None
        out |= {"time_window": shape(self.time_window), "time_windows": [shape(w) for w in self.time_windows]}
        for row, s in zip(out["sources"], self.sources):
            row |= {"time_window": shape(s.time_window), "time_windows": [shape(w) for w in s.time_windows]}
        return out

    @classmethod
    def load(cls, path: str) -> "Project":
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            if path.endswith(".json"):
                json.dump(self.to_dict(), f, ensure_ascii=False, indent=2)
            else:
                import yaml

                yaml.safe_dump(self.to_dict(), f, sort_keys=False, allow_unicode=True)


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def openfda_search(drugs: list[str], events: list[str] = (), field_name: str = "patient.drug.medicinalproduct") -> str:
    """The search text of a list of drugs, and of reactions if given."""
    some = lambda name, values: "(" + " OR ".join(f'{name}:"{v}"' for v in values) + ")"
    return " AND ".join([some(field_name, drugs), *([some("patient.reaction.reactionmeddrapt", events)] if events else [])])


def from_form(form: dict) -> Project:
    """A project from the fields of the creation form."""
    identity = slug(form.get("id") or form.get("name") or "")
    keywords = [k.strip() for k in (form.get("keywords") or "").split(",") if k.strip()] if isinstance(form.get("keywords"), (str, type(None))) else list(form["keywords"])
    missing = [what for what, there in (("id", identity), ("keyword", keywords), ("source", form.get("sources"))) if not there]
    if missing:
        raise ValidationError(f"missing: {', '.join(missing)}")
    cadence = {"hourly": "real_time"}.get(form.get("cadence"), form.get("cadence"))
    cadence = cadence if cadence in CADENCES else "daily"
    sources = []
    for s in form["sources"]:
        params = dict(s.get("params") or {})
        if s.get("connector") == "reddit" and isinstance(params.get("subreddits"), str):
            params["subreddits"] = [re.sub(r"^/?r/", "", x.strip()) for x in params["subreddits"].split(",") if x.strip()]
        sources.append({**s, "params": params, "latency": cadence if cadence in CADENCE_SECONDS else "daily"})
    return Project.from_dict({**form, "id": identity, "keywords": keywords, "sources": sources})
