"""Time windows of projects and sources."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DAYS = 7


def instant(value) -> datetime | None:
    """From a datetime or ISO text; without a zone it is UTC."""
    if value is None:
        return None
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


@dataclass(frozen=True)
class TimeWindow:
    """The last days, or from `since` on, or from `since` to `until`; `until` alone has no effect."""

    lookback_days: int | None = DEFAULT_DAYS
    since: datetime | None = None
    until: datetime | None = None

    def resolve(self, now: datetime) -> tuple[datetime, datetime]:
        if self.since:
            return self.since, self.until or now
        return now - timedelta(days=DEFAULT_DAYS if self.lookback_days is None else self.lookback_days), now

    def effective(self, now: datetime, watermark: datetime | None) -> tuple[datetime, datetime]:
        """Only a window of last days starts later where the source's watermark is later."""
        since, until = self.resolve(now)
        live = bool(self.lookback_days) and not self.since
        return (max(since, watermark) if live and watermark else since), until

    def start(self, now: datetime, watermark: Column) -> Column:
        """The start of effective(), without a zone, for each row's watermark (without one, of UTC)."""
        since, live = self.resolve(now)[0], bool(self.lookback_days) and not self.since
        fixed = F.lit(since.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        return F.greatest(fixed, watermark) if live else fixed

    @classmethod
    def from_dict(cls, d: dict | None) -> "TimeWindow":
        return cls(d.get("lookback_days"), instant(d.get("since")), instant(d.get("until"))) if d else cls()

    def to_dict(self) -> dict:
        return {"lookback_days": self.lookback_days, "since": self.since and self.since.isoformat(), "until": self.until and self.until.isoformat()}


def effective_windows(source_windows=None, source_window=None, project_windows=None, project_window=None) -> list[TimeWindow]:
    """The most specific that is given."""
    return list(source_windows or ([source_window] if source_window else None) or project_windows or [project_window or TimeWindow()])


def in_any(at: Column, bounds: list[tuple[datetime, datetime]]) -> Column:
    """Undated, or within one of the windows, ends included."""
    inside = F.lit(False)
    for since, until in bounds:
        inside = inside | at.between(F.lit(since), F.lit(until))
    return at.isNull() | inside
