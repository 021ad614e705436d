"""Pairs of stored records, and the counts of them that are kept with the records and scored without reading these again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..operators import counters
from ..store import Snapshot, Store
from ..tables import settled


def labels(label: str = "sentiment_label", text: str = "text_redacted") -> Column:
    """The stored label, of records without one that of their text; other texts aren't sent to be judged."""
    given = F.nullif(label, F.lit(""))
    return F.coalesce(given, extract.sentiment_label(F.when(given.isNull(), F.col(text))))


def adverse_label(label: Column) -> Column:
    return label.isin("adverse", "negative")


def pairs_of(records: DataFrame) -> DataFrame:
    """(record, drug, event, source_id, posted_at, ...), once a record, of the texts as they are stored."""
    found = records.select(F.col("id").alias("record"), "source_id", "posted_at", "ingested_at", "sentiment_label", "text_redacted", F.explode(extract.ner_pairs("text_redacted")).alias("p"))
    return found.select("record", "source_id", "posted_at", "ingested_at", "sentiment_label", "text_redacted", "p.drug", "p.event")


def _counted(records: DataFrame) -> DataFrame:
    return counters.deltas(settled(pairs_of(records).withColumn("adverse", F.coalesce(adverse_label(labels()), F.lit(False)))))


def added(at: Snapshot, new: DataFrame) -> dict[str, DataFrame]:
    """For a commit of new records, what they add to the counts; nothing where records are stored whose counts aren't there yet."""
    return {} if at.has("records") and not at.has("pair_counts") else {"pair_counts": _counted(new)}


def recount(store: Store) -> None:
    """Counts of all stored records, made anew: what a store without them needs once, and one whose records were changed."""
    store.transact(lambda at: {"replaced": {"pair_counts": _counted(at.table("records"))}})


def pair_counts(store: Store, project_id: str, adverse_only: bool = False) -> DataFrame:
    """(drug, event, n, first_at, last_at, examples) over the project's sources. No record is read, unless their counts aren't there."""
    at = store.snapshot()
    if at.has("records") and not at.has("pair_counts"):
        recount(store)
        at = store.snapshot()
    own = at.table("sources").where(F.col("project_id") == project_id).select(F.col("id").alias("source_id"))
    counts = at.table("pair_counts").join(own, "source_id", "left_semi")
    return counters.merged(counts.where("adverse") if adverse_only else counts, ["drug", "event"])
