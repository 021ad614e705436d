"""Counts of drug-event pairs that are kept up to date by what is new: deltas of batches, their sums, and cells for the statistics.

A delta holds what a batch of new records adds to each (source, drug, event, adverse or not); deltas add up, in any order, to what all their records
would give. A batch costs what its own records cost, and statistics cost as much as there are pairs, however many records were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import disproportionality as dp

KEYS = ["source_id", "drug", "event", "adverse"]
#: Example texts that are kept of a pair, and their length; parts that a pair's records are ranked in first, so that no task ranks all of a
#: frequent pair.
EXAMPLES, LENGTH, PARTS = 3, 140, 64


def _firsts(rows: DataFrame) -> DataFrame:
    """(keys, examples): the texts of the first records of each pair."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("record"), F.lit(PARTS)))
    for over in ([*KEYS, "_part"], KEYS):
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*over).orderBy("record"))).where(F.col("_nth") <= EXAMPLES)
    example = F.struct("record", F.substring("text_redacted", 1, LENGTH).alias("text"))
    return rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(example)).alias("examples"))  # EXAMPLES at most


def deltas(pairs: DataFrame) -> DataFrame:
    """(source_id, drug, event, adverse, n, first_at, last_at, examples) of pairs (record, source_id, posted_at, text_redacted, drug, event,
    adverse), each once a record. pairs are read twice: write them first."""
    counts = pairs.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"))
    return counts.join(_firsts(pairs), KEYS)


def merged(state: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Deltas added up by some of their keys; of the examples the first records' stay. What is gathered of a pair is EXAMPLES for each delta."""
    examples = F.slice(F.array_sort(F.flatten(F.collect_list("examples"))), 1, EXAMPLES)
    return state.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), examples.alias("examples"))


def compute(counted: DataFrame, min_n: int = dp.MIN_N, prr: float = dp.PRR, chi2: float = dp.CHI2) -> DataFrame:
    """dp.compute of the records behind merged counts (drug, event, n)."""
    return dp.compute_cells(counted.select("drug", "event", F.col("n").alias("a")), min_n, prr, chi2)
