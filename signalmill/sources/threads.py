"""Posts with comment trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def depths(edges: DataFrame, ident: str, parent: str) -> DataFrame:
    """edges with each node's depth below a post (no parent), of any depth: by pointer doubling, each round of which doubles the levels
    that a node has looked up. All rows stay: null depth has what hangs on a node that isn't there, or on a circle, or has no
    id. Of an id's repeated rows the smallest parent counts."""
    from ..tables import settled

    ids = edges.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("id")).agg(F.min(parent).alias("up"))
    state = settled(ids.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1)))
    reach, total = 1, state.count()
    while reach <= total and not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"), F.lit(True).alias("there"))
        step = state.where("up IS NOT NULL").join(above, "up", "left").select("id", F.col("further").alias("up"), F.when(F.col("there"), F.col("depth") + F.col("more")).alias("depth"))
        state, reach = settled(state.where("up IS NULL").unionByName(step)), 2 * reach
    found = state.select(F.col("id").alias(ident), F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    return edges.join(found, ident, "left")
