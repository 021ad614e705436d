"""Counts by day over a gapless range of days, and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(df: DataFrame, at: Column, *keys: str) -> DataFrame:
    return df.where(at.isNotNull()).groupBy(*keys, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def bounds(df: DataFrame, at: str, *keys: str) -> DataFrame:
    """(keys, window_since, window_until, n): the first and last time and the number of rows."""
    return df.groupBy(*keys).agg(F.min(at).alias("window_since"), F.max(at).alias("window_until"), F.count("*").alias("n"))


def spine(days: DataFrame, *keys: str, least: int = 14) -> DataFrame:
    """Each key's days from its first to its last; shorter ranges are widened at both ends, the odd day at the end."""
    ends = days.groupBy(*keys).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    pad = F.greatest(F.lit(0), F.lit(least - 1) - F.date_diff("last", "first"))
    before = F.floor(pad / 2).cast("int")
    wide = F.sequence(F.date_sub("first", before), F.date_add("last", pad - before), F.expr("INTERVAL 1 DAY"))
    return ends.select(*keys, F.explode(wide).alias("day"))


def timeline(df: DataFrame, at: Column, *keys: str, least: int = 14) -> DataFrame:
    """(keys, day, n) with zero for days without rows."""
    counts = daily_counts(df, at, *keys)
    return spine(counts, *keys, least=least).join(counts, [*keys, "day"], "left").select(*keys, "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def halves_growth(days: DataFrame, *keys: str) -> DataFrame:
    """(keys, base_avg, recent_avg, growth_pct): means of the first and second half of the days; with nothing in the first, 100 or 0."""
    w = Window.partitionBy(*keys)
    ranked = days.withColumns({"_nth": F.row_number().over(w.orderBy("day")), "_half": F.floor(F.count("*").over(w) / 2)})
    first = F.col("_nth") <= F.col("_half")
    means = ranked.groupBy(*keys).agg(F.coalesce(F.avg(F.when(first, F.col("n"))), F.lit(0.0)).alias("base_avg"), F.coalesce(F.avg(F.when(~first, F.col("n"))), F.lit(0.0)).alias("recent_avg"))
    base, recent = F.col("base_avg"), F.col("recent_avg")
    return means.withColumn("growth_pct", F.when(base > 0, F.round(F.try_divide(100 * (recent - base), base)).cast("long")).when(recent > 0, F.lit(100).cast("long")).otherwise(F.lit(0).cast("long")))


MIX = {"negative": ("negative", "adverse"), "neutral": ("neutral",), "positive": ("positive",)}


def label_mix(df: DataFrame, label: str, *keys: str, mix: dict[str, tuple[str, ...]] = MIX) -> DataFrame:
    """Counts and whole percentages of groups of labels; other labels don't count."""
    counts = df.groupBy(*keys).agg(*(F.count_if(F.col(label).isin(*of)).alias(name) for name, of in mix.items()))
    total = F.greatest(F.lit(1), sum((F.col(n) for n in list(mix)[1:]), F.col(next(iter(mix)))))
    return counts.withColumns({f"{n}_pct": F.round(100 * F.col(n) / total).cast("long") for n in mix})


def trajectory(df: DataFrame, at: Column, label: str, *keys: str, mix: dict[str, tuple[str, ...]] = MIX, rest: str | None = "neutral", least: int = 14) -> DataFrame:
    """Counts of label groups by day, over all days; labels of no group count as `rest`."""
    named = F.lit(rest)
    for name, of in mix.items():
        named = F.when(F.col(label).isin(*of), name).otherwise(named)
    rows = df.where(at.isNotNull()).groupBy(*keys, F.to_date(at).alias("day")).agg(*(F.count_if(named == n).alias(n) for n in mix), F.count("*").alias("n"))
    filled = spine(rows, *keys, least=least).join(rows.drop("n"), [*keys, "day"], "left")
    return filled.select(*keys, "day", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in mix))


def shares(df: DataFrame, *keys: str, of: tuple[str, ...] = ()) -> DataFrame:
    """Counts by key with whole percentages of the sum and of the largest, over the keys in `of`. Totals are aggregates
    joined back, as all keys may be in one group."""
    counts = df.groupBy(*of, *keys).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*of).agg(F.sum("n").alias("_sum"), F.max("n").alias("_max"))
    joined = counts.join(totals, list(of)) if of else counts.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*of, *keys, "n", F.round(100 * F.col("n") / F.col("_sum")).cast("long").alias("pct"), F.round(100 * F.col("n") / F.col("_max")).cast("long").alias("bar_pct"))


def modes(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The commonest value of each key, ties to the smallest; of counts, not of collected rows."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value), F.max("n").alias("n"))
