"""Drug-event disproportionality: 2x2 cells, PRR, ROR, chi-square and information component, tiers and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_N, PRR, CHI2 = 3, 2.0, 4.0


def marginals(pairs: DataFrame, drug: str = "drug", event: str = "event") -> DataFrame:
    """(drug, event, a, drug_total, event_total, total) of a multiset of pairs: one shuffle of counts."""
    return with_totals(pairs.groupBy(F.col(drug).alias("drug"), F.col(event).alias("event")).agg(F.count("*").alias("a")))


def with_totals(cells: DataFrame) -> DataFrame:
    """Counts (drug, event, a) with their marginals. The totals are sums over the cells, joined back, so that no window holds all cells in
    one task."""
    by_drug = cells.groupBy("drug").agg(F.sum("a").alias("drug_total"))
    by_event = cells.groupBy("event").agg(F.sum("a").alias("event_total"))
    total = cells.agg(F.sum("a").alias("total"))
    return cells.join(by_drug, "drug").join(by_event, "event").crossJoin(F.broadcast(total))  # total is one row


def distinct_pairs(df: DataFrame, record: str, drug: str, event: str) -> DataFrame:
    """A pair counts once a record."""
    return df.select(F.col(record).alias("record"), F.col(drug).alias("drug"), F.col(event).alias("event")).distinct()


def cells(margins: DataFrame) -> DataFrame:
    return margins.select("drug", "event", "a", (F.col("drug_total") - F.col("a")).alias("b"), (F.col("event_total") - F.col("a")).alias("c"), F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("drug_total") - F.col("event_total") + F.col("a")).alias("d"), "total")


def expected() -> Column:
    return (F.col("a") + F.col("b")).cast("double") * (F.col("a") + F.col("c")) / F.col("total")


def with_statistics(cells_: DataFrame) -> DataFrame:
    """Adds prr, ror, chi2, chi2_floored and ic, unrounded. A cell of zero adds a half to all four in the ratios; chi2 is that of the
    pair's own cell with Yates's correction, which only chi2_floored keeps from growing below a half."""
    half = F.when((F.col("a") == 0) | (F.col("b") == 0) | (F.col("c") == 0) | (F.col("d") == 0), 0.5).otherwise(0.0)
    a, b, c, d = (F.col(x) + half for x in "abcd")
    e = expected()
    off = F.abs(F.col("a") - e) - 0.5
    rate = lambda x, y: F.try_divide(x, x + y)
    return cells_.withColumns({
        "prr": F.coalesce(F.try_divide(rate(a, b), rate(c, d)), F.lit(0.0)), "ror": F.coalesce(F.try_divide(a * d, b * c), F.lit(0.0)), "chi2": F.try_divide(F.pow(off, 2.0), e),
        "chi2_floored": F.try_divide(F.pow(F.greatest(F.lit(0.0), off), 2.0), e), "ic": F.log2((F.col("a") + 0.5) / (e + 0.5)),
    })


def compute(pairs: DataFrame, min_n: int = MIN_N, prr: float = PRR, chi2: float = CHI2) -> DataFrame:
    """(drug, event, n, prr, chi2, ic, ror, is_signal): flags on unrounded values, outputs of three decimals."""
    return _flagged(marginals(pairs), min_n, prr, chi2)


def compute_cells(counts: DataFrame, min_n: int = MIN_N, prr: float = PRR, chi2: float = CHI2) -> DataFrame:
    """The same of counts (drug, event, a)."""
    return _flagged(with_totals(counts), min_n, prr, chi2)


def _flagged(margins: DataFrame, min_n: int, prr: float, chi2: float) -> DataFrame:
    s = with_statistics(cells(margins).where(F.col("a") >= min_n))
    flag = (F.col("prr") >= prr) & (F.col("chi2") >= chi2) & (F.col("a") >= min_n)
    return s.select("drug", "event", F.col("a").alias("n"), *(F.round(x, 3).alias(x) for x in ("prr", "chi2", "ic", "ror")), flag.alias("is_signal"))


def confidence(prr: Column, n: Column) -> Column:
    raw = F.round(35 + 12 * F.log(F.greatest(prr, F.lit(1.0))) + 8 * F.log(F.greatest(n, F.lit(1))))
    return F.greatest(F.lit(20), F.least(F.lit(99), raw.cast("int")))


def _tiers(prr: Column, n: Column, chi2: Column, high: str, middle: str, low: str) -> Column:
    return F.when((prr >= 3) & (n >= 5) & (chi2 >= 4), high).when((prr >= 2) & (n >= 3) & (chi2 >= 4), middle).otherwise(low)


def confidence_label(prr: Column, n: Column, chi2: Column) -> Column:
    return _tiers(prr, n, chi2, "HIGH", "MEDIUM", "LOW")


def tier(prr: Column, n: Column, chi2: Column) -> Column:
    return _tiers(prr, n, chi2, "STRONG", "MODERATE", "EXPLORATORY")


def status(prr: Column, n: Column) -> Column:
    return F.when((prr >= 3) & (n >= 5), "ESCALATED").when(prr >= 2, "PENDING").when(prr < 1, "DISMISSED").otherwise("REVIEWED")


def colour(prr: Column) -> Column:
    return F.when(prr >= 3, "red").when(prr >= 2, "amber").otherwise("blue")


def strength(prr: Column, n: Column, score: Column) -> tuple[Column, Column]:
    """Label and percentage."""
    strong, some = (prr >= 3) & (n >= 5), prr >= 2
    return F.when(strong, "High").when(some, "Medium").otherwise("Low"), F.when(strong, F.least(F.lit(99), score)).when(some, F.least(F.lit(85), score)).otherwise(score)


def ratio_text(x: Column) -> Column:
    """Two decimals of the binary value, as format_number rounds it."""
    return F.when(x.isNull() | F.isnan(x), "—").when(x >= 1000, "≥ 1000").when(x <= 0, "0.00").otherwise(F.format_number(x, 2))


def quality_warning(connectors: Column, total: Column) -> Column:
    return F.when(F.array_contains(connectors, "reddit") & (total < 200), "Few records, and of a source that may lag: weights are estimates.")


def trend(history: DataFrame, keys: list[str], value: str = "prr", order: list[str] = ("computed_at",), band: float = 0.05) -> DataFrame:
    """The latest row of each key with the value before it, its first time and UP, DOWN, STABLE or NEW."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    ranked = history.withColumns({"_nth": F.row_number().over(w), "previous": F.lead(value).over(w), "first_detected": F.min(order[0]).over(Window.partitionBy(*keys))})
    now, was = F.col(value), F.coalesce("previous", F.lit(0.0))
    label = F.when(F.col("previous").isNull(), "NEW").when(now > was * (1 + band), "UP").when(now < was * (1 - band), "DOWN").otherwise("STABLE")
    return ranked.where("_nth = 1").drop("_nth").withColumn("trend", label)


def examples(df: DataFrame, keys: list[str], order: str, text: str, most: int = 3, length: int = 140) -> DataFrame:
    """The first texts of each key, by ranking: no group is collected whole."""
    w = Window.partitionBy(*keys).orderBy(order)
    top = df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", F.substring(text, 1, length).alias("t")))), lambda x: x["t"]).alias("examples"))


def triage_filter(df: DataFrame, query: str = "", tiers: list[str] | None = None, min_n: int = 0, fields: tuple[str, ...] = ("drug", "event", "project_id")) -> DataFrame:
    """Every word of the query is in the fields; of some tiers; of so many records."""
    hay = F.lower(F.concat_ws(" ", *(F.col(f).cast("string") for f in fields)))
    kept = F.forall(F.array(*map(F.lit, query.lower().split())).cast("array<string>"), lambda t: F.contains(hay, t)) & (F.col("n") >= min_n)
    return df.where(kept & F.col("tier").isin(tiers) if tiers else kept)
