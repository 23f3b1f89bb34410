"""Concentration of values from histograms: Gini, HHI, top shares, CCDF, Lorenz, ranks.

Every measure works on ``(group, value, count)``: values are counted first, so
windows run over distinct values and no group's rows are sorted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranks import running


def histogram(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``by..., v, c``: how often each value occurs; nulls are left out."""
    return values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def _top(fraction: float) -> Column:
    """The part of the total that the largest ``max(1, ceil(n * fraction))`` values have."""
    k = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(fraction))))
    return F.sum(F.least(F.greatest(k - F.col("above"), F.lit(0)), F.col("c")) * F.col("v"))


def concentration(values: DataFrame, by: list[str], value: str = "value", fractions: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """Count, positive count, total, Gini, HHI and top shares of each group; all are 0 where the total is 0."""
    if any(not 0 < f <= 1 for f in fractions):
        raise ValueError("fractions lie above 0 and up to 1")
    h = histogram(values, by, value)
    w = Window.partitionBy(*by)
    up, down = w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumns({"n": F.sum("c").over(w), "below": F.coalesce(F.sum("c").over(up), F.lit(0)), "above": F.coalesce(F.sum("c").over(down), F.lit(0))})
    ranks = F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2
    made = h.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.sum(F.when(F.col("v") > 0, F.col("c")).otherwise(0)).alias("positive_n"),
        F.sum(F.col("c") * F.col("v")).alias("total"),
        F.sum(ranks * F.col("v")).alias("ranked"),
        F.sum(F.col("c") * F.col("v") * F.col("v")).alias("squares"),
        *[_top(f).alias(f"__top{k}") for k, f in enumerate(fractions)],
    )
    some = F.col("total") > 0
    gini = F.when(some, 2 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).otherwise(0.0)
    hhi = F.when(some, F.col("squares") / (F.col("total") * F.col("total"))).otherwise(0.0)
    tops = {f"top_{round(f * 100)}pct_share": F.when(some, F.col(f"__top{k}") / F.col("total")).otherwise(0.0) for k, f in enumerate(fractions)}
    return made.select(*by, "n", "positive_n", "total", gini.alias("gini"), hhi.alias("hhi"), *[c.alias(name) for name, c in tops.items()])


def ccdf(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``by..., v, ccdf``: the share of positive values at or above each value."""
    h = histogram(values.where(F.col(value) > 0), by, value)
    w = Window.partitionBy(*by)
    return h.select(*by, "v", (F.sum("c").over(w.orderBy(F.desc("v"))) / F.sum("c").over(w)).alias("ccdf"))


def lorenz(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``by..., population_share, value_share`` at the end of each run of equal values, from the smallest."""
    h = histogram(values, by, value)
    w = Window.partitionBy(*by)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("c") * F.col("v")
    return h.select(*by, "v", (F.sum("c").over(up) / F.sum("c").over(w)).alias("population_share"), F.try_divide(F.sum(mass).over(up), F.sum(mass).over(w)).alias("value_share"))


def ranked_blocks(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """``by..., v, c, first_rank``: ranks (from 1, largest first) of the runs of equal positive values."""
    h = histogram(values.where(F.col(value) > 0), by, value)
    if not by:
        return running(h, [F.desc("v")], F.col("c")).withColumn("first_rank", F.col("before") + 1).drop("before")
    before = Window.partitionBy(*by).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)
    return h.withColumn("first_rank", F.coalesce(F.sum("c").over(before), F.lit(0)) + 1)


def at_ranks(blocks: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """The values at the wanted ranks (``by..., rank``)."""
    keyed = blocks.join(ranks, by) if by else blocks.crossJoin(F.broadcast(ranks))
    return keyed.where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("c"))).select(*by, "rank", "v")


def powerlaw_ccdf(x: Column, xmin: Column, alpha: Column, tail_mass: Column) -> Column:
    """The power law's CCDF above *xmin*, scaled to the tail's empirical mass."""
    return tail_mass * F.pow(x / xmin, 1 - alpha)


def powerlaw_overlay(values: DataFrame, by: list[str], xmin: float, alpha: float, value: str = "value") -> DataFrame:
    """``by..., v, ccdf, overlay``: the CCDF from *xmin* on, and a power law that starts at the same share.

    A group without a value from *xmin* on has no row.
    """
    tail = ccdf(values, by, value).where(F.col("v") >= xmin)
    mass = tail.groupBy(*by).agg(F.max("ccdf").alias("tail_mass"))
    joined = tail.join(mass, by) if by else tail.crossJoin(F.broadcast(mass))
    return joined.select(*by, "v", "ccdf", powerlaw_ccdf(F.col("v"), F.lit(float(xmin)), F.lit(float(alpha)), F.col("tail_mass")).alias("overlay"))
