"""Ranks and running sums over a total order without a single-task sort, and sums over ranks in closed form."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import written


def running(df: DataFrame, order: list[Column], weight: Column | None = None, name: str = "before") -> DataFrame:
    """*df* with the sum of *weight* (default: the number) of the rows before each row in the order.

    Range partitions are summed on their own; each adds the sum of the partitions before it, of which
    there are as many as shuffle partitions.  Rows of equal order are in one partition.
    """
    weight = F.lit(1) if weight is None else weight
    dealt = written(df.withColumn("__w", weight.cast("bigint")).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.sum("__w").alias("__size"))
    first = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__first"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.withColumn("__inside", F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    return counted.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__inside")).drop("__part", "__w", "__first", "__inside")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by...`` and a column for each share: exact linear quantiles of *value* in every group.

    Values are counted, and the counted ones ranked over all groups by range partitions: a group's values
    follow each other, so that a quantile is the value at a place after the group's first.  No group is
    gathered anywhere.  Null values count nothing, a group without others has no row; a null in *by* is a
    group like any other.
    """
    keys = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counted = running(rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c")), [*map(F.col, keys), F.col("__v")], F.col("__c"), "__before")
    counted = written(counted, "counted")
    groups = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min("__before").alias("__first"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    near = counted.alias("a").join(groups.alias("b"), same or F.lit(True)).select(*[F.col(f"a.{k}") for k in keys], "__v", "__c", "__n", (F.col("__before") - F.col("__first")).alias("__at"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__at") <= place) & (place < F.col("__at") + F.col("__c")), F.col("__v")))

    found, out = [], []
    for i, (name, q) in enumerate(shares.items()):
        place = F.lit(q) * (F.col("__n") - 1)
        found += [at(F.floor(place)).alias(f"__low{i}"), at(F.ceil(place)).alias(f"__high{i}"), F.max(place - F.floor(place)).alias(f"__over{i}")]
        out.append((F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__over{i}")).alias(name))
    return near.groupBy(*keys).agg(*found).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *out)


#: Numbers up to which sums over ranks are added one by one; beyond, Euler and Maclaurin's formula is exact to rounding.
_FEW = 64


def _log_table(power: int) -> list[float]:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _FEW + 1)) ** power)]).tolist()


def _tail(n, ln, power: int):
    """The formula's part that depends on n: works on columns and on numbers."""
    x = ln(n)
    if power == 1:
        return n * x - n + x / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    return n * x * x - 2 * n * x + 2 * n + x * x / 2 + x / (6 * n) - (4 * x - 6) / (720 * n * n * n)


def _constant(power: int) -> float:
    return _log_table(power)[-1] - _tail(float(_FEW), math.log, power)


def log_sum(n: Column, power: int = 1) -> Column:
    """The sum of ln(k) ** power over k from 1 to *n*; *power* is 1 or 2."""
    x = n.cast("double")
    few = F.element_at(F.array(*[F.lit(v) for v in _log_table(power)]), F.least(n, F.lit(_FEW)).cast("int") + 1)
    return F.when(n <= _FEW, few).otherwise(F.lit(_constant(power)) + _tail(F.greatest(x, F.lit(1.0)), F.ln, power))


def log_run(first: Column, count: Column, power: int = 1) -> Column:
    """The sum of ln(k) ** power over *count* numbers from *first* on: one by one where they are few."""
    few = F.aggregate(F.sequence(first, first + F.least(count, F.lit(_FEW)) - 1), F.lit(0.0), lambda total, k: total + F.pow(F.ln(k), F.lit(float(power))))
    return F.when(count <= _FEW, few).otherwise(log_sum(first + count - 1, power) - log_sum(first - 1, power))
