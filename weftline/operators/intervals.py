"""Points in ranges, by bins of the ranges' own sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(points: DataFrame, ranges: DataFrame, by: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Pairs of *points* and the *ranges* of the same *by* that hold them, ends included: all columns of both.

    A range whose length lies below a power of two has a bin or two of that size; a point is looked up in
    the bin of every size that occurs, of which there are at most 64.  So the join is one of equal keys
    and its work follows the matches, not the product of a group's points and ranges.
    """
    level = F.ceil(F.log2((F.col(hi) - F.col(lo) + 1).cast("double"))).cast("int")
    size = lambda c: F.pow(F.lit(2.0), F.col("__level"))
    bin_of = lambda c: F.floor(F.col(c) / size(c))
    dealt = ranges.where(F.col(lo) <= F.col(hi)).withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    levels = [r[0] for r in dealt.select("__level").distinct().collect()]
    asked = points.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__bin", bin_of(at))
    return asked.join(dealt, [*by, "__level", "__bin"]).where((F.col(lo) <= F.col(at)) & (F.col(at) <= F.col(hi))).drop("__level", "__bin")
