"""Whole numbers without an upper bound as columns: arrays of limbs of nine decimal digits, the lowest first.

All of it is built-in functions.  A limb is below 10^9, so that products of two limbs and sums of up to nine
billion limbs are longs.  A number of up to two limbs is a long itself: where operands and result are, it is
reckoned as one, as functions over arrays take some ten times as long a row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 10**9
#: Doubles below this stand for longs below the square of the base: more than their rounding is left out.
_SMALL = 9.9e17


def _short(limbs: Column) -> Column:
    """The long that up to two limbs are."""
    return F.get(limbs, F.lit(0)) + F.coalesce(F.get(limbs, F.lit(1)), F.lit(0)) * BASE


def _split(x: Column) -> Column:
    """The limbs of a non-negative long below the square of the base."""
    return F.when(x < BASE, F.array(x)).otherwise(F.array(x % BASE, _div(x)))


def carried(limbs: Column) -> Column:
    """Limbs of any size up to a long's, carried on and without leading zeros; 0 has one limb."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("carry"))

    def step(acc: Column, limb: Column) -> Column:
        # The remainders are added, not the limbs, which may fill a long.
        low = limb % BASE + acc["carry"] % BASE
        return F.struct(F.array_append(acc["out"], low % BASE).alias("out"), (_div(limb) + _div(acc["carry"]) + _div(low)).alias("carry"))

    def end(acc: Column) -> Column:
        c = acc["carry"]
        return trimmed(F.concat(acc["out"], F.array(c % BASE, _div(c) % BASE, _div(_div(c)))))

    return F.aggregate(limbs, start, step, end)


def _div(x: Column) -> Column:
    """Whole quotient by the base of a non-negative long."""
    return F.call_function("div", x, F.lit(BASE).cast("bigint"))


def trimmed(limbs: Column) -> Column:
    """Limbs without leading zeros; 0 has one limb."""
    used = F.array_max(F.transform(limbs, lambda x, i: F.when(x != 0, i + 1).otherwise(1)))
    return F.slice(limbs, 1, used)


def times(limbs: Column, m: Column, add: int = 0) -> Column:
    """``m * (add + number)``; *m* is a non-negative long, *add* 0 or 1."""
    parts = [m % BASE, _div(m) % BASE, _div(_div(m))]
    x = lambda i: F.when(i >= 0, F.coalesce(F.get(limbs, i), F.lit(0)) + F.when(i == 0, add).otherwise(0)).otherwise(0)
    rows = F.transform(F.sequence(F.lit(0), F.size(limbs) + 1), lambda i: sum((x(i - k) * parts[k] for k in (1, 2)), x(i) * parts[0]))
    n = _short(limbs) + add
    small = (F.size(limbs) <= 2) & (n.cast("double") * m.cast("double") < _SMALL)
    return F.when(small, _split(n * m)).otherwise(carried(rows))


def of_long(m: Column) -> Column:
    """The limbs of a non-negative long."""
    return trimmed(F.array(m % BASE, _div(m) % BASE, _div(_div(m))))


def digits(limbs: Column) -> Column:
    """Decimal digits."""
    joined = F.array_join(F.transform(F.reverse(limbs), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 9, "0"))), "")
    return F.when(F.size(limbs) <= 2, _short(limbs).cast("string")).otherwise(joined)


class Sums:
    """Sums of ``limbs`` by *keys*, with other aggregates; its expressions are made once for a width and used again."""

    def __init__(self, keys: list[str], **others: Column):
        self.keys, self.others = keys, others
        self.made: dict[int, tuple[list[Column], list[Column]]] = {}

    def __call__(self, rows: DataFrame, width: int) -> DataFrame:
        """*width* is the most limbs that a row has.

        One sum for each limb, added up in the tasks before the shuffle: a key with very many rows is no single task.
        """
        width = (width + 3) // 4 * 4  # few widths: few plans to compile
        if width not in self.made:
            sums = [F.sum(F.coalesce(F.get("limbs", F.lit(i)), F.lit(0))).alias(f"__limb{i}") for i in range(width)]
            low, high = F.col("__limb0"), F.col("__limb1")
            small = (low.cast("double") + high.cast("double") * BASE < _SMALL) & reduce(and_, [F.col(f"__limb{i}") == 0 for i in range(2, width)])
            total = F.when(small, _split(low + high * BASE)).otherwise(carried(F.array(*[f"__limb{i}" for i in range(width)])))
            out = [*map(F.col, self.keys), total.alias("limbs"), *map(F.col, self.others)]
            self.made[width] = [*sums, *[c.alias(n) for n, c in self.others.items()]], out
        aggregates, out = self.made[width]
        return rows.groupBy(*self.keys).agg(*aggregates).select(*out)
