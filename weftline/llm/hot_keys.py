"""Joins of rows with one fact for each key where a few keys may hold much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot that holds one of so many rows, so that there are at most as many hot keys.
SHARE = 1000


def split(facts: DataFrame, total: int, n: str = "n", share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The facts of hot keys, at most *share* of them, and those of all others; *n* counts a key's rows, of *total* rows."""
    hot = F.col(n) * share >= total
    return facts.where(hot), facts.where(~hot)


def join(rows: DataFrame, facts: DataFrame, keys: list[str], total: int, n: str = "n", how: str = "inner", share: int = SHARE) -> DataFrame:
    """*rows* with the fact of their key; hot keys' facts, at most *share*, are broadcast, so that no task gets all rows of one.

    *facts* has one row for each key, with the number *n* of its rows in *rows*; *n* is not in the result.
    Both tables are read twice and should be written ones.  *how* is inner or left; null keys match nothing.
    """
    hot, cold = split(facts, total, n, share)
    hot = F.broadcast(hot)
    matched = rows.join(hot.drop(n), keys)
    others = rows.join(hot.select(*keys), keys, "left_anti").join(cold.drop(n).hint("merge"), keys, how)
    return matched.unionByName(others)
