"""A bitmap of wanted ids, of fixed size, that lets a scan pass over most other rows before a shuffle.

It never loses a wanted row; rows that pass without being wanted are for the join that follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 22


def slot(key: Column | str) -> Column:
    """The bit of an id."""
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def bitmap(ids: DataFrame, key: str) -> np.ndarray:
    """Packed bits of the ids in a table: at most ``SLOTS`` numbers reach the driver."""
    bits = np.zeros(SLOTS, bool)
    bits[ids.select(slot(key).alias("slot")).distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)


def kept(packed: np.ndarray, slots: pa.Array) -> pa.Array:
    """Which rows may be wanted."""
    at = slots.to_numpy(zero_copy_only=False)
    return pa.array((packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))


def maybe(ids: DataFrame, key: str, column: Column) -> Column:
    """Whether *column* may be among the ids: only its slot travels to Python."""
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids, key))

    def told(slots: pa.Array) -> pa.Array:
        return kept(shared.value, slots)

    return F.arrow_udf(told, "boolean")(slot(column))
