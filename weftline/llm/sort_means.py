"""Centroid clustering by sort-means: exact integer k-means that skips most distances.

Every round orders, for each centroid, the other centroids by their distance from it.  A vector looks
first at the centroid that it was assigned to, then along that centroid's order, and stops at the first
one that lies strictly beyond twice the vector's current distance: by the triangle inequality neither
that one nor any after it can be nearer, or as near with a smaller number.

All arithmetic is in integers, so that a round's result does not depend on the order of its rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import discard, written

#: Columns that ``cluster`` adds.
ADDED = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def largest_component(dims: int) -> int:
    """The largest absolute component with which four times a squared distance is a long."""
    return math.isqrt((2**63 - 1) // (16 * dims))


def integer_vectors(rows: DataFrame, embedding: str, dims: int, scale: int = 256) -> DataFrame:
    """The rows whose vector has *dims* components, none null or non-finite, with ``v``: floor(scale * x) of each.

    A component beyond ``largest_component`` stops the job with an error that names the bound, as its
    distances would not be longs.  All columns of *rows* stay; one called ``v`` is replaced.
    """
    x, bound = F.col(f"`{embedding}`"), largest_component(dims)
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) * scale < float(bound))
    kept = rows.where(F.coalesce(whole, F.lit(False)))
    return kept.withColumn("v", F.when(fits, F.transform(scaled, lambda c: c.cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {bound}")).cast("array<int>")))


def centroid_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all centroids by (squared distance, number), itself first, and those distances."""
    gaps = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
    numbers = np.arange(len(centroids))
    order = np.stack([np.array(sorted(numbers, key=lambda j, a=a: (j != a, gaps[a, j], j))) for a in numbers])
    return order, np.take_along_axis(gaps, order, axis=1)


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray, order: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row of *x* and its squared distance; ties go to the smaller number.

    ``start`` is the centroid that each row was assigned to before.
    """
    best = start.copy()
    current = ((x - centroids[start]) ** 2).sum(axis=1)
    least = current.copy()
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        for j, gap in zip(order[a, 1:], gaps[a, 1:], strict=True):
            rows = rows[gap <= 4 * current[rows]]
            if not len(rows):
                break
            far = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            better = (far < least[rows]) | ((far == least[rows]) & (j < best[rows]))
            best[rows[better]], least[rows[better]] = j, far[better]
    return best, least


def assign(state: DataFrame, centroids: np.ndarray, carry: list[str], keep_vectors: bool = True) -> DataFrame:
    """*state* (``v``, ``cluster``: the assignment so far, and *carry*) with the nearest centroids and distances."""
    order, gaps = centroid_order(centroids)
    kept = [*carry, "v"] if keep_vectors else carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), centroids.shape[1])
            best, least = nearest(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids, order, gaps)
            found = [batch.column(c) for c in kept] + [pa.array(best.astype(np.int32)), pa.array(least)]
            yield pa.RecordBatch.from_arrays(found, names=[*kept, "cluster", "distance"])

    kinds = dict(state.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "cluster int", "distance bigint"])
    return state.select(*kept, *([] if keep_vectors else ["v"]), "cluster").mapInArrow(run, schema)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that has vectors replaced by the floor of their exact mean, component by component."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(centroids.shape[1])]).alias("sums")).collect()
    out = centroids.copy()
    for row in sums:
        out[row.cluster] = [s // row.n for s in row.sums]
    return out


def cluster(rows: DataFrame, id: str, embedding: str, dims: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256, salt: str = "2:", carry: list[str] | None = None) -> DataFrame:
    """Integer k-means of the vectors with *dims* components, none null or non-finite; other rows are left out.

    Components become floor(scale * x).  Centroids start as the vectors with the smallest lower-case
    hex SHA-256 of *salt* and the decimal id (a null id: *salt* alone; rows of one id: by their
    components), in that order.  Every round assigns all vectors to the nearest centroid (ties: the
    smaller number) and moves the centroids that have any; then vectors are assigned once more.

    Returns *carry* (default: the id), ``cluster``, ``distance`` (squared), ``cluster_inertia`` and
    ``inertia`` (its sums over the cluster and over all), ``centroid_sha256`` (of the centroid's decimal
    components, joined by commas).  Rows with a null id and repeated rows are vectors of their own.  With
    fewer vectors than *clusters* there are as many centroids as vectors; of an empty table the result is
    empty.  Columns of *rows* beside *carry* are ignored; carried ones must not have an added name.

    No shuffle but the sums of each cluster: at most *clusters* rows from each task; these sums and the
    centroids, a size set by parameters, are all that the driver sees.  Between rounds the vectors are
    written with their assignments, so that a lost executor repeats its part of one round only.
    """
    spark = rows.sparkSession
    carry = [id] if carry is None else carry
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    kept = [f"c{i}" for i in range(len(carry))]
    chosen = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))), 256)
    state = integer_vectors(rows, embedding, dims, scale).select(*named, "v", chosen.alias("chosen"))
    first = [r.v for r in state.select("chosen", "v").orderBy("chosen", "v").limit(clusters).collect()]
    centroids = np.array(first, dtype=np.int64).reshape(len(first), dims)
    if not first:
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in ADDED.items()]
        return state.select(*[F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)], *empty).where(F.lit(False))
    state, last = state.withColumn("cluster", F.lit(0)), None
    for k in range(rounds):
        state = written(assign(state, centroids, kept).drop("distance"), f"sort-means-{k}")
        if last is not None:
            discard(spark, last)
        centroids, last = moved(state, centroids), state
    final = written(assign(state, centroids, kept, keep_vectors=False), "sort-means")
    if last is not None:
        discard(spark, last)
    inertia = {r.cluster: r.s for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(j, s, sum(inertia.values()), digests[j]) for j, s in inertia.items()]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return final.join(F.broadcast(told), "cluster").select(*[F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)], *ADDED)
