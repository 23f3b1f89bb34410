"""Resumable shards: a table in folders by shard, beside a manifest of what each holds and how it was made.

A run writes the shards that are missing, were made otherwise, or do not hold what the manifest says; valid
ones are left alone, so that a run that was stopped is taken up where it was, and a second run writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import discard, written

_LIMBS = 8
MANIFEST = "shard_key string, plan string, n_rows bigint, digest string"


def shard_digests(rows: DataFrame, shard: str) -> DataFrame:
    """``shard_key, n_rows, digest``: each shard as a multiset of rows, whatever their order and parts.

    Count, exclusive or and sum of the rows' SHA-256 are added up in the tasks: a shard with very many rows
    is no single task.  A null shard is a shard of its own, ``null``.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select(F.coalesce(F.col(f"`{shard}`").cast("string"), F.lit("null")).alias("shard_key"), F.sha2(row, 256).alias("h"))
    limb = lambda k: F.conv(F.substr("h", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint")
    parts = [x for k in range(_LIMBS) for x in (F.bit_xor(limb(k)).cast("string"), F.sum(limb(k).cast("decimal(38,0)")).cast("string"))]
    return hashed.groupBy("shard_key").agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", *parts), 256).alias("digest"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of all shards; files that cannot be read count as missing."""
    if not _exists(spark, f"{path}/data"):
        return like.limit(0)
    return spark.read.schema(like.schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{path}/data")


def valid_shards(spark: SparkSession, path: str, like: DataFrame, shard: str, plan: str) -> DataFrame:
    """``shard_key, digest`` of the shards that hold what the manifest says of *plan*."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "shard_key string, digest string")
    told = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").where(F.col("plan") == plan).select("shard_key", "n_rows", "digest").distinct()
    return shard_digests(stored(spark, path, like), shard).join(told, ["shard_key", "n_rows", "digest"]).select("shard_key", "digest")


def write_shards(rows: DataFrame, path: str, shard: str, plan: str) -> DataFrame:
    """Bring the shards under *path* to *rows*; returns ``shard_key, n_rows, digest`` of those that were written.

    *plan* names what makes the rows: other code or parameters are another plan, and write all anew.  Shards
    that *rows* lacks stay as they are.  A shard is replaced as a whole when its job commits, and is
    listed in the manifest after that: one that was replaced but not listed is written again.
    """
    spark = rows.sparkSession
    wanted = written(shard_digests(rows, shard), "shards-wanted")
    todo = written(wanted.join(valid_shards(spark, path, rows, shard, plan), ["shard_key", "digest"], "left_anti").select("shard_key", "n_rows", "digest"), "shards-todo")
    discard(spark, wanted)
    if todo.head(1):
        key = F.coalesce(F.col(f"`{shard}`").cast("string"), F.lit("null"))
        due = rows.withColumn("shard_key", key).join(todo.select("shard_key"), "shard_key", "left_semi").drop("shard_key")
        due.repartition(shard).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(f"{path}/data")
        todo.select("shard_key", F.lit(plan).alias("plan"), "n_rows", "digest").write.mode("append").parquet(f"{path}/manifest")
    return todo
