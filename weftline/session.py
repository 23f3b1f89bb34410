"""Session helpers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Settings that bound a task's memory: rows and bytes of an Arrow batch, and of a Parquet row group that is being written.
BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "parquet.block.size": str(32 << 20),
}
#: Bytes of tables for each partition of a shuffle, at the least partitions; bytes of a partition that adaptive execution joins
#: small ones up to, and of a part of a file that a task reads.  A task's memory is set by these, not by the size of the tables.
TABLE_BYTES, MERGED_BYTES, SPLIT_BYTES = 4 << 20, 16 << 20, 16 << 20
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_before: dict[str, str | None] = {}
#: Python workers give freed memory back, as they are used again by later stages.
WORKERS = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(1 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(8 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """A session whose Python workers can import this package, whose clock is UTC and whose batches are bounded.

    The checkpoint folder is the one that the cluster names in ``spark.checkpoint.dir``;
    a local one is set only where that is unset, as in tests.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)
    spark.sparkContext.environment.update(WORKERS)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name, value in BOUNDS.items():
        spark.conf.set(name, value)
    for name, value in _before.items():  # what the last query's size had changed
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    _before.clear()
    checkpoint_dir(spark)
    return spark


def sized(spark: SparkSession, folder: str) -> None:
    """Partitions by the size of the tables in *folder*: their number grows with it, and none gets larger.

    Smaller bounds that the session has already stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    length = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    wanted = {INITIAL: max(least, -(-length // TABLE_BYTES))}
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", MERGED_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        wanted[name] = min(most, bytes_of(spark.conf.get(name)))
    for name, value in wanted.items():
        _before.setdefault(name, spark.conf.get(name, None))
        spark.conf.set(name, str(value))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        named = f"file://{tempfile.gettempdir()}/weftline-checkpoints-{os.getpid()}"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """*df* written as Parquet in the shared folder and read again: its lineage ends there, and it survives lost executors.

    Where columns to partition by are named, a filter on them reads their folders only.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again, and let Spark drop shuffle files of finished plans.

    Shuffle files go when the driver's JVM finds their plans unreachable; a driver that does little
    else may not look for a long time, so it is asked to.
    """
    import gc

    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
