"""Sinks: Parquet, JSON lines, CSV, JSON documents, and installs that never change what is there."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.quality import digest
from weftline.operators.ranks import running


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """zstd Parquet with statistics; Spark's commit makes it all or nothing."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_batch(df: DataFrame, path: str, partition_by: str) -> None:
    """Add a batch of rows to a table partitioned by one column."""
    df.write.mode("append").option("compression", "zstd").partitionBy(partition_by).parquet(path)


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "gzip") -> None:
    """Compressed JSON lines, columns in the order of their names, rows sorted within parts.

    The codec ``zstd`` needs Hadoop's native library; files in it can be read without.
    """
    ordered = df.select(*sorted(df.columns))
    ordered.sortWithinPartitions(*[c for c, t in ordered.dtypes if not t.startswith("map")]).write.mode(mode).option("compression", codec).json(path)


def canonical(df: DataFrame, path: str, rows_per_part: int = 1_000_000) -> str:
    """JSON lines in one total order, in folders ``part=k`` of *rows_per_part* rows; returns a digest over all parts.

    Columns are in the order of their names, rows in the order of their lines.  A part is cut by exact rank,
    so that the bytes of each part and all digests are the same however *df* is partitioned.  Beside
    the parts lies ``digests``: the rows and the SHA-256 of every part's bytes.  Each part is one task's, which
    streams it; parts are independent.  Repeated rows stay repeated; an empty table has no parts.
    """
    spark = df.sparkSession
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    ranked = running(df.select(line.alias("value")), [F.col("value")], name="rank")
    parts = ranked.select("value", F.floor(F.col("rank") / rows_per_part).cast("bigint").alias("part"))
    parts.repartition("part").sortWithinPartitions("part", "value").write.partitionBy("part").text(f"{path}/lines")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, state = None, 0, None
        told = lambda: pa.RecordBatch.from_pydict({"part": [part], "n_rows": [n], "sha256": [state.hexdigest()]})
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != part:
                    if part is not None:
                        yield told()
                    part, n, state = k, 0, hashlib.sha256()
                n += 1
                state.update(value.encode() + b"\n")
        if part is not None:
            yield told()

    dealt = parts.repartition("part").sortWithinPartitions("part", "value").select("part", "value")
    dealt.mapInArrow(hashed, "part bigint, n_rows bigint, sha256 string").write.parquet(f"{path}/digests")
    digests = spark.read.schema("part bigint, n_rows bigint, sha256 string").parquet(f"{path}/digests")
    whole = hashlib.sha256()
    for r in digests.orderBy("part").toLocalIterator():
        whole.update(f"{r['part']} {r['n_rows']} {r['sha256']}\n".encode())
    return whole.hexdigest()


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file with a header, for results of report size."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def document(df: DataFrame, limit: int = 100_000) -> str:
    """A small result as canonical JSON text; more rows than *limit* are an error."""
    rows = df.limit(limit + 1).toJSON().collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them as a table")
    return json.dumps([json.loads(r) for r in rows], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def install(df: DataFrame, path: str) -> str:
    """Write once: a table with the same rows may be there already, another one is an error.  Returns the digest."""
    spark = df.sparkSession
    mine = digest(df)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        there = digest(spark.read.parquet(path).select(*df.columns))
        if there != mine:
            raise ValueError(f"{path} holds other rows")
        return mine
    parquet(df, path)
    return mine


def manifest(tables: dict[str, DataFrame]) -> dict:
    """Rows, digest and nulls of each table, and a hash over all."""
    out = {}
    for name, df in sorted(tables.items()):
        nulls = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first().asDict()
        out[name] = {"rows": nulls.pop("__rows"), "nulls": nulls, "digest": digest(df)}
    whole = hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()
    return {"tables": out, "sha256": whole}
