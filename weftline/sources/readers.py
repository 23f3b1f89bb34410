"""Sources: record streams, TSV facts, nested JSON documents, texts, archives, configuration."""

from __future__ import annotations

import io
import tomllib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.quality import ContractError


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Temporary views over Parquet tables, for SQL text."""
    for name in names:
        parquet(spark, sf_dir, name).createOrReplaceTempView(name)


def records(spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines (plain, gzip or zstd) with a fixed schema.

    *strict* fails on a malformed line; otherwise such lines are kept in ``_corrupt_record``.  Paths
    without any file are an error.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    open_schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(open_schema).option("mode", "PERMISSIVE").json(paths)


def bad_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """``path, line, value``: the first malformed JSON line of each split of the files, its number counted from 1.

    A task reads a split's lines one after the other, so that a line's place in its split follows from the
    running id of its task; the lines of the splits before it in the file are added up, of which there are
    few.  One pass over the text.  Blank lines are no records, and count as lines.
    """
    kind = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    parsed = F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt_record"})
    bad = (F.trim("value") != "") & parsed["_corrupt_record"].isNotNull()
    place = F.when(bad, F.col("at"))
    splits = lines.groupBy("path", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min(place).alias("at"), F.min_by("value", place).alias("value"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start")) - F.col("n")
    return splits.withColumn("before", before).where(F.col("at").isNotNull()).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def checked_records(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """``records`` of files without a malformed line; else ``ContractError`` names the first ones as ``path:line``."""
    found = bad_lines(spark, paths, schema).orderBy("path", "line").limit(5).collect()
    if found:
        raise ContractError("malformed records: " + "; ".join(f"{r['path']}:{r['line']}" for r in found))
    return records(spark, paths, schema)


def of_kind(raw: DataFrame, kind: str) -> DataFrame:
    """The records of one kind of a mixed stream."""
    return raw.where(F.col("record") == kind)


def tsv(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Tab-separated facts with a header; fields of any length, no quoting, escapes kept as they are, empty fields null."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", maxCharsPerColumn=-1).csv(paths)


def nullable_int(column: str) -> F.Column:
    """An integer column in which the empty string is null."""
    return F.nullif(F.col(column), F.lit("")).cast("bigint")


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, text`` of whole text files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The ``modules`` array of a JSON inventory, one row each."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode("modules").alias("m")).select("m.*")


def constant_identity(encoded: F.Column) -> F.Column:
    """``struct<module,name>`` of an encoded constant key; null for local keys; malformed keys raise."""
    parsed = F.get_json_object(encoded, "$")
    module, name = F.get_json_object(encoded, "$.c.m"), F.get_json_object(encoded, "$.c.n")
    local = F.get_json_object(encoded, "$.f").isNotNull()
    bad = parsed.isNull() | (~local & (module.isNull() | name.isNull()))
    struct = F.struct(module.alias("module"), name.alias("name"))
    raised = F.raise_error(F.concat(F.lit("malformed reference key: "), F.coalesce(encoded, F.lit("null")))).cast("struct<module:string,name:string>")
    return F.when(F.coalesce(bad, F.lit(True)), raised).when(~local, struct)


def reference_documents(documents: DataFrame, snapshot: str) -> DataFrame:
    """Usages from nested documents ``path, text``: constant -> list of ``[sl, sc, el, ec, parent?]``.

    Local keys are skipped, repeated usages kept once; the columns are those of the atomic usage.
    """
    parsed = documents.select(
        F.get_json_object("text", "$.module").alias("module"),
        F.explode(F.from_json(F.get_json_object("text", "$.references"), "map<string,struct<usages:array<array<string>>>>")).alias("key", "value"),
    )
    rows = parsed.select("module", constant_identity(F.col("key")).alias("target"), F.explode("value.usages").alias("u")).where(F.col("target").isNotNull())
    at = lambda k: F.get("u", k).cast("bigint")
    return rows.select(
        F.lit(snapshot).alias("snapshot_id"),
        "module",
        F.get("u", 4).alias("parent_decl"),
        F.col("target.module").alias("target_module"),
        F.col("target.name").alias("target_decl"),
        at(0).alias("start_line"),
        at(1).alias("start_character"),
        at(2).alias("end_line"),
        at(3).alias("end_character"),
    ).distinct()


def archive_lines(spark: SparkSession, paths: str | list[str], wanted: DataFrame) -> DataFrame:
    """Line ranges of members of ZIP archives: *wanted* has ``archive, member, start, end`` (1-based, inclusive).

    Null where the member is missing.  Ranges are grouped by archive before the join, so each archive is opened once.
    """
    asked = wanted.groupBy("archive").agg(F.collect_list(F.struct("member", "start", "end")).alias("ranges"))
    blobs = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    joined = asked.join(blobs, "archive").select("archive", "ranges", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ranges, content in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for r in ranges:
                        try:
                            lines = z.read(r["member"]).decode("utf-8", "replace").splitlines()
                            excerpt = "\n".join(lines[r["start"] - 1 : r["end"]])
                        except KeyError:
                            excerpt = None
                        rows.append({"archive": name, **r, "excerpt": excerpt})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("excerpt", pa.string())]))

    return joined.mapInArrow(work, "archive string, member string, start bigint, end bigint, excerpt string")


def config(path: str) -> dict:
    """A TOML configuration."""
    with open(path, "rb") as f:
        return tomllib.load(f)
