"""Contracts, audits, deduplication and order-independent digests."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """An equi-join whose cardinality is checked first: ``m:1`` needs unique keys on the right, ``1:1`` on both sides."""
    for side, name, unique in ((left, "left", validate.startswith("1:")), (right, "right", validate.endswith(":1"))):
        if unique and duplicate_keys(side.select(*on).na.drop(), on).head(1):
            raise ContractError(f"join keys {on} are not unique on the {name}")
    return left.join(right, on, how)


def check(df: DataFrame, key: list[str] | None = None, not_null: list[str] = (), positive: list[str] = (), enums: dict[str, list[str]] | None = None) -> DataFrame:
    """``check_name, failures`` of a table's contract, in one pass and one grouped pass for the key."""
    tests = {f"null_{c}": F.col(c).isNull() for c in not_null}
    tests |= {f"missing_or_nonpositive_{c}": F.col(c).isNull() | (F.col(c) < 1) for c in positive}
    tests |= {f"unknown_{c}": ~F.col(c).isin(v) for c, v in (enums or {}).items()}
    parts = []
    if tests:
        row = df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
        pairs = ", ".join(f"'{n}', `{n}`" for n in tests)
        parts.append(row.selectExpr(f"stack({len(tests)}, {pairs}) AS (check_name, failures)"))
    if key:
        parts.append(duplicate_keys(df, key).agg(F.lit("duplicate_keys").alias("check_name"), F.count(F.lit(1)).alias("failures")))
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame) -> DataFrame:
    """``column_name, nulls`` for each column."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return row.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, nulls)")


def conflicts(df: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys with more than one distinct value in a column; null counts as a value."""
    counts = [F.count_distinct(F.struct(v)).alias(v) for v in values]
    return df.groupBy(*key).agg(*counts).where(reduce(Column.__or__, [F.col(v) > 1 for v in values]))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; nulls come first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.asc_nulls_first(c) for c in order]))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def canonical_edges(raw: DataFrame, key: tuple[str, ...] = ("snapshot_id", "src", "dst", "edge_type")) -> DataFrame:
    """One row for each typed edge: equal repeats are kept once, never summed.

    A null or non-positive multiplicity, or repeats that disagree, raise when the rows are computed.
    """
    bad = F.max(F.col("multiplicity").isNull() | (F.col("multiplicity") < 1))
    made = raw.groupBy(*key).agg(F.min("multiplicity").alias("low"), F.max("multiplicity").alias("high"), bad.alias("bad"))
    value = F.when(F.col("bad"), F.raise_error(F.lit("missing or non-positive multiplicity")).cast("bigint"))
    value = value.when(F.col("low") != F.col("high"), F.raise_error(F.lit("conflicting multiplicities of one edge")).cast("bigint"))
    return made.select(*key, value.otherwise(F.col("low").cast("bigint")).alias("multiplicity"))


def select_complexity(raw: DataFrame, nodes: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Complexity rows of the graph's nodes, by name and module, and the rows of other modules (aliases).

    A name whose rows disagree in a metric, and a node without a row, are errors.
    """
    if conflicts(raw, ["name"], metrics).head(1):
        raise ContractError("complexity rows of one name disagree")
    wanted = nodes.select("name", "module")
    chosen = keep_first(raw, ["name", "module"], metrics).join(wanted, ["name", "module"], "left_semi")
    if wanted.join(chosen, ["name", "module"], "left_anti").head(1):
        raise ContractError("a node has no complexity row")
    aliases = raw.join(wanted.select("name"), "name", "left_semi").join(wanted, ["name", "module"], "left_anti")
    return chosen, aliases


def classify_usages(usages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each usage with its class: unparented, unresolved (no such parent), mismatched (parent of another module), attributed."""
    parents = nodes.select(F.col("name").alias("parent_decl"), F.col("module").alias("parent_module"), F.col("node_id").alias("src_id"))
    kind = (
        F.when(F.col("parent_decl").isNull(), "unparented")
        .when(F.col("parent_module").isNull(), "unresolved")
        .when(F.col("parent_module") != F.col("module"), "mismatched")
        .otherwise("attributed")
    )
    return with_facts(usages, parents, "parent_decl").withColumn("usage_class", kind)


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """A left join that keeps rows with a null key out of it: they match nothing, and would all be one task's."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema.fields if f.name != key]
    return rows.where(F.col(key).isNotNull()).join(facts, key, "left").unionByName(rows.where(F.col(key).isNull()).select("*", *missing))


def dense_ids(names: DataFrame, column: str = "name") -> DataFrame:
    """``name, node_id`` from 0 in the order of distinct names, without a single-task sort.

    Range partitions are sorted on their own; each adds the number of names before it.
    """
    ordered = names.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).sortWithinPartitions(column)
    marked = ordered.select(column, F.monotonically_increasing_id().alias("at"))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    from weftline.session import written

    fixed = written(marked.select(column, part.alias("part"), place.alias("place")), "ids")
    sizes = fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return fixed.join(F.broadcast(before), "part").select(column, (F.col("before") + F.col("place")).alias("node_id"))


def shard_plan(modules: DataFrame, size: int = 25) -> DataFrame:
    """``module, shard``: sorted modules in chunks."""
    return dense_ids(modules, "module").select("module", F.floor(F.col("node_id") / size).alias("shard"))


_LIMBS = 8


def digest_state(df: DataFrame) -> DataFrame:
    """One row: the count, and XOR and sum of the rows' SHA-256 in 32-bit limbs; states of parts can be added up."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    hashed = df.select(F.sha2(row, 256).alias("h"))
    limb = lambda k: F.conv(F.substr("h", F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("bigint")
    limbs = hashed.select(*[limb(k).alias(f"l{k}") for k in range(_LIMBS)])
    total = lambda k: F.coalesce(F.sum(F.col(f"l{k}").cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return limbs.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.bit_xor(f"l{k}"), F.lit(0)).alias(f"x{k}") for k in range(_LIMBS)], *[total(k).alias(f"s{k}") for k in range(_LIMBS)])


def merge_states(*states: DataFrame) -> DataFrame:
    whole = reduce(DataFrame.unionByName, states)
    return whole.agg(F.sum("n").alias("n"), *[F.bit_xor(f"x{k}").alias(f"x{k}") for k in range(_LIMBS)], *[F.sum(f"s{k}").cast("decimal(38,0)").alias(f"s{k}") for k in range(_LIMBS)])


def state_digest(state: DataFrame) -> str:
    r = state.first()
    xor = sum(int(r[f"x{k}"]) << (32 * (_LIMBS - 1 - k)) for k in range(_LIMBS))
    total = sum(int(r[f"s{k}"]) << (32 * (_LIMBS - 1 - k)) for k in range(_LIMBS)) % (1 << 256)
    return hashlib.sha256(f"{r['n']}:{xor:064x}:{total:064x}".encode()).hexdigest()


def digest(df: DataFrame) -> str:
    """A digest of a table as a multiset of rows: neither order nor parts matter."""
    return state_digest(digest_state(df))
