"""Audits as tables: each check is a row with its failures, and passes where there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.quality import ContractError


def _stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """``check_name, failures, passed``: the rows of each table are what fails the check."""
    parts = [rows.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures") for name, rows in checks.items()]
    return _stacked(parts).withColumn("passed", F.col("failures") == 0)


def conservation(usages: DataFrame, kind: str, edges: DataFrame, keys: list[str], attributed: str = "attributed") -> DataFrame:
    """Nothing is lost between usages and the edges made of them.

    Every usage has one of the kinds, the edges' multiplicities add up to the attributed usages, no edge
    repeats, none has a multiplicity below one or a null end.
    """
    got = usages.agg(F.count_if(F.col(kind).isNull()).alias("unclassified"), F.count_if(F.col(kind) == attributed).alias("attributed"))
    made = edges.agg(F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("total"), F.count_if(F.col("multiplicity").isNull() | (F.col("multiplicity") < 1)).alias("below_one"), F.count_if(reduce(Column.__or__, [F.col(k).isNull() for k in keys])).alias("null_ends"))
    repeated = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    row = got.crossJoin(F.broadcast(made)).crossJoin(F.broadcast(repeated))
    checks = {"unclassified_usages": F.col("unclassified"), "multiplicity_differs_from_usages": F.abs(F.col("total") - F.col("attributed")), "repeated_edges": F.col("repeated"), "multiplicity_below_one": F.col("below_one"), "null_ends": F.col("null_ends")}
    long = row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), c.cast("bigint").alias("failures")) for name, c in checks.items()])).alias("x"))
    return long.select("x.check_name", "x.failures", (F.col("x.failures") == 0).alias("passed"))


def call_acceptance(methods: DataFrame, calls: DataFrame, typed: DataFrame, core: DataFrame, kinds: list[str], bodiless: Column, has_code: Column) -> DataFrame:
    """A call graph is whole: ends exist, edges and core links hold every call once, methods without a body have no code, every kind occurs."""
    ids = methods.select("method_id")
    of = lambda end: calls.select(F.col(f"{end}_id").alias("method_id")).join(ids, "method_id", "left_anti")
    wanted = calls.sparkSession.createDataFrame([(k,) for k in kinds], "invoke_kind string")
    found = counted({"callers_that_are_no_method": of("caller"), "callees_that_are_no_method": of("callee"), "bodiless_methods_with_code": methods.where(bodiless & has_code), "missing_invoke_kinds": wanted.join(calls.select("invoke_kind").distinct(), "invoke_kind", "left_anti")})
    n = calls.agg(F.count(F.lit(1)).alias("calls"))
    total = lambda df, name: df.agg(F.coalesce(F.sum("multiplicity"), F.lit(0)).alias("total")).crossJoin(F.broadcast(n)).select(F.lit(name).alias("check_name"), F.abs(F.col("total") - F.col("calls")).cast("bigint").alias("failures"))
    sums = total(typed, "typed_edges_lose_calls").unionByName(total(core, "core_links_lose_calls"))
    return found.unionByName(sums.withColumn("passed", F.col("failures") == 0))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``side, <keys>``: what one of two sets lacks; empty where they are equal, nulls are members like any other."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    same = lambda: reduce(Column.__and__, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    only = lambda x, y, name: x.alias("x").join(y.alias("y"), same(), "left_anti").select(F.lit(name).alias("side"), *keys)
    return only(a, b, "only_left").unionByName(only(b, a, "only_right"))


def exactly_one(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each wanted key; a key with none or with several raises ``ContractError`` that names some of them."""
    asked = wanted.select(*keys).distinct()
    wrong = asked.join(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "left").where(F.coalesce("n", F.lit(0)) != 1).limit(5).collect()
    if wrong:
        raise ContractError("not exactly one row: " + ", ".join(str(r.asDict()) for r in wrong))
    return rows.join(asked, keys, "left_semi")


def id_collisions(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """Ids that several keys share, with the number of keys and the first and last of them."""
    pairs = rows.select(id_column, key).where(F.col(key).isNotNull()).distinct()
    return pairs.groupBy(id_column).agg(F.count(F.lit(1)).alias("keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key")).where(F.col("keys") > 1)


def claims(results: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``claim, value, verdict`` from one row of results: each rule has the value and the condition that supports the claim.

    A null value or condition leaves a claim ``undecided``.
    """
    verdict = lambda ok: F.when(ok.isNull(), "undecided").when(ok, "supported").otherwise("refuted")
    rows = F.array(*[F.struct(F.lit(name).alias("claim"), value.cast("double").alias("value"), F.when(value.isNull(), "undecided").otherwise(verdict(ok)).alias("verdict")) for name, (value, ok) in rules.items()])
    return results.select(F.explode(rows).alias("x")).select("x.*")


def matrix_cells(matrix: DataFrame, count: str, least: int = 1, source: str | None = None, target: str | None = None, k: int = 80) -> DataFrame:
    """The largest cells of a domain matrix, of one source or target where named."""
    rows = matrix.where(F.col(count) >= least)
    for column, name in (("src_domain", source), ("dst_domain", target)):
        rows = rows if name is None else rows.where(F.col(column) == name)
    return rows.orderBy(F.desc(count), "src_domain", "dst_domain").limit(k)


def ratios(df: DataFrame, parts: dict[str, tuple[str, str]]) -> DataFrame:
    """*df* with ratio columns, null where the denominator is null or 0."""
    return df.withColumns({name: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for name, (a, b) in parts.items()})


def first_per_group(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row of each group by an order, as an aggregate: no group is sorted or held whole."""
    return rows.groupBy(*by).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("x")).select(*by, *[f"x.{c}" for c in columns if c not in by])
