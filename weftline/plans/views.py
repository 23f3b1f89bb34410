"""Graph views over the benchmark tables: the same operators run on them as on any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.graph import Graph
from weftline.sources.readers import parquet

#: Parts above this size lie outside the graph, as external targets.
EXTERNAL_SIZE = 45


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "customer").select(
        (F.col("c_custkey") * 2).alias("node_id"), F.concat(F.lit("c:"), F.col("c_custkey")).alias("name"), F.lit("theorem").alias("kind"), F.col("c_mktsegment").alias("domain"), F.lit(None).cast("bigint").alias("size"), F.col("c_acctbal").alias("weight")
    )


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_type").substr(1, 1) < "M", "definition").otherwise("theorem")
    return parquet(spark, sf, "part").select(
        (F.col("p_partkey") * 2 + 1).alias("node_id"), F.concat(F.lit("p:"), F.col("p_partkey")).alias("name"), kind.alias("kind"), F.col("p_brand").alias("domain"), F.col("p_size").cast("bigint").alias("size"), F.col("p_retailprice").alias("weight")
    )


def typed_graph(spark: SparkSession, sf: str) -> Graph:
    """Customers reuse parts: one edge for each pair and line status, with the number of lines."""
    nodes = _customers(spark, sf).unionByName(_parts(spark, sf).where(F.col("size") <= EXTERNAL_SIZE))
    lines = parquet(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linestatus")
    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_linestatus") == "O", "TYPE").otherwise("VALUE")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") * 2).alias("src_id"), (F.col("l_partkey") * 2 + 1).alias("dst_id"), kind.alias("edge_type")).agg(F.count(F.lit(1)).alias("multiplicity"))
    external = _parts(spark, sf).where(F.col("size") > EXTERNAL_SIZE).select("node_id", "name")
    return Graph(nodes, edges, external)


TYPED_SQL = """
nodes AS (
  SELECT c_custkey * 2 AS node_id, 'c:' || c_custkey AS name, 'theorem' AS kind, c_mktsegment AS domain, CAST(NULL AS BIGINT) AS size FROM customer
  UNION ALL
  SELECT p_partkey * 2 + 1, 'p:' || p_partkey, CASE WHEN substr(p_type, 1, 1) < 'M' THEN 'definition' ELSE 'theorem' END, p_brand, CAST(p_size AS BIGINT) FROM part WHERE p_size <= 45
), external_nodes AS (
  SELECT p_partkey * 2 + 1 AS node_id, 'p:' || p_partkey AS name FROM part WHERE p_size > 45
), edges AS (
  SELECT o_custkey * 2 AS src_id, l_partkey * 2 + 1 AS dst_id, CASE WHEN l_linestatus = 'O' THEN 'TYPE' ELSE 'VALUE' END AS edge_type, count(*) AS multiplicity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
)"""


def sequence_graph(spark: SparkSession, sf: str) -> Graph:
    """A part leads to the part after it in its order; self-loops occur.  One edge type."""
    nodes = _parts(spark, sf).where(F.col("size") <= EXTERNAL_SIZE)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    lines = parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    steps = lines.withColumn("next", F.lead("l_partkey").over(w)).where(F.col("next").isNotNull())
    edges = steps.groupBy((F.col("l_partkey") * 2 + 1).alias("src_id"), (F.col("next") * 2 + 1).alias("dst_id")).agg(F.count(F.lit(1)).alias("multiplicity")).withColumn("edge_type", F.lit("SOURCE"))
    external = _parts(spark, sf).where(F.col("size") > EXTERNAL_SIZE).select("node_id", "name")
    return Graph(nodes, edges, external)


SEQUENCE_SQL = """
nodes AS (
  SELECT p_partkey * 2 + 1 AS node_id, 'p:' || p_partkey AS name, CASE WHEN substr(p_type, 1, 1) < 'M' THEN 'definition' ELSE 'theorem' END AS kind, p_brand AS domain, CAST(p_size AS BIGINT) AS size, p_retailprice AS weight FROM part WHERE p_size <= 45
), external_nodes AS (
  SELECT p_partkey * 2 + 1 AS node_id, 'p:' || p_partkey AS name FROM part WHERE p_size > 45
), steps AS (
  SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS next FROM lineitem
), edges AS (
  SELECT l_partkey * 2 + 1 AS src_id, next * 2 + 1 AS dst_id, count(*) AS multiplicity, 'SOURCE' AS edge_type FROM steps WHERE next IS NOT NULL GROUP BY ALL
)"""


def dag(spark: SparkSession, sf: str, loops: bool = False) -> Graph:
    """The sequence graph with all parts as nodes and links to larger ids only; with *loops* self-loops stay."""
    g = sequence_graph(spark, sf)
    keep = F.col("src_id") <= F.col("dst_id") if loops else F.col("src_id") < F.col("dst_id")
    return Graph(_parts(spark, sf), g.edges.where(keep))


def layered(spark: SparkSession, sf: str) -> Graph:
    """Orders reach customers and parts, customers nations, nations regions."""
    t = lambda n: parquet(spark, sf, n)
    edge = lambda df, a, b: df.select(a.alias("src_id"), b.alias("dst_id"))
    up = lambda c, k: F.col(c).cast("bigint") * 8 + k
    parts = [
        edge(t("orders"), up("o_orderkey", 0), up("o_custkey", 1)),
        edge(t("customer"), up("c_custkey", 1), up("c_nationkey", 2)),
        edge(t("nation"), up("n_nationkey", 2), up("n_regionkey", 3)),
    ]
    links = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("src_id", "dst_id").agg(F.count(F.lit(1)).alias("multiplicity"))
    nodes = links.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    return Graph(nodes, links.withColumn("edge_type", F.lit("SOURCE")))


def usages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines as atomic usages and customers as their parents: most are attributed, others fall in each of the other classes."""
    lines = parquet(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parent = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_partkey") % 17 == 0, F.concat(F.lit("x:"), F.col("o_custkey"))).otherwise(F.concat(F.lit("c:"), F.col("o_custkey")))
    module = F.when(F.col("l_partkey") % 13 == 0, F.lit("elsewhere")).otherwise(F.lit("shop"))
    made = rows.select(parent.alias("parent_decl"), module.alias("module"), F.concat(F.lit("p:"), F.col("l_partkey")).alias("target_decl"), "l_orderkey", "l_linenumber", "l_suppkey")
    nodes = _customers(spark, sf).withColumn("module", F.lit("shop"))
    return made, nodes


USAGES_SQL = """
usages AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_partkey % 17 = 0 THEN 'x:' || o_custkey ELSE 'c:' || o_custkey END AS parent_decl,
    CASE WHEN l_partkey % 13 = 0 THEN 'elsewhere' ELSE 'shop' END AS module, 'p:' || l_partkey AS target_decl
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), parents AS (
  SELECT 'c:' || c_custkey AS name, 'shop' AS module, c_custkey * 2 AS node_id FROM customer
)"""


def calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines as calls from customers to parts; both are methods of classes (nations, brands) in packages and modules."""
    customers = parquet(spark, sf, "customer").select((F.col("c_custkey") * 2).alias("method_id"), F.concat(F.lit("m"), F.col("c_nationkey") % 5).alias("module"), F.concat(F.lit("k"), F.col("c_nationkey") % 10).alias("package"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("class"))
    parts = parquet(spark, sf, "part").select((F.col("p_partkey") * 2 + 1).alias("method_id"), F.concat(F.lit("m"), F.col("p_size") % 5).alias("module"), F.concat(F.lit("k"), F.col("p_size") % 10).alias("package"), F.concat(F.lit("n"), F.col("p_size") % 25).alias("class"))
    methods = customers.unionByName(parts)
    lines = parquet(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kind = F.when(F.col("l_returnflag") == "A", "STATIC").when(F.col("l_returnflag") == "N", "VIRTUAL").otherwise("SPECIAL")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("caller_id"), (F.col("l_partkey") * 2 + 1).alias("callee_id"), kind.alias("invoke_kind"))
    return rows, methods, methods.select("module", "class").distinct()


CALLS_SQL = """
methods AS (
  SELECT c_custkey * 2 AS method_id, 'm' || (c_nationkey % 5) AS module, 'k' || (c_nationkey % 10) AS package, 'n' || c_nationkey AS class FROM customer
  UNION ALL SELECT p_partkey * 2 + 1, 'm' || (p_size % 5), 'k' || (p_size % 10), 'n' || (p_size % 25) FROM part
), calls AS (
  SELECT o_custkey * 2 AS caller_id, l_partkey * 2 + 1 AS callee_id, CASE l_returnflag WHEN 'A' THEN 'STATIC' WHEN 'N' THEN 'VIRTUAL' ELSE 'SPECIAL' END AS invoke_kind
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""
