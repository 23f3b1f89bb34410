"""Reuse metrics of directed dependency multigraphs.

Edges run from consumer to dependency.  Reuse is in-degree over distinct
consumers; multiplicity is a measure of its own.  Self-loops stay in a graph but
are no reuse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranks import quantiles
from weftline.session import written

# Named views of the nodes.
VIEWS = ["ALL", "NO_GENERATED", "THEOREM_ONLY", "DEF_ONLY", "THEOREM_AND_DEF", "USER_FACING_APPROX"]


@dataclass(frozen=True)
class Graph:
    """``nodes`` (node_id, name, kind, domain, ...), ``edges`` (src_id, dst_id, edge_type, multiplicity), ``external`` (node_id, name, ...)."""

    nodes: DataFrame
    edges: DataFrame
    external: DataFrame | None = None


def _zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in columns})


def reuse_edges(g: Graph) -> DataFrame:
    """Edges without self-loops whose target is a node of the graph."""
    return g.edges.where(F.col("src_id") != F.col("dst_id")).join(g.nodes.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi")


def node_metrics(g: Graph) -> DataFrame:
    """Nodes with unique-consumer in-degrees and occurrences, in all and by edge type, and the out-degree.

    Consumers may lie outside the graph; the out-degree counts every target, external ones and the node itself too.
    Pairs are reduced before they are counted, so that no distinct count is expanded.
    """
    typed = lambda t: F.col("edge_type") == t
    pairs = reuse_edges(g).groupBy("dst_id", "src_id").agg(
        F.max(typed("TYPE").cast("int")).alias("t"),
        F.max(typed("VALUE").cast("int")).alias("v"),
        F.sum("multiplicity").alias("m"),
        F.sum(F.when(typed("TYPE"), F.col("multiplicity"))).alias("mt"),
        F.sum(F.when(typed("VALUE"), F.col("multiplicity"))).alias("mv"),
    )
    incoming = pairs.groupBy("dst_id").agg(
        F.count(F.lit(1)).alias("in_degree_all"),
        F.sum("t").alias("in_degree_type"),
        F.sum("v").alias("in_degree_value"),
        F.sum("m").alias("in_occurrences_all"),
        F.sum("mt").alias("in_occurrences_type"),
        F.sum("mv").alias("in_occurrences_value"),
    )
    outgoing = g.edges.select("src_id", "dst_id").distinct().groupBy("src_id").agg(F.count(F.lit(1)).alias("out_degree_all"))
    out = g.nodes.join(incoming.withColumnRenamed("dst_id", "node_id"), "node_id", "left").join(outgoing.withColumnRenamed("src_id", "node_id"), "node_id", "left")
    return _zero(out, ["in_degree_all", "in_degree_type", "in_degree_value", "in_occurrences_all", "in_occurrences_type", "in_occurrences_value", "out_degree_all"])


def node_metrics_either_end(g: Graph) -> DataFrame:
    """In- and out-degrees of the SQL whose join condition is ``src = node OR dst = node``: two equi-joins instead."""
    side = lambda node, other, incoming: g.edges.select(F.col(node).alias("node_id"), F.col(other).alias("other"), F.lit(incoming).alias("incoming"), "edge_type")
    typed = lambda t: F.max((F.col("edge_type") == t).cast("int")) == 1
    pairs = side("dst_id", "src_id", True).unionByName(side("src_id", "dst_id", False)).groupBy("node_id", "other", "incoming").agg(typed("TYPE").alias("t"), typed("VALUE").alias("v"))
    reuse = F.col("incoming") & (F.col("other") != F.col("node_id"))
    made = pairs.groupBy("node_id").agg(
        F.count_if(reuse).alias("in_degree_all"),
        F.count_if(reuse & F.col("t")).alias("in_degree_type"),
        F.count_if(reuse & F.col("v")).alias("in_degree_value"),
        F.count_if(~F.col("incoming")).alias("out_degree_all"),
    )
    return _zero(g.nodes.join(made, "node_id", "left"), ["in_degree_all", "in_degree_type", "in_degree_value", "out_degree_all"])


def source_node_metrics(g: Graph) -> DataFrame:
    """Degrees and occurrences of a one-type graph: incoming between nodes of the graph, outgoing to any target, no self-loops."""
    plain = g.edges.where(F.col("src_id") != F.col("dst_id"))
    ids = g.nodes.select("node_id")
    inner = plain.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    incoming = inner.groupBy("dst_id", "src_id").agg(F.sum("multiplicity").alias("m")).groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("in_degree_source"), F.sum("m").alias("in_occurrences_source"))
    outgoing = plain.groupBy("src_id", "dst_id").agg(F.sum("multiplicity").alias("m")).groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("out_degree_source"), F.sum("m").alias("out_occurrences_source"))
    out = g.nodes.join(incoming, "node_id", "left").join(outgoing, "node_id", "left")
    return _zero(out, ["in_degree_source", "in_occurrences_source", "out_degree_source", "out_occurrences_source"])


def direct_use(links: DataFrame) -> DataFrame:
    """Callers and occurrences of each target; self-loops count."""
    return links.groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("direct_callers"), F.sum("multiplicity").cast("bigint").alias("direct_occurrences"))


def usage_edges(usages: DataFrame) -> DataFrame:
    """Attributed usages as edges with their number as multiplicity."""
    return usages.groupBy("snapshot_id", "src_id", "dst_id").agg(F.count(F.lit(1)).alias("multiplicity"))


def call_edges(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Call sites as typed edges (caller, callee, invoke kind), and those as links of the core graph."""
    typed = calls.groupBy("caller_id", "callee_id", "invoke_kind").agg(F.count(F.lit(1)).alias("multiplicity"))
    return typed, typed.groupBy(F.col("caller_id").alias("src_id"), F.col("callee_id").alias("dst_id")).agg(F.sum("multiplicity").alias("multiplicity"))


def dependency_pairs(g: Graph) -> DataFrame:
    """Distinct pairs between different nodes of the graph, edge types joined, with both domains."""
    pairs = g.edges.where(F.col("src_id") != F.col("dst_id")).groupBy("src_id", "dst_id").agg(F.sum("multiplicity").alias("multiplicity"))
    of = lambda end: g.nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("domain").alias(f"{end}_domain"))
    return pairs.join(of("src"), "src_id").join(of("dst"), "dst_id")


def share_of(column: str, by: str) -> Column:
    return F.col(column) / F.sum(column).over(Window.partitionBy(by))


def domain_matrix(g: Graph) -> DataFrame:
    """Edges between domains by type; the share is that of the source domain's edges of all types.  Self-loops count."""
    of = lambda end: g.nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("domain").alias(f"{end}_domain"))
    made = g.edges.join(of("src"), "src_id").join(of("dst"), "dst_id").groupBy("src_domain", "dst_domain", "edge_type").agg(F.count(F.lit(1)).alias("edge_count"))
    return made.withColumn("row_share", share_of("edge_count", "src_domain"))


def pair_matrix(pairs: DataFrame) -> DataFrame:
    """Distinct pairs and occurrences between domains, with the share of the source domain's pairs."""
    made = pairs.groupBy("src_domain", "dst_domain").agg(F.count(F.lit(1)).alias("dependency_pair_count"), F.sum("multiplicity").cast("bigint").alias("occurrence_count"))
    return made.withColumn("row_share", share_of("dependency_pair_count", "src_domain"))


def domain_flow(pairs: DataFrame) -> DataFrame:
    """For each source domain: pairs, share that stays inside, target domains, entropy of the targets and its exponential.

    Entropy is normalised by the logarithm of the number of target domains in all pairs; 0 where there is one.
    """
    matrix = pair_matrix(pairs)
    targets = pairs.agg(F.count_distinct("dst_domain").alias("targets"))
    inside = F.sum(F.when(F.col("src_domain") == F.col("dst_domain"), F.col("dependency_pair_count")).otherwise(0))
    made = matrix.groupBy(F.col("src_domain").alias("domain")).agg(
        F.sum("dependency_pair_count").alias("edge_count"),
        (inside / F.sum("dependency_pair_count")).alias("internal_dependency_share"),
        F.count(F.lit(1)).alias("outbound_domain_diversity"),
        (-F.sum(F.col("row_share") * F.ln("row_share"))).alias("entropy"),
    )
    normal = F.when(F.col("targets") > 1, F.col("entropy") / F.ln("targets")).otherwise(0.0)
    return made.crossJoin(F.broadcast(targets)).withColumns({"reference_entropy_proxy": normal, "effective_target_domains": F.exp("entropy")}).drop("targets")


def populations(metrics: DataFrame, g: Graph) -> DataFrame:
    """``population, value``: in-degrees of named populations, one row for each member.

    Populations of nodes hold zeros; those of edge types and of domains hold reused targets only.
    """
    reuse = reuse_edges(g)
    named = F.array_compact(
        F.array(
            F.lit("all_declarations"),
            F.when(F.col("kind") == "theorem", F.lit("theorems")),
            F.when(F.col("kind").isin("definition", "opaque"), F.lit("definitions")),
            F.concat(F.lit("kind:"), F.col("kind")),
        )
    )
    nodes = metrics.select(F.explode(named).alias("population"), F.col("in_degree_all").alias("value"))
    typed = reuse.groupBy("edge_type", "dst_id").agg(F.count_distinct("src_id").alias("value")).select(F.concat(F.lit("graph:"), F.col("edge_type")).alias("population"), "value")
    domains = dependency_pairs(g).groupBy("src_domain", "dst_id").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit("domain:"), F.col("src_domain")).alias("population"), "value")
    return nodes.unionByName(typed).unionByName(domains)


def in_views(metrics: DataFrame) -> DataFrame:
    """A row for each node and view that holds it; needs ``is_generated, is_internal, is_theorem, is_definition``."""
    holds = {
        "ALL": F.lit(True),
        "NO_GENERATED": ~F.col("is_generated"),
        "THEOREM_ONLY": F.col("is_theorem"),
        "DEF_ONLY": F.col("is_definition"),
        "THEOREM_AND_DEF": F.col("is_theorem") | F.col("is_definition"),
        "USER_FACING_APPROX": ~F.col("is_generated") & ~F.col("is_internal"),
    }
    return metrics.withColumn("view", F.explode(F.array_compact(F.array(*[F.when(holds[v], F.lit(v)) for v in VIEWS]))))


def value_availability(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("has_value").alias("with_value"), (F.count_if("has_value") / F.count(F.lit(1))).alias("share"))


def log2_bins(metrics: DataFrame, sizes: list[str], reuse: str = "in_degree_all") -> DataFrame:
    """Bins of ``floor(log2(size))`` of each positive size metric: count, medians and quartiles (linear) of reuse."""
    long = metrics.select(F.col(reuse).cast("double").alias("reuse"), F.explode(F.array(*[F.struct(F.lit(s).alias("length_metric"), F.col(s).cast("double").alias("length")) for s in sizes])).alias("x")).select("reuse", "x.*")
    by = ["length_metric", "log2_bin"]
    long = written(long.where(F.col("length") > 0).withColumn("log2_bin", F.floor(F.log2("length")).cast("int")), "lengths")
    lengths = quantiles(long, by, "length", {"length_median": 0.5})
    reused = quantiles(long, by, "reuse", {"reuse_median": 0.5, "reuse_q25": 0.25, "reuse_q75": 0.75})
    return long.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(lengths, by, "left").join(reused, by, "left")


def coverage(nodes: DataFrame, metrics: list[str]) -> DataFrame:
    """For each metric: rows with a value, their share, median, 90th and 99th percentile and maximum."""
    long = nodes.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.*")
    counts = long.groupBy("metric").agg(F.count("v").alias("n"), (F.count("v") / F.count(F.lit(1))).alias("coverage"), F.max("v").alias("max"))
    found = quantiles(long, ["metric"], "v", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    return counts.join(found, "metric", "left").select("metric", "n", "coverage", "median", "p90", "p99", "max")


def class_use(calls: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """For each class, distinct callees and calls across class, package and module borders; one grouping for all."""
    end = lambda who: methods.select(F.col("method_id").alias(f"{who}_id"), F.col("module").alias(f"{who}_module"), F.col("package").alias(f"{who}_package"), F.col("class").alias(f"{who}_class"))
    rows = calls.join(end("caller"), "caller_id").join(end("callee"), "callee_id")
    module = F.col("caller_module") != F.col("callee_module")
    scopes = {"cross_class": F.col("caller_class") != F.col("callee_class"), "cross_package": module | (F.col("caller_package") != F.col("callee_package")), "cross_module": module}
    pairs = rows.groupBy("caller_module", "caller_class", "callee_id").agg(*[F.count_if(p).alias(s) for s, p in scopes.items()])
    counts = [c for s in scopes for c in (F.count_if(F.col(s) > 0).alias(f"{s}_distinct"), F.sum(s).alias(f"{s}_occurrences"))]
    made = pairs.groupBy(F.col("caller_module").alias("module"), F.col("caller_class").alias("class")).agg(*counts)
    return _zero(classes.join(made, ["module", "class"], "left"), [f"{s}_{k}" for s in scopes for k in ("distinct", "occurrences")])


def summary(g: Graph, metrics: DataFrame) -> DataFrame:
    """Global counts as one row."""
    edges = g.edges.agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("edge_type") == "TYPE").alias("type_edges"),
        F.count_if(F.col("edge_type") == "VALUE").alias("value_edges"),
        F.sum("multiplicity").cast("bigint").alias("occurrences"),
        F.count_if(F.col("src_id") == F.col("dst_id")).alias("self_loops"),
    )
    pairs = g.edges.select("src_id", "dst_id").distinct().agg(F.count(F.lit(1)).alias("unique_pairs"))
    nodes = metrics.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.avg((F.col("in_degree_all") == 0).cast("double")).alias("zero_in_degree_fraction"),
        F.avg(((F.col("in_degree_all") == 0) & (F.col("out_degree_all") == 0)).cast("double")).alias("isolated_fraction"),
    )
    return nodes.crossJoin(F.broadcast(edges)).crossJoin(F.broadcast(pairs))
