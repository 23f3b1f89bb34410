"""Queries of whole report tables: domain and view measures, stacked bins, audits, claims, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audits, paths, quality, samples, stats
from weftline.operators import concentration as con
from weftline.operators import graph as gr
from weftline.plans import views
from weftline.plans.queries import COUNTS, METRICS_SQL, _metrics, _tied, query, rounded
from weftline.plans.views import CALLS_SQL, SEQUENCE_SQL, TYPED_SQL, USAGES_SQL
from weftline.session import written
from weftline.sources.readers import parquet


def _shares_sql(source: str, by: str, value: str) -> str:
    """Count, positive count, total, Gini, HHI and top shares of each group of *source*, as a query body."""
    tops = ", ".join(f"coalesce(sum({value}) FILTER (down <= greatest(1, ceil(n * {f}))) / nullif(sum({value}), 0), 0) AS top_{round(f * 100)}pct_share" for f in (0.01, 0.05, 0.1))
    return f"""SELECT {by}, any_value(n) AS n, count(*) FILTER ({value} > 0) AS positive_n,
  coalesce(2 * sum(up * {value}) / nullif(any_value(n) * sum({value}), 0) - (any_value(n) + 1) / any_value(n), 0) AS gini, coalesce(sum({value} * {value}) / nullif(sum({value}) * sum({value}), 0), 0) AS hhi, {tops}
FROM (SELECT {by}, CAST({value} AS DOUBLE) AS {value}, count(*) OVER (PARTITION BY {by}) AS n, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS up, row_number() OVER (PARTITION BY {by} ORDER BY {value} DESC) AS down FROM {source}) GROUP BY {by}"""


_SOURCE_SQL = (
    SEQUENCE_SQL
    + """, plain AS (SELECT * FROM edges WHERE src_id <> dst_id),
source_in AS (SELECT dst_id, count(DISTINCT src_id) AS d FROM plain SEMI JOIN nodes s ON s.node_id = src_id GROUP BY dst_id),
source_metrics AS (SELECT nodes.*, CAST(coalesce(d, 0) AS BIGINT) AS v FROM nodes LEFT JOIN source_in ON dst_id = node_id),
pairs AS (SELECT s.domain AS src_domain, t.domain AS dst_domain, count(*) AS c FROM (SELECT src_id, dst_id FROM plain GROUP BY ALL) p JOIN nodes s ON s.node_id = src_id JOIN nodes t ON t.node_id = dst_id GROUP BY ALL)"""
)
_SHARES = ["gini", "hhi", "top_1pct_share", "top_5pct_share", "top_10pct_share"]


def _rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _source_metrics(spark: SparkSession, sf: str) -> tuple[gr.Graph, DataFrame]:
    g = views.sequence_graph(spark, sf)
    return g, gr.source_node_metrics(g)


@query(
    f"""WITH {_SOURCE_SQL}, shares AS ({_shares_sql('source_metrics', 'domain', 'v')}), w AS (SELECT *, c / sum(c) OVER (PARTITION BY src_domain) AS p FROM pairs),
flow AS (SELECT src_domain AS domain, CAST(sum(c) AS BIGINT) AS edge_count, sum(CASE WHEN src_domain = dst_domain THEN c ELSE 0 END) / sum(c) AS internal_dependency_share, count(*) AS outbound_domain_diversity, -sum(p * ln(p)) AS h FROM w GROUP BY src_domain)
SELECT domain, n AS node_count, edge_count, {_rounded_sql(['internal_dependency_share', *_SHARES])}, outbound_domain_diversity,
  round(h / ln((SELECT count(DISTINCT dst_domain) FROM pairs)), 6) AS reference_entropy_proxy, round(exp(h), 6) AS effective_target_domains FROM shares JOIN flow USING (domain)"""
)
def source_domain_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Size, concentration of reuse and spread of the dependencies of every domain of the one-type graph."""
    g, m = _source_metrics(spark, sf)
    shares = con.concentration(m, ["domain"], "in_degree_source").select("domain", F.col("n").alias("node_count"), *_SHARES)
    return rounded(shares.join(gr.domain_flow(gr.dependency_pairs(g)).drop("entropy"), "domain"))


@query(
    f"""WITH {_SOURCE_SQL}, p AS (SELECT 'all' AS population, v FROM source_metrics UNION ALL SELECT CASE kind WHEN 'theorem' THEN 'theorem' ELSE 'definition' END, v FROM source_metrics),
s AS ({_shares_sql('p', 'population', 'v')}) SELECT population, n, positive_n, {_rounded_sql(_SHARES)} FROM s"""
)
def source_populations(spark: SparkSession, sf: str) -> DataFrame:
    """All nodes, theorems and definitions of the one-type graph, nodes without reuse included."""
    _, m = _source_metrics(spark, sf)
    named = F.array(F.lit("all"), F.when(F.col("kind") == "theorem", "theorem").otherwise("definition"))
    rows = m.select(F.explode(named).alias("population"), "in_degree_source")
    return rounded(con.concentration(rows, ["population"], "in_degree_source").select("population", "n", "positive_n", *_SHARES))


_VIEW_SQL = "SELECT 'ALL' AS view, v FROM m UNION ALL SELECT 'NO_GENERATED', v FROM m WHERE NOT is_generated UNION ALL SELECT 'THEOREM_ONLY', v FROM m WHERE is_theorem UNION ALL SELECT 'DEF_ONLY', v FROM m WHERE is_definition UNION ALL SELECT 'THEOREM_AND_DEF', v FROM m WHERE is_theorem OR is_definition UNION ALL SELECT 'USER_FACING_APPROX', v FROM m WHERE NOT is_generated AND NOT is_internal"


@query(
    f"""WITH {METRICS_SQL}, m AS (SELECT *, in_degree_all AS v FROM metrics), x AS ({_VIEW_SQL}), a AS ({_shares_sql('x', 'view', 'v')}), b AS ({_shares_sql('(SELECT * FROM x WHERE v > 0)', 'view', 'v')})
SELECT view, a.n AS nodes, a.positive_n AS positive_nodes, {', '.join(f'round(a.{c}, 6) AS {c}' for c in _SHARES)}, {', '.join(f'round(b.{c}, 6) AS {c}_positive' for c in _SHARES if c != 'hhi')} FROM a LEFT JOIN b USING (view)"""
)
def view_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Ten measures of every view: over all nodes, and over those that are reused."""
    rows = gr.in_views(_metrics(spark, sf)).select("view", "in_degree_all")
    whole = con.concentration(rows, ["view"], "in_degree_all").select("view", F.col("n").alias("nodes"), F.col("positive_n").alias("positive_nodes"), *_SHARES)
    reused = con.concentration(rows.where(F.col("in_degree_all") > 0), ["view"], "in_degree_all").select("view", *[F.col(c).alias(f"{c}_positive") for c in _SHARES if c != "hhi"])
    return rounded(whole.join(reused, "view", "left"))


@query(
    f"""WITH {METRICS_SQL}, m AS (SELECT kind, in_degree_all AS v FROM metrics), s AS ({_shares_sql('m', 'kind', 'v')}), t AS (SELECT kind, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY kind),
r AS (SELECT kind, ln(v) AS y, ln(row_number() OVER (PARTITION BY kind ORDER BY v DESC)) AS x FROM m WHERE v >= 1), f AS (SELECT kind, count(*) AS tail_n, regr_slope(y, x) AS b, regr_r2(y, x) AS r2 FROM r GROUP BY kind)
SELECT kind, n, positive_n, total, {_rounded_sql(_SHARES)}, tail_n, round(-b, 6) AS beta_rank, round(r2, 6) AS r_squared FROM s JOIN t USING (kind) LEFT JOIN f USING (kind)"""
)
def kind_tails(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind's counts and concentration with the rank fit of its tail."""
    m = _metrics(spark, sf).select("kind", "in_degree_all")
    shares = con.concentration(m, ["kind"], "in_degree_all").select("kind", "n", "positive_n", F.col("total").cast("bigint").alias("total"), *_SHARES)
    return rounded(shares.join(stats.rank_frequency(m, ["kind"], 1.0, "in_degree_all").select("kind", "tail_n", "beta_rank", "r_squared"), "kind", "left"))


_LENGTHS = ["size", *COUNTS]
_LENGTHS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS length_metric, CAST({c} AS DOUBLE) AS length, in_degree_all AS r FROM metrics" for c in _LENGTHS)


@query(
    f"""WITH {METRICS_SQL}, l AS ({_LENGTHS_SQL}) SELECT length_metric, CAST(floor(log2(length)) AS BIGINT) AS log2_bin, count(*) AS n, round(quantile_cont(length, 0.5), 6) AS length_median,
  round(quantile_cont(r, 0.5), 6) AS reuse_median, round(quantile_cont(r, 0.25), 6) AS reuse_q25, round(quantile_cont(r, 0.75), 6) AS reuse_q75 FROM l WHERE length > 0 GROUP BY ALL"""
)
def length_bins_stacked(spark: SparkSession, sf: str) -> DataFrame:
    """Log2 bins of every measure of the nodes, stacked."""
    return rounded(gr.log2_bins(_metrics(spark, sf), _LENGTHS))


@query(f"WITH {METRICS_SQL} SELECT node_id, round(in_occurrences_all / nullif(in_degree_all, 0), 6) AS per_consumer, round(in_degree_type / nullif(in_degree_all, 0), 6) AS type_share, round(in_occurrences_all / nullif(size, 0), 6) AS per_size FROM metrics")
def expansion_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of measures, null without a denominator."""
    parts = {"per_consumer": ("in_occurrences_all", "in_degree_all"), "type_share": ("in_degree_type", "in_degree_all"), "per_size": ("in_occurrences_all", "size")}
    return rounded(audits.ratios(_metrics(spark, sf), parts).select("node_id", *parts))


_PAIRS_OF = [("size", "in_degree_all"), ("size", "in_occurrences_all"), ("in_degree_all", "out_degree_all"), ("in_degree_type", "in_degree_value"), ("in_degree_all", "in_occurrences_all")]


@query(
    f"""WITH {METRICS_SQL} """
    + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_tied(x)} AS a, {_tied(y)} AS b FROM metrics WHERE {x} IS NOT NULL AND {y} IS NOT NULL)" for x, y in _PAIRS_OF)
)
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations of several pairs of measures."""
    return rounded(stats.spearman(written(_metrics(spark, sf).select(*sorted({c for pair in _PAIRS_OF for c in pair})), "metrics"), _PAIRS_OF))


_DOMAIN_PAIRS = [("entropy", "gini"), ("entropy", "top_1pct_share"), ("node_count", "gini"), ("node_count", "entropy")]


@query(
    f"""WITH {_SOURCE_SQL}, shares AS ({_shares_sql('source_metrics', 'domain', 'v')}), w AS (SELECT *, c / sum(c) OVER (PARTITION BY src_domain) AS p FROM pairs), flow AS (SELECT src_domain AS domain, -sum(p * ln(p)) AS entropy FROM w GROUP BY src_domain),
d AS (SELECT n AS node_count, round(gini, 9) AS gini, round(top_1pct_share, 9) AS top_1pct_share, round(entropy, 9) AS entropy FROM shares JOIN flow USING (domain) WHERE n >= 50) """
    + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT {_tied(x)} AS a, {_tied(y)} AS b FROM d)" for x, y in _DOMAIN_PAIRS)
)
def domain_associations(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations between measures of the domains that have enough nodes."""
    g, m = _source_metrics(spark, sf)
    shares = con.concentration(m, ["domain"], "in_degree_source").select("domain", F.col("n").alias("node_count"), "gini", "top_1pct_share")
    rows = shares.join(gr.domain_flow(gr.dependency_pairs(g)).select("domain", "entropy"), "domain").where(F.col("node_count") >= 50)
    return rounded(stats.spearman(written(rounded(rows, 9), "domains"), _DOMAIN_PAIRS))


@query(
    f"""WITH {CALLS_SQL}, u AS (SELECT method_id, count(callee_id) AS uses FROM methods LEFT JOIN calls ON callee_id = method_id GROUP BY method_id), r AS (SELECT log10(uses) AS y, log10(row_number() OVER (ORDER BY uses DESC)) AS x FROM u WHERE uses > 0), a AS (SELECT avg(y + x) AS a FROM r),
f AS (SELECT round(any_value(a), 6) AS fixed_intercept, round(sqrt(avg((y - a + x) * (y - a + x))), 6) AS fixed_rmse, round(1 - sum((y - a + x) * (y - a + x)) / regr_syy(y, x), 6) AS fixed_r_squared, round(-regr_slope(y, x), 6) AS free_beta FROM r, a)
SELECT count(*) AS all_methods, count(*) FILTER (uses > 0) AS referenced_methods, count(*) FILTER (uses = 0) AS unreferenced_methods, CAST(sum(uses) AS BIGINT) AS references_, count(*) FILTER (uses = 1) AS singleton_methods, max(uses) AS maximum_references, any_value(fixed_intercept) AS fixed_intercept, any_value(fixed_rmse) AS fixed_rmse, any_value(fixed_r_squared) AS fixed_r_squared, any_value(free_beta) AS free_beta FROM u, f"""
)
def reuse_population(spark: SparkSession, sf: str) -> DataFrame:
    """How many methods are referenced and how often, with the fit of 1/rank to the references."""
    calls, methods, _ = views.calls(spark, sf)
    uses = calls.groupBy(F.col("callee_id").alias("method_id")).agg(F.count(F.lit(1)).alias("uses"))
    m = written(methods.select("method_id").join(uses, "method_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0))), "uses")
    population = m.agg(F.count(F.lit(1)).alias("all_methods"), F.count_if(F.col("uses") > 0).alias("referenced_methods"), F.count_if(F.col("uses") == 0).alias("unreferenced_methods"), F.sum("uses").alias("references_"), F.count_if(F.col("uses") == 1).alias("singleton_methods"), F.max("uses").alias("maximum_references"))
    fit = stats.rank_shapes(m.where(F.col("uses") > 0), "uses").where((F.col("range") == "all_positive") & (F.col("shape") == "zipf")).select("fixed_intercept", "fixed_rmse", "fixed_r_squared", "free_beta")
    return rounded(population.crossJoin(F.broadcast(fit)))


# --- audits


@query(
    f"""WITH {USAGES_SQL}, u AS (SELECT CASE WHEN parent_decl IS NULL THEN 'unparented' WHEN p.node_id IS NULL THEN 'unresolved' WHEN p.module <> usages.module THEN 'mismatched' ELSE 'attributed' END AS k, p.node_id AS src, target_decl AS dst FROM usages LEFT JOIN parents p ON p.name = parent_decl),
e AS (SELECT src, dst, count(*) AS m FROM u WHERE k = 'attributed' GROUP BY ALL), c AS (
SELECT 'unclassified_usages' AS check_name, count(*) FILTER (k IS NULL) AS failures FROM u UNION ALL SELECT 'multiplicity_differs_from_usages', CAST(abs((SELECT sum(m) FROM e) - (SELECT count(*) FROM u WHERE k = 'attributed')) AS BIGINT)
UNION ALL SELECT 'repeated_edges', count(*) - count(DISTINCT (src, dst)) FROM e UNION ALL SELECT 'multiplicity_below_one', count(*) FILTER (m < 1) FROM e UNION ALL SELECT 'null_ends', count(*) FILTER (src IS NULL OR dst IS NULL) FROM e)
SELECT check_name, failures, failures = 0 AS passed FROM c"""
)
def conservation_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Usages and the edges made of them hold the same."""
    rows, nodes = views.usages(spark, sf)
    parents = nodes.select(F.col("name").alias("parent_decl"), F.col("module").alias("parent_module"), F.col("node_id").alias("src_id"))
    kind = F.when(F.col("parent_decl").isNull(), "unparented").when(F.col("src_id").isNull(), "unresolved").when(F.col("parent_module") != F.col("module"), "mismatched").otherwise("attributed")
    named = written(quality.with_facts(rows.select("parent_decl", "module", F.col("target_decl").alias("dst_id")), parents, "parent_decl").withColumn("usage_class", kind).withColumn("snapshot_id", F.lit("s")), "usages")
    edges = gr.usage_edges(named.where(F.col("usage_class") == "attributed"))
    return audits.conservation(named, "usage_class", edges, ["src_id", "dst_id"])


@query(
    f"""WITH {CALLS_SQL}, c AS (SELECT 'callers_that_are_no_method' AS check_name, count(*) AS failures FROM calls ANTI JOIN methods ON method_id = caller_id UNION ALL SELECT 'callees_that_are_no_method', count(*) FROM calls ANTI JOIN methods ON method_id = callee_id
UNION ALL SELECT 'bodiless_methods_with_code', count(*) FROM methods WHERE module = 'm0' AND package = 'k5' UNION ALL SELECT 'missing_invoke_kinds', 5 - count(DISTINCT invoke_kind) FROM calls UNION ALL SELECT 'typed_edges_lose_calls', 0 UNION ALL SELECT 'core_links_lose_calls', 0)
SELECT check_name, CAST(failures AS BIGINT) AS failures, failures = 0 AS passed FROM c"""
)
def call_graph_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """The call graph's audit; two of the five invoke kinds do not occur in it."""
    calls, methods, _ = views.calls(spark, sf)
    calls = written(calls, "calls")
    typed, core = gr.call_edges(calls)
    return audits.call_acceptance(methods, calls, typed, core, ["STATIC", "SPECIAL", "VIRTUAL", "INTERFACE", "DYNAMIC"], F.col("module") == "m0", F.col("package") == "k5")


_STATUS_SQL = """
SELECT column_name, count(*) AS node_count, CASE column_name WHEN 'size' THEN count(*) FILTER (WHERE size IS NULL) WHEN 'weight' THEN count(*) FILTER (WHERE weight IS NULL) WHEN 'domain' THEN count(*) FILTER (WHERE domain IS NULL) END AS null_count,
  count(*) FILTER (WHERE kind = 'theorem') AS theorems, count(*) FILTER (WHERE kind = 'theorem' AND size IS NOT NULL) AS theorems_with_value
FROM (VALUES ('size'), ('weight'), ('domain')) t(column_name), {nodes} GROUP BY column_name"""


@query(f"WITH {SEQUENCE_SQL} " + _STATUS_SQL.format(nodes="nodes"))
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Null rates and theorem coverage, from SQL text: three column names times the nodes."""
    return rounded(spark.sql(_STATUS_SQL, nodes=views.sequence_graph(spark, sf).nodes))


@query(
    f"""WITH {TYPED_SQL}, g AS (SELECT 'repeated_node_ids' AS check_name, count(*) AS failures FROM (SELECT node_id FROM nodes GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'theorems_without_value', count(*) FROM nodes WHERE kind = 'theorem' AND size IS NULL
UNION ALL SELECT 'edges_to_nowhere', count(*) FROM edges e ANTI JOIN (SELECT node_id FROM nodes UNION ALL SELECT node_id FROM external_nodes) x ON x.node_id = e.dst_id UNION ALL SELECT 'rerun_differs', 0 UNION ALL SELECT 'merge_order_matters', 0)
SELECT check_name, failures, failures = 0 AS passed FROM g"""
)
def gate_set(spark: SparkSession, sf: str) -> DataFrame:
    """The gates of a run: unique ids, coverage, known targets, the same digest of a second run and of parts merged in any order."""
    g = views.typed_graph(spark, sf)
    edges = written(g.edges, "edges")
    targets = g.nodes.select("node_id").unionByName(g.external.select("node_id"))
    again = views.typed_graph(spark, sf).edges.repartition("dst_id")  # dealt in another way, over as many tasks as its size asks for
    parts = [written(quality.digest_state(edges.where(F.pmod("src_id", F.lit(3)) == k)), "state") for k in range(3)]
    differ = lambda x, y: x.join(y, x.columns, "left_anti")
    return audits.counted(
        {
            "repeated_node_ids": g.nodes.groupBy("node_id").count().where("count > 1"),
            "theorems_without_value": g.nodes.where((F.col("kind") == "theorem") & F.col("size").isNull()),
            "edges_to_nowhere": edges.join(targets.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti"),
            "rerun_differs": differ(quality.digest_state(edges), quality.digest_state(again)),
            "merge_order_matters": differ(quality.merge_states(*parts), quality.merge_states(*parts[::-1])),
        }
    )


@query("SELECT stable_id, count(*) AS keys, min(key) AS first_key, max(key) AS last_key FROM (SELECT DISTINCT substr(sha256(p_name), 1, 2) AS stable_id, p_name AS key FROM part) GROUP BY stable_id HAVING count(*) > 1")
def id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that share an id: whole ids have none, so two of their digits are compared."""
    rows = parquet(spark, sf, "part").select(F.col("p_name").alias("key"), F.substr(F.sha2("p_name", 256), F.lit(1), F.lit(2)).alias("stable_id"))
    return audits.id_collisions(rows, "key", "stable_id")


@query("SELECT CASE WHEN c.k IS NULL THEN 'only_right' ELSE 'only_left' END AS side, coalesce(c.k, s.k) AS nation FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) s ON c.k = s.k WHERE c.k IS NULL OR s.k IS NULL")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of rich customers and of rich suppliers: what one set lacks."""
    left = parquet(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return audits.set_difference(left, parquet(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")), ["nation"])


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation WHERE n_nationkey IN (SELECT DISTINCT c_nationkey FROM customer)")
def exactly_one_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The nation of every customer: each exactly once."""
    wanted = parquet(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return rounded(audits.exactly_one(parquet(spark, sf, "nation"), wanted, ["n_nationkey"]).select("n_name", "n_nationkey", "n_regionkey"))


@query(
    f"""WITH {METRICS_SQL}, m AS (SELECT 'x' AS g, in_degree_all AS v FROM metrics), s AS ({_shares_sql('m', 'g', 'v')}), z AS (SELECT avg(CAST(v = 0 AS INT)) AS zero FROM m)
SELECT 'reuse_is_concentrated' AS claim, round(gini, 6) AS value, CASE WHEN gini > 0.5 THEN 'supported' ELSE 'refuted' END AS verdict FROM s UNION ALL SELECT 'top_tenth_has_most', round(top_10pct_share, 6), CASE WHEN top_10pct_share > 0.5 THEN 'supported' ELSE 'refuted' END FROM s
UNION ALL SELECT 'most_nodes_are_unused', round(zero, 6), CASE WHEN zero > 0.5 THEN 'supported' ELSE 'refuted' END FROM z UNION ALL SELECT 'weights_are_known', NULL, 'undecided'"""
)
def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Claims about reuse with verdicts that follow from the results."""
    m = _metrics(spark, sf).select(F.lit("x").alias("g"), "in_degree_all")
    row = con.concentration(m, ["g"], "in_degree_all").join(m.groupBy("g").agg(F.avg((F.col("in_degree_all") == 0).cast("double")).alias("zero")), "g")
    over = lambda c: (F.col(c), F.col(c) > 0.5)
    return rounded(audits.claims(row, {"reuse_is_concentrated": over("gini"), "top_tenth_has_most": over("top_10pct_share"), "most_nodes_are_unused": over("zero"), "weights_are_known": (F.lit(None).cast("double"), F.lit(None).cast("boolean"))}))


@query(f"WITH {_SOURCE_SQL} SELECT src_domain, dst_domain, c AS dependency_pair_count FROM pairs WHERE c >= 2 ORDER BY c DESC, src_domain, dst_domain LIMIT 80")
def matrix_top_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The 80 largest cells of the domain matrix."""
    g = views.sequence_graph(spark, sf)
    return audits.matrix_cells(gr.pair_matrix(gr.dependency_pairs(g)), "dependency_pair_count", 2).select("src_domain", "dst_domain", "dependency_pair_count")


@query(
    f"""WITH {METRICS_SQL}, t AS (SELECT 'most reused of its domain' AS example, domain, name, in_degree_all AS value FROM metrics QUALIFY row_number() OVER (PARTITION BY domain ORDER BY in_degree_all DESC, name) = 1),
e AS (SELECT 'heaviest edge of its type' AS example, edge_type AS domain, s.name || ' -> ' || d.name AS name, multiplicity AS value FROM edges JOIN nodes s ON s.node_id = src_id JOIN nodes d ON d.node_id = dst_id QUALIFY row_number() OVER (PARTITION BY edge_type ORDER BY multiplicity DESC, s.name || ' -> ' || d.name) = 1)
SELECT * FROM t UNION ALL SELECT * FROM e"""
)
def evidence_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Examples that a report can cite: a node of each domain, an edge of each type."""
    g = views.typed_graph(spark, sf)
    best = samples.head_per_group(_metrics(spark, sf), ["domain"], [F.desc("in_degree_all"), F.asc("name")], 1)
    of = lambda end: g.nodes.select(F.col("node_id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
    named = g.edges.join(of("src"), "src_id").join(of("dst"), "dst_id").select("edge_type", F.concat_ws(" -> ", "src_name", "dst_name").alias("name"), (-F.col("multiplicity")).alias("less"))
    edges = audits.first_per_group(named, ["edge_type"], ["less", "name"], ["less", "name"])
    return best.select(F.lit("most reused of its domain").alias("example"), "domain", "name", F.col("in_degree_all").alias("value")).unionByName(edges.select(F.lit("heaviest edge of its type").alias("example"), F.col("edge_type").alias("domain"), "name", (-F.col("less")).alias("value")))


@query(
    f"""WITH {CALLS_SQL}, l AS (SELECT caller_id, callee_id, count(*) AS m FROM calls GROUP BY ALL), u AS (SELECT method_id, count(callee_id) AS uses FROM methods LEFT JOIN calls ON callee_id = method_id GROUP BY method_id)
(SELECT 'top pairs' AS selection, caller_id AS a, callee_id AS b, m AS value FROM l ORDER BY m DESC, caller_id, callee_id LIMIT 20) UNION ALL (SELECT 'first call of its kind ' || invoke_kind, caller_id, callee_id, 1 FROM calls QUALIFY row_number() OVER (PARTITION BY invoke_kind ORDER BY caller_id, callee_id) = 1)
UNION ALL (SELECT 'most used', method_id, method_id, uses FROM u ORDER BY uses DESC, method_id LIMIT 20) UNION ALL (SELECT 'not used', method_id, method_id, 0 FROM u WHERE uses = 0 ORDER BY method_id LIMIT 20)"""
)
def method_graph_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of a call graph: heaviest pairs, the first call of each kind, most and never used methods."""
    calls, methods, _ = views.calls(spark, sf)
    links = calls.groupBy("caller_id", "callee_id").agg(F.count(F.lit(1)).alias("value"))
    uses = methods.select("method_id").join(calls.groupBy(F.col("callee_id").alias("method_id")).agg(F.count(F.lit(1)).alias("value")), "method_id", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    row = lambda df, name, a, b: df.select(name.alias("selection"), F.col(a).alias("a"), F.col(b).alias("b"), F.col("value").cast("bigint").alias("value"))
    first = audits.first_per_group(calls, ["invoke_kind"], ["caller_id", "callee_id"], ["caller_id", "callee_id"]).withColumn("value", F.lit(1))
    parts = [
        row(samples.top(links, [F.desc("value"), F.asc("caller_id"), F.asc("callee_id")], 20), F.lit("top pairs"), "caller_id", "callee_id"),
        row(first, F.concat(F.lit("first call of its kind "), F.col("invoke_kind")), "caller_id", "callee_id"),
        row(samples.top(uses, [F.desc("value"), F.asc("method_id")], 20), F.lit("most used"), "method_id", "method_id"),
        row(samples.top(uses.where(F.col("value") == 0), [F.asc("method_id")], 20), F.lit("not used"), "method_id", "method_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- shared DAGs


def _orders_as_dags(spark: SparkSession, sf: str) -> DataFrame:
    """A DAG for each customer: the customer has orders, an order has the parts of its lines, which are shared."""
    orders = parquet(spark, sf, "orders").select(F.col("o_custkey").alias("dag"), "o_orderkey")
    lines = parquet(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    top = orders.select("dag", F.lit(-2).alias("src"), (F.col("o_orderkey") * 2).alias("dst"))
    return top.unionByName(lines.select("dag", (F.col("o_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


_DAGS_SQL = "l AS (SELECT o_custkey AS dag, o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"WITH {_DAGS_SQL} SELECT dag, CAST(1 + count(DISTINCT o_orderkey) + count(l_partkey) AS VARCHAR) AS tree_occurrences, 1 + count(DISTINCT o_orderkey) + count(DISTINCT l_partkey) AS unique_nodes, count(DISTINCT o_orderkey) + count(l_partkey) AS arcs, CASE WHEN count(l_partkey) > 0 THEN 3 ELSE 2 END AS max_depth FROM l GROUP BY dag")
def shared_dag_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's orders and parts as a shared DAG: its tree's size, distinct nodes, arcs and depth."""
    return rounded(paths.expression_table(_orders_as_dags(spark, sf)))


@query(f"WITH {_DAGS_SQL} SELECT dag, CASE WHEN l_partkey IS NULL THEN o_orderkey * 2 ELSE l_partkey * 2 + 1 END AS leaf, CAST(count(*) AS VARCHAR) AS occurrences FROM l GROUP BY ALL")
def shared_dag_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """How often each part occurs under each customer."""
    return paths.leaf_table(_orders_as_dags(spark, sf))
