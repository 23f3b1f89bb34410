"""Hand-computed values of the analysis kernels."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import limbs
from weftline.operators import concentration, intervals, mining, paths, quality, ranks, regression, samples, stats
from weftline.operators.graph import Graph, dependency_pairs, node_metrics, source_node_metrics
from weftline.operators.quality import ContractError


def _values(spark, values):
    return spark.createDataFrame([("g", float(v)) for v in values], "g string, value double")


def test_concentration_of_four_values(spark):
    r = concentration.concentration(_values(spark, [0, 0, 1, 3]), ["g"], fractions=(0.25,)).first()
    assert (r["n"], r["positive_n"], r["gini"], r["hhi"], r["top_25pct_share"]) == (4, 2, 0.625, 0.625, 0.75)
    with pytest.raises(ValueError):
        concentration.concentration(_values(spark, [1]), ["g"], fractions=(0.0,))
    zero = concentration.concentration(_values(spark, [0, 0]), ["g"]).first()
    assert (zero["gini"], zero["hhi"], zero["top_1pct_share"]) == (0, 0, 0)
    assert concentration.concentration(_values(spark, []), ["g"]).count() == 0


def test_concentration_against_sorted_ranks(spark):
    rng = random.Random(5)
    v = [rng.randrange(0, 30) for _ in range(300)]
    r = concentration.concentration(_values(spark, v), ["g"]).first()
    x = np.sort(np.array(v, float))
    n, t = len(x), x.sum()
    assert math.isclose(r["gini"], 2 * (np.arange(1, n + 1) * x).sum() / (n * t) - (n + 1) / n)
    assert math.isclose(r["top_5pct_share"], x[::-1][: math.ceil(n * 0.05)].sum() / t)


def test_ccdf_and_lorenz(spark):
    rows = {r["v"]: r["ccdf"] for r in concentration.ccdf(_values(spark, [0, 1, 1, 3]), ["g"]).collect()}
    assert rows == {1.0: 1.0, 3.0: 1 / 3}
    last = concentration.lorenz(_values(spark, [0, 1, 1, 2]), ["g"]).orderBy("v").collect()
    assert [(r["population_share"], r["value_share"]) for r in last] == [(0.25, 0.0), (0.75, 0.5), (1.0, 1.0)]


def _paths(spark, n, links):
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    df = spark.createDataFrame(links, "src_id bigint, dst_id bigint, multiplicity bigint")
    return {r["node_id"]: (r["in_paths"], r["is_path_cycle_boundary"]) for r in paths.incoming_paths(nodes, df).collect()}


CASES = {
    "chain": (4, [(0, 1, 1), (1, 2, 1)], ["0", "1", "2", "0"], []),
    "diamond": (4, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)], ["0", "1", "1", "4"], []),
    "weights": (3, [(0, 1, 2), (1, 2, 3)], ["0", "2", "9"], []),
    "cycle": (4, [(0, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 3)], ["0", "2", "1", "3"], [1, 2]),
    "self-loop": (4, [(0, 1, 1), (1, 1, 2), (1, 2, 3), (2, 3, 1)], ["0", "3", "3", "1"], [1]),
}


@pytest.mark.parametrize("case", CASES)
def test_path_counts(spark, case):
    n, links, counts, boundary = CASES[case]
    got = _paths(spark, n, links)
    assert [got[k][0] for k in range(n)] == counts
    assert [k for k in range(n) if got[k][1]] == boundary


def _reach(links):
    """Which nodes each node reaches."""
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    for k in out:
        for a in out:
            if k in out[a]:
                out[a] |= out[k]
    return out


def test_path_counts_by_brute_force(spark):
    """Cycles that share nodes with self-loops, nodes above, between and below them, a target of very many links."""
    rng = random.Random(8)
    links = {(rng.randrange(40), rng.randrange(40)): rng.choice([1, 2, 10**9, 2**62]) for _ in range(40)} | {(k, 41): 3 for k in range(40)}
    links |= {(5, 6): 2, (6, 7): 1, (7, 5): 3, (7, 7): 2, (9, 10): 1, (10, 9): 1, (6, 11): 5}
    reach = _reach(links)
    cyclic = {a for a in reach if a in reach[a]}

    def onward(node):
        return sum(m * (1 + onward(a)) for (a, b), m in links.items() if b == node and a not in cyclic)

    want = {k: (str(sum(m * (1 + (0 if a in cyclic else onward(a))) for (a, b), m in links.items() if b == k)), k in cyclic) for k in range(43)}
    assert 5 <= len(cyclic) < 30
    assert _paths(spark, 43, [(a, b, m) for (a, b), m in links.items()]) == want


def test_path_counts_beyond_machine_integers(spark):
    n, m = 16, 2**62 + 12345
    links = [(k, k + 1, m) for k in range(n - 1)]
    want = 0
    for _ in range(n - 1):
        want = m * (1 + want)
    got = paths.incoming_paths(spark.range(n).withColumnRenamed("id", "node_id"), spark.createDataFrame(links, "src_id bigint, dst_id bigint, multiplicity bigint")).where(f"node_id = {n - 1}").first()
    assert got["in_paths"] == str(want) and math.isclose(got["in_paths_log10"], math.log10(want))


def test_path_counts_without_links(spark):
    assert _paths(spark, 2, []) == {0: ("0", False), 1: ("0", False)}


@pytest.mark.parametrize("links", [[(0, 1, 0)], [(0, 1, 1), (0, 1, 2)], [(0, 9, 1)], [(9, 0, 1)]])
def test_path_count_contract(spark, links):
    with pytest.raises(ContractError):
        _paths(spark, 3, links)


def test_limbs(spark):
    """Products, sums and digits of whole numbers against Python's."""
    rng = random.Random(1)
    to = lambda n: [n // 10 ** (9 * i) % 10**9 for i in range(max(1, (len(str(n)) + 8) // 9))]
    rows = [(k % 3, rng.randrange(10 ** rng.randrange(1, 60)), rng.choice([0, 1, 10**9 - 1, 10**9, 2**63 - 1, rng.randrange(2**62)])) for k in range(200)] + [(0, 0, 2**63 - 1), (1, 10**45 - 1, 2**63 - 1)]
    df = spark.createDataFrame([(g, to(x), str(x), m) for g, x, m in rows], "g int, limbs array<bigint>, x string, m bigint")
    for r in df.select("x", "m", limbs.digits(limbs.times(F.col("limbs"), F.col("m"), 1)).alias("product"), limbs.digits(limbs.of_long(F.col("m"))).alias("long"), limbs.digits(F.col("limbs")).alias("same")).collect():
        assert (r["product"], r["long"], r["same"]) == (str(r["m"] * (1 + int(r["x"]))), str(r["m"]), r["x"])
    for r in limbs.Sums(["g"], n=F.count("*"))(df, 7).select("g", "n", limbs.digits(F.col("limbs")).alias("total")).collect():
        own = [x for g, x, _ in rows if g == r["g"]]
        assert (r["n"], r["total"]) == (len(own), str(sum(own)))


@pytest.mark.parametrize("seed, nodes, size", [(2, 25, 34), (3, 40, 44), (4, 12, 40)])
def test_cycles_by_trimming_and_reach(spark, seed, nodes, size):
    """Long and short cycles, self-loops, chains between them, repeated links and nulls."""
    rng = random.Random(seed)
    links = sorted({(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(size)}) + [(100 + k, 100 + (k + 1) % 9) for k in range(9)] + [(104, 200), (200, 201), (201, 300), (300, 300)]
    df = spark.createDataFrame([*links, links[0], (None, 1), (1, None)], "src_id bigint, dst_id bigint").withColumn("node", F.lit("x"))
    reach = _reach(links)
    assert sorted(r["node"] for r in paths.cyclic_nodes(df).collect()) == sorted(a for a in reach if a in reach[a])


def test_shared_dags_as_trees(spark):
    """Two DAGs at once: one of shared nodes with very many occurrences, one with ways of different lengths."""
    wide = [(1, k, k + 1) for k in range(12) for _ in range(100)]
    other = [(2, 0, 1), (2, 0, 2), (2, 1, 2), (2, 2, 3), (2, 2, 3), (2, 0, 4)]
    df = spark.createDataFrame(wide + other, "dag int, src int, dst int").withColumn("node", F.lit("x"))
    got = {r["dag"]: r.asDict() for r in paths.expression_table(df).collect()}
    assert got[1] == {"dag": 1, "tree_occurrences": str(sum(100**k for k in range(13))), "unique_nodes": 13, "arcs": 1200, "max_depth": 13}
    assert got[2] == {"dag": 2, "tree_occurrences": "9", "unique_nodes": 5, "arcs": 6, "max_depth": 4}
    assert {(r["dag"], r["leaf"], r["occurrences"]) for r in paths.leaf_table(df).collect()} == {(1, 12, str(100**12)), (2, 3, "4"), (2, 4, "1")}
    assert paths.expression_table(df.limit(0)).collect() == [] and paths.leaf_table(df.limit(0)).collect() == []


@pytest.mark.parametrize("arcs", [[(0, 1), (1, 2), (2, 1)], [(0, 2), (1, 2)], [(0, 1), (1, 0)]])
def test_shared_dag_contract(spark, arcs):
    with pytest.raises(ContractError):
        paths.expression_table(spark.createDataFrame([(1, *a) for a in arcs], "dag int, src int, dst int")).collect()


def test_links_to_themselves_need_no_search_for_cycles(spark, monkeypatch):
    """such links keep nothing waiting, so that only longer cycles are searched for; a node may have no other link."""
    monkeypatch.setattr(paths, "cyclic_nodes", lambda links: pytest.fail("searched for cycles"))
    got = _paths(spark, 7, [(0, 1, 2), (1, 1, 5), (1, 2, 3), (0, 2, 1), (2, 3, 10), (3, 3, 2**62), (6, 6, 4)])
    assert got == {0: ("0", False), 1: ("7", True), 2: ("4", False), 3: (str(20 + 2**62), True), 4: ("0", False), 5: ("0", False), 6: ("4", True)}


def test_cycles_write_links_again_only_where_some_go(spark, monkeypatch):
    """links that are all on cycles are written once, and whatever makes them runs once."""
    names, write = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 1), (5, 6), (6, 5), (6, 6)], "src_id bigint, dst_id bigint")
    assert sorted(r["node"] for r in paths.cyclic_nodes(df).collect()) == [0, 1, 2, 5, 6]
    assert names.count("core") == 1


def _seen_rounds(monkeypatch):
    seen, propagate = [], paths._propagate
    monkeypatch.setattr(paths, "_propagate", lambda rounds: seen.append(rounds) or propagate(rounds))
    return seen


def test_shared_dags_end_with_their_last_link(spark, monkeypatch):
    """F6 F8: no round after all links are passed; one write of the arcs, one sum of their ends, and no search for roots and leaves."""
    seen, names, write = _seen_rounds(monkeypatch), [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.createDataFrame([(1, -2, 2), (1, -2, 4), (1, 2, 5), (1, 4, 5), (1, 4, 5), (7, -2, 8)], "dag int, src int, dst int")
    assert {(r["dag"], r["leaf"], r["occurrences"]) for r in paths.leaf_table(df).collect()} == {(1, 5, "3"), (7, 8, "1")}
    assert {tuple(r) for r in paths.expression_table(df).collect()} == {(1, "6", 4, 5, 3), (7, "2", 2, 1, 2)}
    assert names == ["arcs", "ends", "links"] * 2
    assert [len(list(r.done().select("round").distinct().collect())) for r in seen] == [3, 3] and [r.round for r in seen] == [2, 2]


def test_path_counts_end_with_the_last_link(spark, monkeypatch):
    """F12 F13: as many rounds as the longest path has links."""
    seen = _seen_rounds(monkeypatch)
    assert _paths(spark, 6, [(k, k + 1, 1) for k in range(4)])[4] == ("4", False)
    assert [(r.round, r.left, r.waiting) for r in seen] == [(4, 0, 0)]


def test_short_limbs_are_exact_where_they_end(spark):
    """Around one and two limbs, where numbers are reckoned as longs; none of the array functions then runs."""
    near = [0, 1, 10**9 - 1, 10**9, 10**9 + 1, 99 * 10**16, 10**18 - 1, 10**18, 2**63 - 1, 10**27]
    to = lambda n: [n // 10 ** (9 * i) % 10**9 for i in range(max(1, (len(str(n)) + 8) // 9))]
    rows = [(k, to(x), str(x), m) for k, (x, m) in enumerate((x, m) for x in near for m in (0, 1, 2, 10**9 - 1, 10**9, 2**63 - 1))]
    df = spark.createDataFrame(rows, "k int, limbs array<bigint>, x string, m bigint")
    for r in df.select("x", "m", "limbs", limbs.digits(F.col("limbs")).alias("same"), limbs.times(F.col("limbs"), F.col("m"), 1).alias("product")).collect():
        assert r["same"] == r["x"] and r["product"] == to(r["m"] * (1 + int(r["x"])))
    twice = limbs.Sums(["k"])(df.select("k", "limbs").unionByName(df.select("k", "limbs")), 7)
    assert {r["k"]: r["limbs"] for r in twice.collect()} == {k: to(2 * int(x)) for k, _, x, _ in rows}


def test_ancestors_of_a_cyclic_hierarchy(spark):
    """Classes that inherit from each other end where an ancestor is there already; deep ones go on."""
    rows = [("m", "a", ["b"]), ("m", "b", ["c"]), ("m", "c", ["a", "top"]), ("n", "d", ["a"]), ("n", "top", [])]
    df = spark.createDataFrame(rows, "module string, class string, parents array<string>")
    got = {(r["class"], r["ancestor"], r["depth"]) for r in paths.ancestors(df).collect()}
    assert {x[1:] for x in got if x[0] == "a"} == {("a", 0), ("b", 1), ("c", 2), ("top", 3)}
    assert {x[1:] for x in got if x[0] == "d"} == {("d", 0), ("a", 1), ("b", 2), ("c", 3), ("top", 4)}


def test_node_metrics(spark):
    nodes = spark.createDataFrame([(k, f"n{k}", "theorem", "A") for k in (1, 2, 3)], "node_id bigint, name string, kind string, domain string")
    edges = spark.createDataFrame([(1, 2, "TYPE", 2), (1, 2, "VALUE", 5), (3, 2, "VALUE", 7), (2, 2, "VALUE", 100)], "src_id bigint, dst_id bigint, edge_type string, multiplicity bigint")
    r = node_metrics(Graph(nodes, edges)).where("node_id = 2").first()
    assert [r[c] for c in ("in_degree_all", "in_degree_type", "in_degree_value")] == [2, 1, 2]
    assert [r[c] for c in ("in_occurrences_all", "in_occurrences_type", "in_occurrences_value")] == [14, 2, 12]
    assert r["out_degree_all"] == 1  # itself
    pairs = dependency_pairs(Graph(nodes, edges)).collect()
    assert sorted((p["src_id"], p["dst_id"]) for p in pairs) == [(1, 2), (3, 2)]


def test_source_metrics(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "node_id bigint, domain string")
    edges = spark.createDataFrame([(1, 3, 4), (2, 3, 2), (3, 3, 9), (2, 1, 1)], "src_id bigint, dst_id bigint, multiplicity bigint")
    r = source_node_metrics(Graph(nodes, edges)).where("node_id = 3").first()
    assert (r["in_degree_source"], r["in_occurrences_source"], r["out_degree_source"]) == (2, 6, 0)
    p = paths.incoming_paths(nodes, edges).where("node_id = 3").first()
    assert (p["in_paths"], p["is_path_cycle_boundary"]) == ("19", True)


def test_small_primes():
    for top in (0, 1, 2, 3, 4, 5, 7, 24, 25, 49, 121, 1000):
        assert stats.small_primes(top).tolist() == [p for p in range(2, top + 1) if all(p % d for d in range(2, p))]
    primes = stats.small_primes(8000)
    assert all(primes[n - 1] <= stats.prime_bound(n) for n in range(1, len(primes) + 1))


def test_grouped_quantiles(spark):
    """Against linear interpolation on sorted values: one value in half of the rows, null groups, null values, single rows."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), 7.0 if rng.random() < 0.5 else rng.choice([rng.gauss(0, 9), rng.randrange(5)])) for _ in range(400)] + [("one", 3.5), ("none", None), ("a", None)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(6).withColumn("n", F.lit("x"))
    shares = {"least": 0.0, "q25": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0}
    got = {r["g"]: r for r in ranks.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        assert np.allclose([r[k] for k in shares], np.quantile(own, list(shares.values())))
    whole = ranks.quantiles(df, [], "v", shares).first()
    assert np.allclose([whole[k] for k in shares], np.quantile([v for _, v in rows if v is not None], list(shares.values())))
    assert ranks.quantiles(df.limit(0), ["g"], "v", shares).collect() == []


def test_spearman_with_a_value_in_most_rows(spark):
    """Average ranks of heavy ties against ranks by definition; nulls are left out, a constant has no correlation."""
    rng = random.Random(7)
    rows = [(0.0 if rng.random() < 0.6 else float(rng.randrange(40)), 1.0 if rng.random() < 0.5 else rng.gauss(0, 1)) for _ in range(300)]
    rows = [(x, y + x / 30) for x, y in rows]
    df = spark.createDataFrame([*rows, (None, 1.0), (2.0, None)], "a double, b double").withColumn("k", F.lit(1.0))
    rank = lambda v: [sum(o < x for o in v) + (sum(o == x for o in v) + 1) / 2 for x in v]
    want = np.corrcoef(rank([x for x, _ in rows]), rank([y for _, y in rows]))[0, 1]
    one, two = stats.spearman(df, [("a", "b"), ("a", "k")]).collect()
    assert one["n"] == 300 and math.isclose(one["rho"], want, rel_tol=1e-9)
    assert two["n"] == 301 and two["rho"] is None


def test_left_join_keeps_null_keys_out(spark):
    """Null keys are half of the rows: they stay, with no fact, and no task joins them."""
    rows = spark.createDataFrame([(None if k % 2 else f"n{k % 4}", k) for k in range(40)], "parent_decl string, at int").withColumn("module", F.lit("m"))
    facts = spark.createDataFrame([("n0", "m", 1), (None, "x", 9)], "name string, module string, node_id bigint")
    got = quality.classify_usages(rows, facts).groupBy("usage_class").count().collect()
    assert {r["usage_class"]: r["count"] for r in got} == {"unparented": 20, "unresolved": 10, "attributed": 10}


def test_primes_and_rank_shapes(spark):
    primes = [(r["prime"], r["rank"]) for r in stats.prime_ranks(spark, 400, segment=256).orderBy("rank").collect()]
    assert [p for p, _ in primes[:8]] == [2, 3, 5, 7, 11, 13, 17, 19] and [r for _, r in primes] == list(range(1, 401))
    assert [p for p, _ in primes] == stats.small_primes(primes[-1][0]).tolist()
    of = lambda numbers: {(r["range"], r["shape"]): r for r in stats.rank_shapes(spark.createDataFrame([(1e8 / float(k),) for k in numbers], "value double")).collect()}
    zipf = of(range(1, 1001))["all_positive", "zipf"]
    assert zipf["n"] == 1000 and zipf["fixed_rmse"] < 1e-12 and abs(zipf["free_beta"] - 1) < 1e-12
    prime = of(stats.small_primes(7919))
    assert prime["all_positive", "reciprocal_prime"]["fixed_rmse"] < 1e-12 < prime["all_positive", "zipf"]["fixed_rmse"]
    assert prime["top_1pct", "zipf"]["n"] == 20


def test_rank_shapes_of_ties_by_brute_force(spark):
    rng = random.Random(4)
    values = sorted([*(rng.choice([1, 1, 1, 2, 2, 3, 7]) for _ in range(290)), 80, 80, 60, 50, 50, 50, 45, 41, 41, 40], reverse=True)
    got = {(r["range"], r["shape"]): r for r in stats.rank_shapes(spark.createDataFrame([(float(v),) for v in values], "value double")).collect()}
    primes = stats.small_primes(5000)
    for (name, shape), r in got.items():
        n = 300 if name == "all_positive" else 20
        y = np.log10(values[:n])
        base = np.log10(np.arange(1, n + 1) if shape == "zipf" else primes[:n])
        e = y + base - (y + base).mean()
        slope, level = np.polyfit(base, y, 1)
        assert math.isclose(r["fixed_rmse"], math.sqrt((e * e).mean()), rel_tol=1e-9) and math.isclose(r["fixed_mae"], np.abs(e).mean(), rel_tol=1e-9)
        assert math.isclose(r["free_beta"], -slope, rel_tol=1e-9) and math.isclose(r["free_intercept"], level, rel_tol=1e-9)
        assert math.isclose(r["fixed_r_squared"], 1 - (e * e).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-9)
    assert len(got) == 4


def test_sums_over_ranks_in_closed_form(spark):
    runs = [(1, 1), (1, 64), (1, 65), (2, 100), (60, 500), (3, 100000), (999999, 64), (1000000, 70)]
    df = spark.createDataFrame(runs, "first bigint, c bigint")
    for r in df.select("first", "c", *[ranks.log_run(F.col("first"), F.col("c"), k).alias(f"p{k}") for k in (1, 2)]).collect():
        logs = np.log(np.arange(r["first"], r["first"] + r["c"], dtype=float))
        assert math.isclose(r["p1"], logs.sum(), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r["p2"], (logs**2).sum(), rel_tol=1e-9, abs_tol=1e-12)


def test_running_sums_over_a_total_order(spark):
    rows = [(k * 37 % 1000, k % 5) for k in range(1000)]
    got = ranks.running(spark.createDataFrame(rows, "k bigint, w bigint").repartition(7), [F.col("k")], F.col("w")).collect()
    total = 0
    for r in sorted(got, key=lambda r: r["k"]):
        assert r["before"] == total
        total += r["w"]
    assert len(got) == 1000


def test_cut_off_totals_by_plain_sums():
    for a, rate, first in ((1.5, 1e-3, 2.0), (2.5, 1e-5, 6.0), (0.7, 1e-2, 1.0), (3.0, 1e-9, 40.0)):
        k = first + np.arange(3_000_000)
        rest = (k[-1] + 0.5) ** (1 - a) / (a - 1) * math.exp(-rate * (k[-1] - first)) if a > 1 else 0.0
        assert math.isclose(stats._cut_total(a, rate, first), float((k**-a * np.exp(-rate * (k - first))).sum()) + rest, rel_tol=1e-6)


def test_rank_fit_of_zipf(spark):
    df = spark.createDataFrame([("g", 10000 / r) for r in range(1, 2001)], "g string, value double")
    r = stats.rank_frequency(df, ["g"], 0.0).first()
    assert r["status"] == "ok" and r["tail_n"] == 2000 and abs(r["beta_rank"] - 1) < 1e-9 and r["r_squared"] > 0.999999


def test_tail_fit_finds_the_exponent():
    rng = np.random.default_rng(1)
    x = np.floor(2.5 * (1 - rng.random(20000)) ** (-1 / 1.5) + 0.5)
    v, c = np.unique(x, return_counts=True)
    fit = stats.fit_tail_counts(v, c)
    assert fit["status"] == "ok" and abs(fit["alpha"] - 2.5) < 0.1
    assert stats.fit_tail_counts(np.array([1.0, 2.0]), np.array([5, 5]))["status"] == "insufficient_positive_observations"


def test_regression_recovers_a_negative_slope(spark):
    rows = [(x, max(1, int(800 / math.sqrt(x))), "k", "d") for x in range(1, 401)]
    r = regression.nb2(spark.createDataFrame(rows, "size bigint, in_degree_all bigint, kind string, domain string"), "size")
    assert r["status"] == "ok_nb2_fixed_dispersion" and r["n"] == 400 and r["coefficient"] < 0 and r["ci_high"] < 0
    assert r["effect_reference_value"] == 200.5 and r["doubling_effect_pct_at_reference"] < 0
    assert regression.nb2(spark.createDataFrame(rows[:5], "size bigint, in_degree_all bigint, kind string, domain string"), "size")["status"] == "insufficient_observations"


def test_regression_solves_the_score_equations(spark):
    """The fitted coefficient and errors are those of a dense Newton solution with kinds and domains as dummies."""
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(1, 300)), f"k{rng.integers(2)}", f"d{rng.integers(4)}") for _ in range(500)]
    rows = [(x, int(rng.poisson(rng.gamma(1.0, math.exp(1 - 0.3 * math.log1p(x) + 0.5 * (k == "k1") + 0.2 * int(d[1]))))), k, d) for x, k, d in rows]
    r = regression.nb2(spark.createDataFrame([*rows, (None, 1, "k0", "d0")], "size bigint, in_degree_all bigint, kind string, domain string"), "size")
    x = np.array([[1, math.log1p(v), k == "k1", *[d == f"d{j}" for j in (1, 2, 3)]] for v, _, k, d in rows], float)
    y = np.array([v for _, v, _, _ in rows], float)
    beta = np.zeros(x.shape[1])
    for _ in range(200):
        mu = np.exp(x @ beta)
        beta += 0.5 * np.linalg.solve((x * (mu / (1 + mu))[:, None]).T @ x, x.T @ ((y - mu) / (1 + mu)))
    mu = np.exp(x @ beta)
    bread = np.linalg.inv((x * (mu / (1 + mu))[:, None]).T @ x)
    s = (y - mu) / (1 + mu)
    robust = bread @ ((x * (s * s)[:, None]).T @ x) @ bread * (500 / 494)
    assert r["n"] == 500 and r["status"] == "ok_nb2_fixed_dispersion"
    assert math.isclose(r["coefficient"], beta[1], rel_tol=1e-5) and math.isclose(r["std_error"], math.sqrt(robust[1, 1]), rel_tol=1e-4)
    assert math.isclose(r["pearson_dispersion"], ((y - mu) ** 2 / (mu + mu * mu)).sum() / 494, rel_tol=1e-4)


def test_regressions_of_all_strata_at_once(spark):
    """Each fit is the one of its own rows alone, whatever the others do; small and empty strata are told."""
    rng = np.random.default_rng(10)
    rows = [(int(rng.integers(1, 200)), float(rng.integers(1, 9)), int(rng.poisson(2 + k % 3)), f"k{k % 2}", f"d{k % 5}") for k in range(300)] + [(5, None, 3, "k2", "d0")] * 10
    df = spark.createDataFrame(rows, "size bigint, bytes double, in_degree_all bigint, kind string, domain string").withColumn("fit", F.lit("x"))
    strata = {"all": F.lit(True), "k0": F.col("kind") == "k0", "few": F.col("kind") == "k2", "none": F.col("kind").isNull()}
    got = regression.nb2_strata(df, ["size", "bytes"], strata)
    assert [(r["length_metric"], r["stratum"], r["n"]) for r in got] == [("size", "all", 310), ("size", "k0", 150), ("size", "few", 10), ("size", "none", 0), ("bytes", "all", 300), ("bytes", "k0", 150), ("bytes", "few", 0), ("bytes", "none", 0)]
    assert [r["status"] for r in got] == [*["ok_nb2_fixed_dispersion"] * 2, *["insufficient_observations"] * 2] * 2
    for r, rows_ in ((got[1], df.where("kind = 'k0'")), (got[4], df)):
        alone = regression.nb2(rows_, r["length_metric"])
        assert all(math.isclose(r[k], alone[k], rel_tol=1e-7) for k in ("coefficient", "std_error", "pearson_dispersion", "effect_reference_value", "optimizer_iterations"))


def test_p_values():
    assert math.isclose(stats.student_p(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(float(stats._zeta(2.0, 1.0)), math.pi**2 / 6, rel_tol=1e-11)


def test_normality_of_a_normal_sample(spark):
    z = np.random.default_rng(3).normal(size=3000)
    r = stats.normality(spark.createDataFrame([(float(v),) for v in z], "z double"))
    assert r["shape_consistent"] and r["dagostino_p_value"] > 0.01 and r["anderson_statistic"] < 1.0
    # Brute force, with ties.
    z = np.sort(np.round(z, 1))
    r = stats.normality(spark.createDataFrame([(float(v),) for v in z], "z double"))
    n, k, normal = len(z), np.arange(1, len(z) + 1), NormalDist()
    u = (z - z.mean()) / z.std(ddof=1)
    low = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in u])
    ad = -n - ((2 * k - 1) * np.log(low) + (2 * (n - k) + 1) * np.log(1 - low)).sum() / n
    q = np.array([normal.inv_cdf((i - 0.5) / n) for i in k])
    assert math.isclose(r["anderson_statistic"], ad, rel_tol=1e-7) and math.isclose(r["qq_r_squared"], np.corrcoef(q, z)[0, 1] ** 2, rel_tol=1e-9)


def _greedy(symbols, sizes, lengths):
    out = {}
    for n in lengths:
        free = {}
        for i in range(len(symbols) - n + 1):
            p = tuple(symbols[i : i + n])
            if i >= free.get(p, 0):
                out.setdefault(p, []).append(sum(sizes[i : i + n]))
                free[p] = i + n
    return out


def test_occurrences_do_not_overlap(spark):
    rng = random.Random(8)
    rows = [(k, [rng.choice("ab") for _ in range(rng.randrange(0, 14))]) for k in range(12)]
    rows = [(k, s, [rng.randrange(1, 4) for _ in s]) for k, s in rows]
    got = mining.occurrences(spark.createDataFrame(rows, "id bigint, opcodes array<string>, sizes array<int>"), ["id"], lengths=range(2, 5), informative=None).collect()
    mine = {}
    for r in got:
        mine.setdefault((r["id"], tuple(r["pattern"])), []).append(r["bytes"])
    want = {(k, p): sorted(b) for k, s, z in rows for p, b in _greedy(s, z, range(2, 5)).items()}
    assert {k: sorted(v) for k, v in mine.items()} == want


def test_pattern_counts_add_up_occurrences(spark):
    """Long runs, nulls and the signs of packing; sequences of one group are added up, and only counts are shuffled."""
    rng = random.Random(9)
    made = [(k, f"g{k % 3}" if k % 7 else None, [rng.choice(["a", "a", "b", "\x1f", "\x1es", None]) for _ in range(rng.randrange(0, 16))]) for k in range(40)] + [(99, "g0", ["a"] * 200)]
    made = [(k, g, s, [rng.randrange(1, 4) for _ in s]) for k, g, s in made]
    rows = spark.createDataFrame(made, "id bigint, g string, opcodes array<string>, sizes array<int>")
    want = {}
    for _, g, s, z in made:
        for p, b in _greedy(s, z, range(2, 5)).items():
            n, total, held = want.get((g, p), (0, 0, 0))
            want[g, p] = n + len(b), total + sum(b), held + 1
    got = mining.pattern_counts(rows, ["g"], lengths=range(2, 5), informative=None).withColumn("pattern", mining.unpacked("pattern")).collect()
    assert len(got) == len(want) and {(r["g"], tuple(r["pattern"])): (r["n"], r["bytes"], r["rows"]) for r in got} == want
    some = mining.pattern_counts(rows, [], lengths=range(3, 4), informative=["b"]).withColumn("pattern", mining.unpacked("pattern")).collect()
    assert some and all("b" in r["pattern"] for r in some)
    assert {tuple(r["pattern"]): r["rows"] for r in some} == {p: sum(h for (_, q), (_, _, h) in want.items() if q == p) for p in {q for _, q in want if len(q) == 3 and "b" in q}}


def test_version_diff_and_adoption(spark):
    old, new = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    diff = mining.version_diff(old, new, "k")
    assert {r["k"]: r["change"] for r in diff.collect()} == {"a": "removed", "b": "retained", "c": "added"}
    calls = spark.createDataFrame([("b", "c"), ("c", "c"), ("b", "b")], "caller string, callee string")
    r = mining.adoption(diff, calls, spark.createDataFrame([("c", 10)], "k string, bytes bigint"), "k").first()
    assert (r["uses"], r["retained_uses"], r["gross_bytes"]) == (2, 1, 7)


def test_samples(spark):
    assert samples.log_ranks(3) == [1, 2, 3] and len(samples.log_ranks(10**6)) <= 281 and samples.log_ranks(10**6)[-1] == 10**6
    big = spark.createDataFrame([("9", 1), ("10", 2), ("100000000000000000000000000000000000000001", 3), ("10", 1)], "p string, id bigint")
    assert [(r["p"][:3], r["id"]) for r in samples.top_big_integers(big, "p", "id", 3).collect()] == [("100", 3), ("10", 1), ("10", 2)]
    heat = spark.createDataFrame([("A", "B", 1), ("Topology", "A", 100), ("NumberTheory", "Topology", 80), ("A", "B", 1)], "src_domain string, dst_domain string, dependency_pair_count bigint")
    assert [r["domain"] for r in samples.weighty_domains(heat, 3).collect()] == ["Topology", "A", "NumberTheory"]
    ext = spark.createDataFrame([(9, "x")], "node_id bigint, name string")
    edges = spark.createDataFrame([(1, 9, 2), (1, 9, 3), (2, 9, 1), (2, 3, 1)], "src_id bigint, dst_id bigint, multiplicity bigint")
    r = samples.external_targets(edges, ext).first()
    assert (r["unique_consumer_count"], r["pair_count"], r["occurrence_count"]) == (2, 3, 6)


def test_call_resolution_order(spark):
    classes = spark.createDataFrame([("m", "C", ["S", "I"]), ("m", "S", []), ("m", "I", []), ("x", "C", [])], "module string, class string, parents array<string>")
    methods = spark.createDataFrame(
        [(1, "m", "S", "f", "()"), (2, "m", "I", "f", "()"), (3, "m", "I", "g", "()"), (4, "x", "C", "h", "()"), (5, "java.base", paths.METHOD_HANDLE, "invoke", paths.ANY_RESULT)],
        "method_id bigint, module string, class string, name string, descriptor string",
    )
    calls = spark.createDataFrame(
        [(0, "m", "C", "f", "()", ""), (1, "m", "C", "g", "()", ""), (2, "m", "C", "h", "()", ""), (3, "m", "S", "f", "()", "BOOTSTRAP_HANDLE"), (4, "m", paths.METHOD_HANDLE, "invoke", "(I)V", ""), (5, "m", "C", "none", "()", "UNRESOLVED_DYNAMIC"), (6, "m", "Nowhere", "f", "()", "")],
        "call_id bigint, caller_module string, owner string, name string, descriptor string, hint string",
    )
    got = {r["call_id"]: (r["callee_id"], r["resolution"], r["reason"]) for r in paths.resolve_calls(calls, methods, classes).collect()}
    assert got == {
        0: (1, "INHERITED", None),
        1: (3, "INHERITED", None),
        2: (4, "EXACT", None),
        3: (1, "BOOTSTRAP_HANDLE", None),
        4: (5, "SIGNATURE_POLYMORPHIC", None),
        5: (None, None, "UNRESOLVED_DYNAMIC"),
        6: (None, None, "TARGET_NOT_IN_CORPUS"),
    }


def test_quantile_bins_are_right_closed(spark):
    df = spark.range(1, 101).withColumn("s", F.col("id").cast("double"))
    sizes = {r["bin"]: r["n"] for r in stats.quantile_bins(df, "s", 4).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 25, 1: 25, 2: 25, 3: 25}


def test_points_in_ranges_by_brute_force(spark):
    rng = random.Random(12)
    points = [(rng.randrange(3), rng.randrange(-50, 500)) for _ in range(300)]
    ranges_ = [(rng.randrange(3), lo, lo + rng.choice([0, 1, 3, 30, 400, -5])) for lo in (rng.randrange(-60, 500) for _ in range(120))]
    got = intervals.contained(spark.createDataFrame(points, "m int, at bigint"), spark.createDataFrame(ranges_, "m int, lo bigint, hi bigint"), ["m"], "at", "lo", "hi")
    want = sorted((m, at, lo, hi) for m, at in points for k, lo, hi in ranges_ if m == k and lo <= at <= hi)
    assert sorted((r["m"], r["at"], r["lo"], r["hi"]) for r in got.collect()) == want and len(want) > 500
    assert intervals.contained(spark.createDataFrame(points, "m int, at bigint"), spark.createDataFrame([], "m int, lo bigint, hi bigint"), ["m"], "at", "lo", "hi").count() == 0
