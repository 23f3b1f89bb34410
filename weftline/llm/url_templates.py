"""URL filters by a path-template tree.

The paths of every host form a tree of segments.  Level by level, a segment value that is rare at its
node is variable and becomes a wildcard; the others stay.  From the deepest level up, branches of one
node whose pages are spread alike over what follows, and over labels, are merged.  What a page's path
comes to is its template; templates whose labelled pages are mostly blocked, by a smoothed share, are
rejected with all their pages.  Explicit rules label pages and overrule the templates.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import hot_keys
from weftline.session import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, TAIL = "*", "**"
#: Bins of what follows a branch, by hash; each has the labels blocked, allowed and none.
BINS, LABELS = 32, 3
#: The normal quantile at 0.05, one-sided.
SIGNIFICANT = 1.6448536


# --- urls and rules


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(host + path, verdict)`` that fits, and its verdict; null where none does.

    A rule fits its host and all subdomains where the path starts with the rule's.  Of two equally long
    rules the one of the longer host wins, then the one that is stated first.  The rules are a parameter
    and part of the plan.
    """
    found = verdict = None
    parts = sorted(((r.partition("/"), r, v) for r, v in rules), key=lambda x: (-len(x[1]), -len(x[0][0])))
    for (name, slash, tail), rule, v in parts:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        found = F.when(fits, F.lit(rule)) if found is None else found.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    none = F.lit(None).cast("string")
    return (none, none) if found is None else (found, verdict)


# --- the tree


def _token(segment: Column) -> Column:
    """A constant segment in a template: the signs that templates use are escaped."""
    return reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit(f"%{ord(sign):02X}")), "%*|()/", segment)


def generalise(pages: DataFrame, depth: int, support: int, share: int, hot: int = hot_keys.SHARE) -> DataFrame:
    """*pages* (``host``, ``path`` and others) with ``template``: the array of their path's tokens.

    At every node of a host's tree, a segment value stays if at least *support* pages and at least one in
    *share* of the node's pages have it, so that a node has at most *share* constants; all others are
    one wildcard.  After *depth* segments all that follows is one tail.
    """
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/", -1))
    rows = pages.withColumns({"segments": segments, "template": F.array().cast("array<string>")})
    rows = rows.withColumns({"more": F.size("segments") > depth, "segments": F.slice("segments", 1, depth)})
    state = written(rows.withColumn("node", F.lit("")), "templates-0")
    done = []
    for level in range(depth):
        active = state.where(F.size("segments") > level).withColumn("segment", F.get("segments", F.lit(level)))
        done.append(state.where(F.size("segments") <= level).drop("segments", "node"))
        seen = written(active.groupBy("host", "node", "segment").agg(F.count("*").alias("n")), f"segments-{level}")
        n_active, n_often = (int(x or 0) for x in seen.agg(F.sum("n"), F.count_if(F.col("n") >= support)).first())
        if not n_active:
            break
        nodes = written(seen.groupBy("host", "node").agg(F.sum("n").alias("visits"), F.count_if(F.col("n") >= support).alias("kids")), f"nodes-{level}")
        often = written(seen.where(F.col("n") >= support), f"often-{level}")
        stay = hot_keys.join(often, nodes, ["host", "node"], n_often, "kids", share=hot).where(F.col("n") * share >= F.col("visits"))
        stay = written(stay.select("host", "node", "segment", "n", _token(F.col("segment")).alias("token")), f"constants-{level}")
        named = hot_keys.join(active, stay, ["host", "node", "segment"], n_active, how="left", share=hot)
        token = F.coalesce("token", F.lit(WILD))
        moved = named.withColumns({"template": F.array_append("template", token), "node": F.concat("node", F.lit("/"), token)}).drop("segment", "token")
        state = written(moved.select(*state.columns), f"templates-{level + 1}")
        discard(pages.sparkSession, seen, nodes, often, stay)
    else:
        done.append(state.drop("segments", "node"))
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("template", F.when(F.col("more"), F.array_append("template", F.lit(TAIL))).otherwise(F.col("template"))).drop("more")


def alike(a: np.ndarray, b: np.ndarray, near: float) -> bool:
    """Whether two branches' counts over the same bins may be one distribution.

    Either the chi-square test of homogeneity (by Wilson and Hilferty's normal approximation) finds no
    difference at 0.05, or the distributions differ by less than *near* in total variation, as any
    difference is significant where very many pages are counted.
    """
    some = (a + b) > 0
    a, b = a[some].astype(float), b[some].astype(float)
    if abs(a / a.sum() - b / b.sum()).sum() / 2 <= near:
        return True
    both = (a + b) / (a.sum() + b.sum())
    x = sum(((c - c.sum() * both) ** 2 / (c.sum() * both)).sum() for c in (a, b))
    free = len(a) - 1
    return ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)) <= SIGNIFICANT


def merged_names(branches: list[tuple[str, np.ndarray]], near: float) -> dict[str, str]:
    """The name of each branch after merging: the largest branches lead, each other one joins the first leader that it is like."""
    leaders: list[tuple[list[str], np.ndarray]] = []
    for name, counts in sorted(branches, key=lambda b: (-b[1].sum(), b[0])):
        for members, sums in leaders:
            if alike(sums, counts, near):
                members.append(name)
                sums += counts
                break
        else:
            leaders.append(([name], counts.copy()))
    joined = lambda m: m[0] if len(m) == 1 else WILD if WILD in m else f"({'|'.join(sorted(m))})"
    return {name: joined(members) for members, _ in leaders for name in members}


def merge(templates: DataFrame, depth: int, near: float) -> DataFrame:
    """*templates* (``host, template, n, blocked, allowed``) with ``final``: the template after merging similar branches.

    A node has a bounded number of branches, each with a bounded number of bins: what a group of one
    node holds in memory does not grow with its pages.
    """

    def names(key: tuple, group: pa.Table) -> pa.Table:
        branches = []
        for child, at, counts in zip(*(group.column(c).to_pylist() for c in ("child", "at", "counts")), strict=True):
            bins = np.zeros(BINS * LABELS, np.int64)
            bins[at] = counts
            branches.append((child, bins))
        found = {k: v for k, v in merged_names(branches, near).items() if k != v}
        host, parent = (k.as_py() for k in key)
        return pa.Table.from_pylist([{"host": host, "parent": parent, "child": k, "name": v} for k, v in found.items()], pa.schema([(c, pa.string()) for c in ("host", "parent", "child", "name")]))

    spark = templates.sparkSession
    state = written(templates.withColumn("final", F.col("template")), "merge")
    for level in reversed(range(depth)):
        here = state.where(F.size("template") > level).withColumns({"parent": F.array_join(F.slice("template", 1, level), "/"), "child": F.get("template", F.lit(level))})
        follows = F.array_join(F.slice("final", level + 2, depth + 1), "/")
        labels = F.posexplode(F.array("blocked", "allowed", F.col("n") - F.col("blocked") - F.col("allowed"))).alias("label", "count")
        binned = here.select("host", "parent", "child", (F.pmod(F.xxhash64(follows), F.lit(BINS)) * LABELS).alias("bin"), labels).where(F.col("count") > 0)
        counts = binned.groupBy("host", "parent", "child", (F.col("bin") + F.col("label")).cast("int").alias("at")).agg(F.sum("count").alias("count"))
        profiles = counts.groupBy("host", "parent", "child").agg(F.collect_list(F.struct("at", "count")).alias("p")).select("host", "parent", "child", F.col("p.at").alias("at"), F.col("p.count").alias("counts"))
        found = profiles.groupBy("host", "parent").applyInArrow(names, "host string, parent string, child string, name string")
        new = F.concat(F.slice("final", 1, level), F.array("name"), F.slice("final", level + 2, depth + 1))
        renamed = here.join(found, ["host", "parent", "child"], "left").withColumn("final", F.when(F.col("name").isNull(), F.col("final")).otherwise(new))
        old, state = state, written(renamed.select(*state.columns).unionByName(state.where(F.size("template") <= level)), f"merge-{level}")
        discard(spark, old)
    return state


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", label: str | None = None, carry: list[str] | None = None,
    depth: int = 4, support: int = 3, share: int = 50, near: float = 0.05, prior: float = 0.1, strength: float = 2.0, reject: float = 0.5, hot: int = hot_keys.SHARE,
) -> DataFrame:
    """Pages allowed or blocked by the longest rule that fits their url, else by their path's template.

    Returns *carry* (default: all columns of *pages*), ``host, path``, ``rule`` and ``verdict`` (allow or
    block), ``template`` and ``purity``.  Purity is (blocked + *strength* x *prior*) / (labelled +
    *strength*) over the pages of a host's template; from *reject* on the template is rejected.  Labels
    are a rule's verdict, else the column *label* (1 blocked, 0 allowed, null none), if one is named.  A
    template without labelled pages has the prior, and allows.

    A null url and one without ``://`` have an empty host and path: all of them share one template, no rule
    fits, and they are allowed.  Urls of any length are parsed whole; a template tells apart the first
    *depth* segments.  Repeated rows count as often as they occur; an empty table gives an empty one;
    columns of *pages* with a name of the result are replaced.

    Shuffles: for each level the rows' urls by (host, node, segment), twice; hot nodes and segments are
    broadcast, at most *hot* of them, so that a host with a third of all pages is no single task.
    """
    spark = pages.sparkSession
    carry = pages.columns if carry is None else carry
    host, path = host_and_path(F.col(f"`{url}`"))
    told = F.col(f"`{label}`").cast("int") if label else F.lit(None).cast("int")
    parsed = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), host.alias("host"), path.alias("path"), told.alias("told"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": verdict})
    parsed = parsed.withColumn("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0).otherwise(F.col("told"))).drop("told")
    rows = written(generalise(parsed, depth, support, share, hot), "templates")
    seen = rows.groupBy("host", "template").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("blocked"), F.count_if(F.col("label") == 0).alias("allowed"))
    merged = merge(seen, depth, near)
    total = int(merged.agg(F.sum("n")).first()[0] or 0)
    final = merged.groupBy("host", "final").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    purity = (F.col("b") + strength * prior) / (F.col("b") + F.col("a") + strength)
    known = merged.select("host", "template", "n", "final").join(final, ["host", "final"])
    known = written(known.select("host", "template", "n", F.array_join(F.concat(F.array(F.lit("")), "final"), "/").alias("final"), purity.alias("purity")), "purities")
    discard(spark, merged)
    judged = hot_keys.join(rows, known, ["host", "template"], total, share=hot)
    by_template = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    kept = [F.col("row")[c].alias(c) for c in carry if c not in ("host", "path", "rule", "verdict", "template", "purity")]
    return judged.select(*kept, "host", "path", "rule", F.coalesce("ruled", by_template).alias("verdict"), F.col("final").alias("template"), "purity")
