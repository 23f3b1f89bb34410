"""Negative binomial regressions on counted cells, all strata and length metrics at once.

Rows are counted by (fit, kind, domain, length, response) once.  Every round of iteratively reweighted least
squares adds the normal equations of all fits up on the executors in one job, by (fit, kind, domain); only
those sums reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranks import quantiles
from weftline.operators.stats import collected
from weftline.session import written

#: Pairs of kind and domain that a fit's normal equations may have.
MOST_GROUPS = 100_000


class _Design:
    """A fit's columns: intercept, ln(1 + length), kinds and domains but the first of each."""

    def __init__(self, groups: list[tuple[str, str]]):
        kinds, domains = (sorted({g[k] for g in groups}) for k in (0, 1))
        self.size = len(kinds) + len(domains)
        at_kind = {name: 1 + k for k, name in enumerate(kinds) if k}
        at_domain = {name: len(kinds) + k for k, name in enumerate(domains) if k}
        self.columns = {g: [0, *[at[x] for at, x in ((at_kind, g[0]), (at_domain, g[1])) if x in at]] for g in groups}
        self.beta, self.before, self.rounds, self.converged = np.zeros(self.size), math.inf, 0, False

    def gram(self, sums: list[dict], weight: str) -> np.ndarray:
        """The sum of weight times the outer product of the design, from its sums with 1, u and u squared."""
        out = np.zeros((self.size, self.size))
        for r in sums:
            at = self.columns[r["kind"], r["domain"]]
            out[np.ix_(at, at)] += r[weight]
            out[1, at] += r[f"{weight}u"]
            out[at, 1] += r[f"{weight}u"]
            out[1, 1] += r[f"{weight}uu"]
        return out

    def against(self, sums: list[dict], plain: str, with_u: str) -> np.ndarray:
        out = np.zeros(self.size)
        for r in sums:
            out[self.columns[r["kind"], r["domain"]]] += r[plain]
            out[1] += r[with_u]
        return out


def _powers(name: str, weight: Column) -> dict[str, Column]:
    return {name: weight, f"{name}u": weight * F.col("u"), f"{name}uu": weight * F.col("u") * F.col("u")}


def _sums(cells: DataFrame, designs: dict[int, _Design], means: dict[int, float], **measures: Column) -> dict[int, list[dict]]:
    """Sums by fit and group of measures of ``eta, mu, mean, u, y, c`` at each fit's coefficients; one job for all."""
    level = [(k, *g, float(d.beta[at].sum()), float(d.beta[1]), means[k]) for k, d in designs.items() for g, at in d.columns.items()]
    effects = cells.sparkSession.createDataFrame(level, "fit int, kind string, domain string, level double, slope double, mean double")
    eta = F.greatest(F.least(F.col("level") + F.col("slope") * F.col("u"), F.lit(30.0)), F.lit(-30.0))
    rows = cells.join(F.broadcast(effects), ["fit", "kind", "domain"]).withColumn("eta", eta).withColumn("mu", F.exp("eta"))
    out: dict[int, list[dict]] = {k: [] for k in designs}
    for r in rows.groupBy("fit", "kind", "domain").agg(*[F.sum(m).alias(name) for name, m in measures.items()]).collect():
        out[r["fit"]].append(r.asDict())
    return out


def nb2(df: DataFrame, length: str, response: str = "in_degree_all", kind: str = "kind", domain: str = "domain", rounds: int = 60, tolerance: float = 1e-11) -> dict:
    """One regression of all rows (``nb2_strata``)."""
    return nb2_strata(df, [length], {"all": F.lit(True)}, response, kind, domain, rounds, tolerance)[0]


def nb2_strata(df: DataFrame, lengths: list[str], strata: dict[str, Column], response: str = "in_degree_all", kind: str = "kind", domain: str = "domain", rounds: int = 60, tolerance: float = 1e-11) -> list[dict]:
    """Negative binomial regressions (dispersion 1, log link) of reuse on ln(1 + length) with kind and domain effects; HC1 errors.

    One for each length metric and stratum, in this order; a row is in every stratum whose condition holds.
    Rows with a null are left out.  A fit ends when its deviance changes by no more than *tolerance* of
    itself; all take as many jobs as the longest has rounds, and a few.
    """
    fits = [(x, name) for x in lengths for name in strata]
    places = F.array(*[F.when(strata[name], F.struct(F.lit(k).alias("fit"), F.col(x).cast("double").alias("raw"))) for k, (x, name) in enumerate(fits)])
    rows = df.select(F.col(kind).cast("string").alias("kind"), F.col(domain).cast("string").alias("domain"), F.col(response).cast("double").alias("y"), F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("p.fit", "kind", "domain", "p.raw", "y").na.drop()
    cells = written(rows.groupBy("fit", "kind", "domain", "raw", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("u", F.log1p("raw")), "cells")
    whole = {r["fit"]: r for r in cells.groupBy("fit").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("y")).alias("total")).collect()}
    medians = {r["fit"]: r["median"] for r in quantiles(rows, ["fit"], "raw", {"median": 0.5}).collect()}
    groups: dict[int, list] = {}
    for r in collected(cells.select("fit", "kind", "domain").distinct(), MOST_GROUPS * len(fits)).sort_values(["fit", "kind", "domain"]).to_dict("records"):
        groups.setdefault(r["fit"], []).append((r["kind"], r["domain"]))
    n = {k: int(whole[k]["n"]) if k in whole else 0 for k in range(len(fits))}
    designs = {k: _Design(groups[k]) for k in range(len(fits)) if n[k] >= 30}
    means = {k: whole[k]["total"] / n[k] for k in designs}
    c, y, mu = F.col("c"), F.col("y"), F.col("mu")
    open_ = dict(designs)
    for done in range(1, rounds + 1):
        if not open_:
            break
        # The first means lie half way between each response and the mean of all.
        m = mu if done > 1 else F.greatest((y + F.col("mean")) / 2, F.lit(1e-6))
        z = (F.col("eta") if done > 1 else F.ln(m)) + (y - m) / m
        w = c * m / (1 + m)
        sums = _sums(cells, open_, means, **_powers("w", w), z=w * z, zu=w * z * F.col("u"), deviance=c * ((y + 1) * F.log1p(m) - y * F.ln(m)))
        for k, got in sums.items():
            d, now = designs[k], sum(r["deviance"] for r in got)
            d.rounds = done
            if done > 2 and abs(d.before - now) <= tolerance * (1 + abs(now)):
                d.converged = True
                del open_[k]
                continue
            d.before = now
            d.beta = np.linalg.lstsq(d.gram(got, "w"), d.against(got, "z", "zu"), rcond=None)[0]
    score = (y - mu) / (1 + mu)
    last = _sums(cells, designs, means, **_powers("w", c * mu / (1 + mu)), **_powers("v", c * score * score), pearson=c * (y - mu) * (y - mu) / (mu + mu * mu)) if designs else {}
    # The names of the results and of their states.
    told = lambda k: {"length_metric": fits[k][0], "stratum": fits[k][1], "n": n[k], "status": "insufficient_observations"}
    return [told(k) | (_result(designs[k], last[k], n[k], float(medians[k])) if k in designs else {}) for k in range(len(fits))]


def _result(d: _Design, got: list[dict], n: int, reference: float) -> dict:
    bread = np.linalg.pinv(d.gram(got, "w"), hermitian=True)
    robust = bread @ d.gram(got, "v") @ bread * (n / max(n - d.size, 1))
    slope, se = float(d.beta[1]), math.sqrt(max(robust[1, 1], 0.0))
    doubled = math.log1p(2 * reference) - math.log1p(reference)
    return {
        "status": "ok_nb2_fixed_dispersion" if d.converged else "not_converged",
        "coefficient": slope,
        "std_error": se,
        "model_std_error": math.sqrt(max(bread[1, 1], 0.0)),
        "standard_error_type": "HC1_sandwich",
        "ci_low": slope - 1.96 * se,
        "ci_high": slope + 1.96 * se,
        "p_value": math.erfc(abs(slope / se) / math.sqrt(2)) if se else 0.0,
        "pearson_dispersion": sum(r["pearson"] for r in got) / max(n - d.size, 1),
        "effect_reference_value": reference,
        "doubling_effect_pct_at_reference": math.expm1(slope * doubled) * 100,
        "optimizer_iterations": d.rounds,
    }
