"""Statistical kernels on histograms: tail fits, rank fits, correlations, normality.

Rows are reduced to distinct values with counts on the executors, and mostly to
sums there.  Tail fits take the histogram of whole-numbered values to the
driver: its size is checked, and a graph's degrees have at most as many distinct
values as the square root of twice its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.concentration import histogram, ranked_blocks
from weftline.operators.ranks import log_run, running
from weftline.operators.ranks import quantiles as grouped_quantiles
from weftline.session import written

#: Distinct values that a histogram on the driver may have.
DRIVER_BINS = 2_000_000


def collected(df: DataFrame, limit: int = DRIVER_BINS):
    """A small result as a pandas frame; more rows than *limit* are an error."""
    out = df.limit(limit + 1).toPandas()
    if len(out) > limit:
        raise ValueError(f"more than {limit} distinct rows")
    return out


def value_counts(values: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = collected(histogram(values, [], value)).sort_values("v")
    return got["v"].to_numpy(float), got["c"].to_numpy(np.int64)


# --- special functions


def _zeta(s: float, q: np.ndarray | float) -> np.ndarray:
    """Hurwitz zeta by Euler-Maclaurin."""
    q = np.asarray(q, float)
    k = np.arange(12)
    out = ((q[..., None] + k) ** -s).sum(-1)
    x = q + 12
    out += x ** (1 - s) / (s - 1) + 0.5 * x**-s + s / 12 * x ** (-s - 1) - s * (s + 1) * (s + 2) / 720 * x ** (-s - 3) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / 30240 * x ** (-s - 5)
    return out


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


# --- tails and ranks


def _loglik_powerlaw(v: np.ndarray, xmin: float, alpha: float) -> np.ndarray:
    return -alpha * np.log(v) - np.log(_zeta(alpha, xmin))


def _cut_total(a: float, rate: float, first: float) -> float:
    """The sum of k**-a * exp(-rate * (k - first)) over k from *first* on: some terms, then Euler and Maclaurin's formula."""
    k = first + np.arange(256)
    m = first + 256
    f = lambda x: x**-a * np.exp(-rate * (x - first))
    # The integral from m on, over s = ln(x / m), by Simpson's rule up to where nothing is left.
    top = math.log1p(60 / (rate * m)) if a <= 1.05 else min(math.log1p(60 / (rate * m)), 60 / (a - 1))
    s = np.linspace(0, top, 4001)
    x = m * np.exp(s)
    y = x ** (1 - a) * np.exp(-rate * (x - first))
    integral = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (s[1] - s[0]) / 3
    slope = -(a / m + rate) * f(m)
    return float(f(k).sum() + integral + f(m) / 2 - slope / 12)


def _golden(f, lo: float, hi: float, steps: int = 60) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def _vuong(one: np.ndarray, two: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """Normalised log-likelihood ratio and its p-value."""
    d, n = one - two, c.sum()
    mean = (c * d).sum() / n
    sd = math.sqrt(max((c * (d - mean) ** 2).sum() / n, 1e-300))
    r = math.sqrt(n) * mean / sd
    return float(r), math.erfc(abs(r) / math.sqrt(2))


def fit_tail_counts(v: np.ndarray, c: np.ndarray) -> dict:
    """Discrete power-law fit of a histogram: *xmin* of the least Kolmogorov distance, exponent by maximum likelihood.

    The comparisons are with a discretised lognormal and a power law with exponential cut-off on the same
    tail, both normalised over all whole numbers from *xmin* on.
    """
    keep = v > 0
    v, c = v[keep], c[keep]
    out = {"n": int(c.sum()), "status": "insufficient_positive_observations", "tail_n": None, "xmin": None, "alpha": None, "ks": None, "bootstrap_p": None, "powerlaw_vs_lognormal_r": None, "powerlaw_vs_lognormal_p": None, "powerlaw_vs_truncated_r": None, "powerlaw_vs_truncated_p": None}
    if c.sum() < 20 or len(v) < 3:
        return out
    best = (math.inf, 0, 0.0)
    tail_c = np.cumsum(c[::-1])[::-1]
    tail_log = np.cumsum((c * np.log(v))[::-1])[::-1]
    for i in range(len(v) - 2):
        n, s = tail_c[i], tail_log[i]
        if n < 10:
            break
        alpha = _golden(lambda a: a * s + n * math.log(float(_zeta(a, v[i]))), 1.01, 8.0, 40)
        model = 1 - _zeta(alpha, v[i:] + 1) / _zeta(alpha, v[i])
        ks = np.abs(np.cumsum(c[i:]) / n - model).max()
        if ks < best[0]:
            best = (float(ks), i, alpha)
    ks, i, alpha = best
    t, w = v[i:], c[i:]
    power = _loglik_powerlaw(t, t[0], alpha)

    def lognormal(mu: float, sd: float) -> np.ndarray:
        cdf = lambda x: 0.5 * np.array([math.erfc(-(math.log(y) - mu) / (sd * math.sqrt(2))) for y in np.maximum(x, 1e-9)])
        low, high = cdf(t - 0.5), cdf(t + 0.5)
        above = max(1 - float(cdf(np.array([t[0] - 0.5]))[0]), 1e-300)
        return np.log(np.maximum(high - low, 1e-300) / above)

    mean, sd = (w * np.log(t)).sum() / w.sum(), 1.0
    sd = max(math.sqrt((w * (np.log(t) - mean) ** 2).sum() / w.sum()), 0.1)
    for _ in range(4):
        mean = _golden(lambda m: -(w * lognormal(m, sd)).sum(), mean - 6, mean + 4, 30)
        sd = _golden(lambda s: -(w * lognormal(mean, s)).sum(), 0.05, 8.0, 30)

    def cut(a: float, rate: float) -> np.ndarray:
        return -a * np.log(t) - rate * (t - t[0]) - math.log(_cut_total(a, rate, float(t[0])))

    a, rate = alpha, 1e-4
    for _ in range(4):
        rate = math.exp(_golden(lambda x: -(w * cut(a, math.exp(x))).sum(), -18.0, 0.0, 30))
        a = _golden(lambda x: -(w * cut(x, rate)).sum(), 0.5, 8.0, 30)
    r1, p1 = _vuong(power, lognormal(mean, sd), w)
    r2, p2 = _vuong(power, cut(a, rate), w)
    return out | {"status": "ok", "tail_n": int(w.sum()), "xmin": float(t[0]), "alpha": float(alpha), "ks": ks, "powerlaw_vs_lognormal_r": r1, "powerlaw_vs_lognormal_p": p1, "powerlaw_vs_truncated_r": r2, "powerlaw_vs_truncated_p": p2}


def fit_tail(values: DataFrame, value: str = "value") -> dict:
    return fit_tail_counts(*value_counts(values, value))


def rank_frequency(values: DataFrame, by: list[str], xmin: float = 1.0, value: str = "value") -> DataFrame:
    """``ln value = intercept - beta ln rank`` on the tail of each group, from the runs of equal values.

    Logarithms of the ranks within a run are summed in closed form, so that a run is one row however long it is.
    """
    b = ranked_blocks(values.where(F.col(value) >= xmin), by, value)
    first, c, y = F.col("first_rank"), F.col("c"), F.ln("v")
    rows = b.select(*by, "c", y.alias("y"), log_run(first, c).alias("x"), log_run(first, c, 2).alias("xx"))
    sums = rows.groupBy(*by).agg(F.sum("c").alias("tail_n"), F.count(F.lit(1)).alias("distinct"), F.sum("x").alias("x"), F.sum("xx").alias("xx"), F.sum(F.col("c") * F.col("y")).alias("y"), F.sum(F.col("c") * F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    n = F.col("tail_n")
    parts = {"sxx": F.col("xx") - F.col("x") * F.col("x") / n, "syy": F.col("yy") - F.col("y") * F.col("y") / n, "sxy": F.col("xy") - F.col("x") * F.col("y") / n}
    made = sums.withColumns(parts).withColumn("slope", F.try_divide("sxy", "sxx"))
    made = made.withColumns({"intercept": (F.col("y") - F.col("slope") * F.col("x")) / n, "r_squared": F.when(F.col("syy") > 0, F.col("slope") * F.col("sxy") / F.col("syy")).otherwise(1.0)})
    ok = (F.col("tail_n") >= 20) & (F.col("distinct") >= 3)
    error = F.sqrt((1 - F.col("r_squared")) / (F.col("tail_n") - 2)) * F.sqrt(F.col("syy") / F.col("sxx"))
    when = lambda c: F.when(ok, c)
    return made.select(
        *by,
        F.when(ok, "ok").otherwise("insufficient_tail_observations").alias("status"),
        "tail_n",
        when(-F.col("slope")).alias("beta_rank"),
        when(F.col("intercept")).alias("intercept"),
        when(F.col("r_squared")).alias("r_squared"),
        when(error).alias("slope_std_error"),
        when(F.abs(-F.col("slope") - 1)).alias("distance_from_zipf_1"),
    )


def prime_bound(n: int) -> int:
    """A number that the n-th prime does not exceed: n (ln n + ln ln n) from the sixth on (Rosser and Schoenfeld, 1962)."""
    return 13 if n < 6 else math.ceil(n * math.log(n * math.log(n)))


def small_primes(top: int) -> np.ndarray:
    """The primes up to *top*: 2, 3, and of the neighbours of multiples of six those that no smaller one divides."""
    beside = (np.arange(6, top + 2, 6)[:, None] + [-1, 1]).ravel()
    left = beside[beside <= top]
    k = 0
    while k < len(left) and left[k] ** 2 <= top:
        left = np.concatenate([left[: k + 1], left[k + 1 :][left[k + 1 :] % left[k] > 0]])
        k += 1
    return np.concatenate([np.array([p for p in (2, 3) if p <= top], int), left])


def prime_ranks(spark: SparkSession, n: int, segment: int = 1 << 20) -> DataFrame:
    """``prime, rank`` of the first *n* primes: a sieve in segments, of which each task gets some.

    Only the primes up to the square root of the last one are sent to the tasks.
    """
    top = prime_bound(n)
    base = spark.sparkContext.broadcast(small_primes(math.isqrt(top) + 1))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                lo, hi = k * segment, min((k + 1) * segment, top + 1)
                left = np.ones(hi - lo, bool)
                left[: max(0, 2 - lo)] = False
                for p in base.value.tolist():
                    left[max(p * p, -(-lo // p) * p) - lo :: p] = False
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(left) + lo)], ["prime"])

    found = spark.range(-(-(top + 1) // segment)).mapInArrow(sieve, "prime bigint")
    return running(found, [F.col("prime")]).select("prime", (F.col("before") + 1).alias("rank")).where(F.col("rank") <= n)


def rank_shapes(values: DataFrame, value: str = "value") -> DataFrame:
    """Fits of 1/rank and 1/prime(rank) to the logarithms of all positive values and of the largest one percent (20 at least).

    ``range, shape, n`` and, for the template with a fitted level (*fixed*) and with a fitted slope too
    (*free*), level, root mean square error, R squared and, for the fixed one, mean absolute error.  Values
    are runs of equal ones; each rank is summed with its run on the executors.  Needs 20 positive values.
    """
    blocks = written(ranked_blocks(values, [], value).select(F.log10("v").alias("y"), "first_rank", "c"), "blocks")
    n = int(blocks.agg(F.sum("c")).first()[0] or 0)
    if n < 20:
        raise ValueError("at least 20 positive values are needed")
    spark, most = values.sparkSession, max(20, math.ceil(n * 0.01))
    # One row for a rank and its prime; the value of a rank is that of the run which holds it.
    primes = prime_ranks(spark, n)
    firsts = blocks.select(F.col("first_rank").alias("rank"), "y", F.lit(None).cast("bigint").alias("prime"))
    marked = firsts.unionByName(primes.select("rank", F.lit(None).cast("double").alias("y"), "prime"))
    ranks = written(_filled(marked), "rank-values")
    shapes = {"zipf": F.col("rank").cast("double"), "reciprocal_prime": F.col("prime").cast("double")}
    stacked = ranks.select("rank", "y", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in shapes]), F.array(*[F.log10(x) for x in shapes.values()]))).alias("shape", "base"))
    wide = stacked.withColumn("range", F.explode(F.when(F.col("rank") <= most, F.array(F.lit("all_positive"), F.lit("top_1pct"))).otherwise(F.array(F.lit("all_positive")))))
    key = ["range", "shape"]
    fits = wide.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") + F.col("base")).alias("fixed_intercept"), F.regr_slope("y", "base").alias("slope"), F.regr_intercept("y", "base").alias("free_intercept"), F.var_pop("y").alias("var_y"))
    fixed = F.col("y") - F.col("fixed_intercept") + F.col("base")
    free = F.col("y") - F.col("free_intercept") - F.col("slope") * F.col("base")
    errors = wide.join(F.broadcast(fits), key).groupBy(*key).agg(*[F.first(x).alias(x) for x in ("n", "fixed_intercept", "slope", "free_intercept", "var_y")], F.avg(fixed * fixed).alias("fixed_mse"), F.avg(F.abs(fixed)).alias("fixed_mae"), F.avg(free * free).alias("free_mse"))
    r2 = lambda mse: F.when(F.col("var_y") > 0, 1 - F.col(mse) / F.col("var_y")).otherwise(1.0)
    return errors.select(*key, "n", "fixed_intercept", F.sqrt("fixed_mse").alias("fixed_rmse"), "fixed_mae", r2("fixed_mse").alias("fixed_r_squared"), (-F.col("slope")).alias("free_beta"), "free_intercept", F.sqrt("free_mse").alias("free_rmse"), r2("free_mse").alias("free_r_squared"))


def _filled(marked: DataFrame) -> DataFrame:
    """``rank, prime, y``: rows with a prime take the value of the last run that begins at their rank or before it.

    Range partitions are filled on their own; what a partition begins with comes from the partitions before it.
    """
    dealt = written(marked.repartitionByRange("rank").withColumn("part", F.spark_partition_id()), "ranks")
    last = dealt.where(F.col("y").isNotNull()).groupBy("part").agg(F.max_by("y", "rank").alias("y"))
    parts = dealt.select("part").distinct().join(last, "part", "left")
    before = parts.select("part", F.last("y", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = Window.partitionBy("part").orderBy("rank", F.col("prime").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("y", F.last("y", ignorenulls=True).over(inside)).join(F.broadcast(before), "part")
    return own.where(F.col("prime").isNotNull()).select("rank", "prime", F.coalesce("y", "carried").alias("y"))


# --- correlation, regression, normality


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``x, y, n, rho`` with tie-averaged ranks for each pair of columns; rows with a null in the pair are left out.

    Rows are counted by their pair of values first; ranks come from the histogram of each column and join
    the counted pairs, so that a value which very many rows have is one pair with each value beside it.
    The mean rank is (n + 1) / 2 whatever the ties.
    """
    out = None
    for x, y in pairs:
        cells = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop().groupBy("x", "y").agg(F.count(F.lit(1)).alias("__c"))
        cells = written(cells, "cells")
        rows = cells.crossJoin(F.broadcast(cells.agg(((F.sum("__c") + 1) / 2).alias("__mean"))))
        for c in ("x", "y"):
            h = running(cells.groupBy(c).agg(F.sum("__c").alias("n")), [F.col(c)], F.col("n"))
            rows = rows.join(h.select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{c}")), c)
        off = lambda c: F.col(f"rank_{c}") - F.col("__mean")
        product = lambda a, b: F.sum(F.col("__c") * off(a) * off(b))
        rho = F.try_divide(product("x", "y"), F.sqrt(product("x", "x") * product("y", "y")))
        one = rows.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n"), rho.alias("rho")).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "rho")
        out = one if out is None else out.unionByName(one)
    return out


def spearman_p(rho: float, n: int) -> float:
    if abs(rho) >= 1:
        return 0.0
    return student_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """Exact linear quantiles: of the counted values only those beside a quantile reach the driver, two for each."""
    counted = written(running(histogram(df, [], value), [F.col("v")], F.col("c")), "counted")
    n = int(counted.agg(F.sum("c")).first()[0] or 0)
    if not n:
        return []
    places = [q * (n - 1) for q in shares]
    wanted = sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)})
    near = counted.where(F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("c")))).collect()
    at = {k: r["v"] for r in near for k in wanted if r["before"] <= k < r["before"] + r["c"]}
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def quantile_bins(df: DataFrame, size: str, bins: int = 20) -> DataFrame:
    """``bin`` of each row: right-closed intervals between linear quantiles of *size*, equal edges dropped, the least value in the first."""
    inner = sorted(set(quantiles(df, size, [k / bins for k in range(bins + 1)])))[1:-1]
    value = F.col(size).cast("double")
    return df.withColumn("bin", sum(((F.lit(e) < value).cast("int") for e in inner), F.when(value.isNotNull(), F.lit(0))))


def bin_z_scores(df: DataFrame, size: str, value: str, bins: int = 20, least: int = 100) -> DataFrame:
    """z-scores of *value* within size bins that have at least *least* rows and some spread."""
    binned = quantile_bins(df, size, bins)
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("bin_n"), F.avg(value).alias("bin_mean"), F.stddev_samp(value).alias("bin_sd"))
    rows = binned.join(F.broadcast(stats), "bin").where((F.col("bin_sd") > 0) & (F.col("bin_n") >= least))
    return rows.withColumn("z", (F.col(value) - F.col("bin_mean")) / F.col("bin_sd"))


def sample_shape(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from the population ones."""
    g = F.sqrt(n * (n - 1)) / (n - 2) * skew
    return g, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


#: Ranks of one run of equal values that a task looks at together.
_PIECE = 4096


def _quantile_sums(n: int, mean: float, sd: float):
    """Sums over ranks for the Anderson-Darling statistic and the normal quantile plot, added up in each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normal = NormalDist()
        for batch in batches:
            total = np.zeros(4)
            for value, first, count in zip(*(batch.column(k).to_pylist() for k in range(3))):
                u = (value - mean) / sd
                low, high = max(0.5 * math.erfc(-u / math.sqrt(2)), 1e-300), max(0.5 * math.erfc(u / math.sqrt(2)), 1e-300)
                ranks = np.arange(first + 1, first + count + 1)
                q = np.array([normal.inv_cdf((k - 0.5) / n) for k in ranks.tolist()])
                total += ((2 * ranks - 1).sum() * math.log(low) + (2 * (n - ranks) + 1).sum() * math.log(high), q.sum(), (q * q).sum(), q.sum() * value)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], ["ad", "q", "qq", "qv"])

    return work


def normality(z: DataFrame, column: str = "z") -> dict:
    """Moments, D'Agostino's K2, Anderson-Darling and Q-Q fit of standardised values; only sums reach the driver."""
    counted = running(histogram(z, [], column), [F.col("v")], F.col("c"))
    v, c = F.col("v"), F.col("c")
    first = counted.agg(F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("mean")).first()
    n = int(first["n"] or 0)
    if n < 20:
        return {"n": n, "status": "insufficient_observations"}
    mean = first["mean"]
    off = v - F.lit(mean)
    m2, m3, m4 = (x / n for x in counted.agg(*[F.sum(c * F.pow(off, F.lit(float(k)))) for k in (2, 3, 4)]).first())
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    skew = math.sqrt(n * (n - 1)) / (n - 2) * g1
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    # D'Agostino and Pearson's transforms of skewness and kurtosis to normal deviates.
    yy = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    a = math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(yy / a) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / math.sqrt(var)
    rb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    aa = 6 + 8 / rb * (2 / rb + math.sqrt(1 + 4 / rb**2))
    term = (1 - 2 / aa) / (1 + x * math.sqrt(2 / (aa - 4)))
    z2 = (1 - 2 / (9 * aa) - math.copysign(abs(term) ** (1 / 3), term)) / math.sqrt(2 / (9 * aa))
    k2 = z1 * z1 + z2 * z2
    sd = math.sqrt(m2 * n / (n - 1))
    # A run of equal values has many quantiles: it is dealt out in pieces.
    pieces = counted.select("v", "before", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(_PIECE))).alias("at"), "c")
    pieces = pieces.select("v", (F.col("before") + F.col("at")).alias("first"), F.least(F.col("c") - F.col("at"), F.lit(_PIECE)).alias("c"))
    ad, q_sum, q_sq, q_v = pieces.mapInArrow(_quantile_sums(n, mean, sd), "ad double, q double, qq double, qv double").agg(*[F.sum(x) for x in ("ad", "q", "qq", "qv")]).first()
    cov = q_v / n - q_sum / n * mean
    qq = cov * cov / ((q_sq / n - (q_sum / n) ** 2) * m2)
    return {"n": n, "status": "ok", "skewness": skew, "excess_kurtosis": kurt, "qq_r_squared": qq, "dagostino_k2": k2, "dagostino_p_value": math.exp(-k2 / 2), "anderson_statistic": -n - ad / n, "shape_consistent": abs(skew) < 0.2 and abs(kurt) < 0.5 and qq > 0.99}


def z_histogram(z: DataFrame, column: str = "z", bins: int = 40, low: float = -4.0, high: float = 4.0) -> DataFrame:
    """Counts in equal bins of values cut to the range; empty bins are left out."""
    width = (high - low) / bins
    cut = F.greatest(F.least(F.col(column), F.lit(high)), F.lit(low))
    at = F.least(F.floor((cut - low) / width), F.lit(bins - 1))
    return z.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def geometric_edges(n: int, bins: int = 40) -> list[int]:
    """Distinct whole edges from 1 to *n* + 1, evenly spaced on a logarithmic scale."""
    return np.unique(np.rint(np.geomspace(1, n + 1, bins + 1)).astype(int)).tolist()


def rank_bins(ranked: DataFrame, n: int, measures: list[str], rank: str = "rank", bins: int = 40) -> DataFrame:
    """Medians of measures in geometric bins of the rank."""
    edges = geometric_edges(n, bins)
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:]]), lambda e: e <= F.col(rank)))
    binned = written(ranked.select(place.alias("bin"), *measures), "rank-bins")
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    for m in measures:
        out = out.join(grouped_quantiles(binned, ["bin"], m, {f"median_{m}": 0.5}), "bin", "left")
    return out
