"""Entropy corrected for sample size by rarefaction.

A position with N reads is subsampled at growing sizes m; a line through H(m) over 1/m meets 1/m = 0 at the entropy of an endless
sample. By default H(m) is the expectation over all subsamples, in closed form from the count spectrum (each count is hypergeometric),
evaluated with a proven bound at a cost near linear in the spectrum; results do not depend on a random draw; ``mode="sampled"`` draws one subsample for each (position, m), seeded.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.diversity import total
from kmerloom.ship import ship

# Sizes always sampled, and the limits of the fit.
ANCHORS = (2, 3, 5, 7, 10, 15, 20, 30, 50)
LEAST_POINTS, LEAST_RANGE, LEAST_DENOMINATOR = 5, 0.01, 1e-12
#: Standard deviations of a hypergeometric count beyond which its terms are left out.
TAIL = 12.0
#: Reads from which numpy does not draw, and types that are drawn at once.
NUMPY_MOST, PIECE = 10**9, 1 << 16
#: Mean from which a count is wide, and steps to a deviation then; logarithms of factorials that are kept; entries of a spectrum in a row of Python.
WIDE, REACH, TABLED, CHUNK = 64.0, 2.5, 1 << 20, 64
_SMALL = np.cumsum(np.log(np.maximum(np.arange(64), 1.0)))


def sample_grid(n: Column, threshold: int) -> Column:
    """Subsample sizes for N reads: the anchors below N, and every second or fifth percent of N from the threshold's share on."""
    share = F.ceil(F.lit(100.0) * threshold / n).cast("long")
    step = F.when(share > 80, 2).otherwise(5).cast("long")
    first = F.greatest(share, F.lit(10).cast("long"))
    start = F.ceil(first / step).cast("long") * step
    percents = F.when(start <= 99, F.transform(F.sequence(start, F.lit(99).cast("long"), step), lambda p: F.floor(p * n / 100).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    anchors = F.filter(F.array(*[F.lit(x).cast("long") for x in ANCHORS]), lambda x: x < n)
    return F.array_sort(F.array_distinct(F.filter(F.concat(anchors, percents), lambda m: m >= 2)))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! from a table for small x, else Stirling's series; the error is below 1e-12."""
    x = np.asarray(x, np.int64)
    y = np.maximum(x, 64).astype(np.float64)
    series = (y + 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 64, _SMALL[np.clip(x, 0, 63)], series)


@lru_cache(1)
def _log_factorials() -> np.ndarray:
    return log_factorial(np.arange(TABLED))


def _lf(x: np.ndarray) -> np.ndarray:
    return _log_factorials()[x] if x.max(initial=0) < TABLED else log_factorial(x)


def step_of(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Distance between the terms that are summed for a count: 1 for narrow counts, else a share of its deviation, see ``step_error``."""
    return np.where(mean >= WIDE, np.maximum(np.floor(sd / REACH), 1), 1).astype(np.int64)


def step_error(mean: float, variance: float, step: int) -> float:
    """Bound of the error of E ln(1 + J), J hypergeometric, from every ``step``-th term.

    A hypergeometric count is a sum of independent Bernoulli ones, as its generating function has real roots only (Vatutin and
    Mikhailov 1982). So |E exp(itJ)| <= exp(-v (1 - cos t)) for variance v, and with weights exp(-uJ), u <= 1, the variance is v/e at least. The
    sum over every step-th term differs from the whole by the frequencies t = 2 pi k / step (Poisson). ln(1 + J) is the integral of
    (exp(-u) - exp(-u(1 + J))) / u: its part over u <= 1 is bounded by the derivative in u, mean * exp(-(v/e - 1/4)(1 - cos t)), that
    beyond by 0.22 times the sum of both terms at u = 1.
    """
    c = 1 - np.cos(2 * np.pi * np.arange(1, step) / step)
    near = mean * np.exp(-np.maximum(variance / math.e - 0.25, 0) * c)
    far = 0.22 * (np.exp(-variance * c) + math.exp(-(1 - 1 / math.e) * mean))
    return float((near + far).sum())


def expected_entropy(counts: np.ndarray, types: np.ndarray, sizes: np.ndarray, reads: int | None = None) -> np.ndarray:
    """E[H(m)] for each size m, of ``reads`` reads of which counts and types may be a part: what they add to it.

    A count c adds c/reads * (log2 m - E log2(1 + J)), where J is how many of c - 1 reads are among m - 1 drawn of reads - 1. Narrow J are
    summed in full, wide ones at steps of a share of their deviation, with an error below 1e-9 (``step_error``): the terms of a count are some 60
    at any depth. Sums are divided by the sum of the weights, so that rounding of large logarithms cancels.
    """
    n = int((counts * types).sum()) if reads is None else int(reads)
    out = np.zeros(len(sizes))
    if not len(counts):
        return out
    good, whole = counts - 1, n - 1
    fixed = _lf(good) + _lf(whole - good)
    for at, m in enumerate(sizes.tolist()):
        drawn = m - 1
        mean = good * (drawn / whole)
        sd = np.sqrt(np.maximum(mean * (1 - good / whole) * ((whole - drawn) / max(whole - 1, 1)), 0))
        low = np.maximum(np.maximum(0, drawn - (whole - good)), np.floor(mean - TAIL * sd - TAIL)).astype(np.int64)
        high = np.minimum(np.minimum(good, drawn), np.ceil(mean + TAIL * sd + TAIL)).astype(np.int64)
        step = step_of(mean, sd)
        wide = np.maximum(high - low, 0) // step + 1
        starts = np.cumsum(wide) - wide
        k = np.arange(int(wide.sum())) - np.repeat(starts, wide)
        j = np.repeat(low, wide) + np.repeat(step, wide) * k
        of = np.repeat(good, wide)
        logs = np.repeat(fixed, wide) - _lf(j) - _lf(of - j) - _lf(drawn - j) - _lf(whole - of - drawn + j)
        p = np.exp(logs - np.repeat(np.maximum.reduceat(logs, starts), wide))
        mean_log = np.add.reduceat(p * np.log2(1.0 + j), starts) / np.add.reduceat(p, starts)
        out[at] = float((types * counts / n * (math.log2(m) - mean_log)).sum())
    return out + 0.0


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``good`` are among n drawn of good + bad. Beyond numpy's limit by inversion, over values within TAIL deviations."""
    whole = good + bad
    if whole < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    mean = good * (n / whole)
    far = TAIL * math.sqrt(max(mean * (1 - good / whole) * ((whole - n) / (whole - 1)), 0.0)) + TAIL
    j = np.arange(max(0, n - bad, math.floor(mean - far)), min(good, n, math.ceil(mean + far)) + 1)
    logs = -(log_factorial(j) + log_factorial(good - j) + log_factorial(n - j) + log_factorial(bad - n + j))
    sums = np.cumsum(np.exp(logs - logs.max()))
    return int(j[np.searchsorted(sums, rng.random() * sums[-1], side="right")])


def _drawn(rng: np.random.Generator, count: int, types: int, draws: int, m: int) -> float:
    """Sum of p log2 p over ``types`` types of equal count that share the draws: halves until a piece is small, never all types at once."""
    bits, parts = 0.0, [(types, draws)]
    while parts:
        t, n = parts.pop()
        if n == 0:
            continue
        if count == 1:
            bits += n / m * math.log2(1 / m)
        elif t == 1:
            bits += n / m * math.log2(n / m)
        elif t <= PIECE and count * t < NUMPY_MOST:
            own = rng.multivariate_hypergeometric(np.full(t, count), n, method="marginals")
            p = own[own > 0] / m
            bits += float((p * np.log2(p)).sum())
        else:
            half = t // 2
            first = hypergeometric(rng, count * half, count * (t - half), n)
            parts += [(t - half, n - first), (half, first)]
    return bits


def sampled_entropy(counts: np.ndarray, types: np.ndarray, sizes: np.ndarray, position: int, seed: int) -> np.ndarray:
    """H of one subsample without replacement for each size, seeded by position and size; drawn entry by entry of the spectrum."""
    out = np.zeros(len(sizes))
    for at, m in enumerate(sizes.tolist()):
        rng = np.random.default_rng([seed, position, m])
        left, draws, bits = int((counts * types).sum()), m, 0.0
        for c, t in zip(counts.tolist(), types.tolist(), strict=True):
            own = hypergeometric(rng, c * t, left - c * t, draws)
            bits += _drawn(rng, c, t, own, m)
            left, draws = left - c * t, draws - own
        out[at] = -bits + 0.0
    return out


def _drawn_curve(seed: int):
    @F.pandas_udf("array<double>")
    def curve(position: pd.Series, counts: pd.Series, types: pd.Series, sizes: pd.Series) -> pd.Series:
        def of(p, c, t, m):
            return None if m is None else sampled_entropy(*(np.asarray(x, np.int64) for x in (c, t, m)), int(p), seed)

        return pd.Series([of(*x) for x in zip(position, counts, types, sizes, strict=True)], dtype=object)

    return curve


def _expected_curve():
    @F.pandas_udf("array<double>")
    def curve(counts: pd.Series, types: pd.Series, sizes: pd.Series, reads: pd.Series) -> pd.Series:
        def of(c, t, m, n):
            return None if m is None else expected_entropy(*(np.asarray(x, np.int64) for x in (c, t, m)), n)

        return pd.Series([of(*x) for x in zip(counts, types, sizes, reads, strict=True)], dtype=object)

    return curve


def with_curve(stats: DataFrame, threshold: int, mode: str = "expected", seed: int = 0) -> DataFrame:
    """stats, a row for each position, with ``curve``, an array of (m, h) that ends with the full sample; null for positions that are not corrected.

    Not corrected: N up to the threshold, and N of which the threshold is over 99 %. Expected entropies are sums over the spectrum, so the unit
    of work is a piece of ``CHUNK`` entries, whatever position it is of; pieces are spread, and their sums added up by position.
    """
    ship(stats.sparkSession)
    n = F.col("support")
    corrected = (n > 1) & (n > threshold) & (F.ceil(F.lit(100.0) * threshold / n) < 100)
    own = stats.withColumn("__m", F.when(corrected, sample_grid(n, threshold)))
    # over a number of partitions that adaptive execution keeps, as rows are few and heavy
    spread = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if mode == "sampled":
        own = own.repartition(spread, "position").withColumn("__h", _drawn_curve(seed)("position", F.col("spectrum.count"), F.col("spectrum.types"), "__m"))
    else:
        pieces = F.sequence(F.lit(0), F.when(corrected, F.greatest(F.ceil(F.size("spectrum") / CHUNK).cast("int") - 1, F.lit(0))).otherwise(0))
        each = own.select("*", F.explode(pieces).alias("__at"))
        part = F.slice("spectrum", F.col("__at") * CHUNK + 1, CHUNK)
        each = each.select("position", "__at", "__m", "support", part.alias("__part"), F.when(F.col("__at") == 0, F.struct(*own.columns)).alias("__s")).repartition(spread, "position", "__at")
        each = each.withColumn("__h", _expected_curve()(F.col("__part.count"), F.col("__part.types"), "__m", "support"))
        sums = each.groupBy("position").agg(F.first("__s", True).alias("__s"), F.array_sort(F.collect_list(F.struct("__at", "__h"))).alias("__parts"))
        zero = F.transform("__s.__m", lambda _: F.lit(0.0))
        own = sums.select("__s.*", F.aggregate("__parts", zero, lambda a, p: F.zip_with(a, p["__h"], lambda x, y: x + y)).alias("__h"))
    points = F.concat(F.arrays_zip(F.col("__m").alias("m"), F.col("__h").alias("h")), F.array(F.struct(n.alias("m"), F.col("raw_entropy").alias("h"))))
    return own.withColumn("curve", F.when(F.col("__m").isNotNull(), points)).drop("__m", "__h")


def rarefaction(stats: DataFrame, threshold: int, mode: str = "expected", seed: int = 0) -> DataFrame:
    """(position, m, h): points of the curve of every position that is corrected, a row each."""
    # an inner explode would have Spark filter on the array first, and compute it twice
    each = with_curve(stats, threshold, mode, seed).select("position", F.explode_outer("curve").alias("x"))
    return each.where("x IS NOT NULL").select("position", "x.m", "x.h")


def fit(points: DataFrame, by: list[str], x: Column, y: str) -> DataFrame:
    """Least squares of y on x for each group: points, range of x, slope, intercept (null where the x barely differ)."""
    own = points.select(*by, x.alias("x"), F.col(y).alias("y"))
    spread = (F.count("x") - 1) * F.var_samp("x") * F.count("x")
    fine = (F.count("x") >= 2) & (spread >= LEAST_DENOMINATOR)
    return own.groupBy(*by).agg(
        F.count("x").alias("points"),
        (F.max("x") - F.min("x")).alias("x_range"),
        F.when(fine, F.regr_slope("y", "x")).alias("slope"),
        F.when(fine, F.regr_intercept("y", "x")).alias("intercept"),
    )


def with_entropy(stats: DataFrame, threshold: int, mode: str = "expected", seed: int = 0) -> DataFrame:
    """stats with ``entropy``, and ``intercept`` where a line was fitted.

    Raw entropy holds for positions that are not corrected, fits of fewer than five points or a range under 0.01, rising or missing
    slopes, and intercepts below 0. Otherwise the intercept, but no less than the raw entropy and no more than log2 of the types.
    """
    # the line is fitted in the position's own row, so that stats are derived once
    own = with_curve(stats, threshold, mode, seed).withColumn("__p", F.transform("curve", lambda p: F.struct((1 / p["m"]).alias("x"), p["h"].alias("y"))))
    points = F.size("__p")
    own = own.withColumn("__x", total(F.col("__p"), lambda p: p["x"]) / points).withColumn("__y", total(F.col("__p"), lambda p: p["y"]) / points)
    own = own.withColumn("__xx", total(F.col("__p"), lambda p: (p["x"] - F.col("__x")) * (p["x"] - F.col("__x"))))
    own = own.withColumn("__xy", total(F.col("__p"), lambda p: (p["x"] - F.col("__x")) * (p["y"] - F.col("__y"))))
    slope = F.when((points >= 2) & (F.col("__xx") * points >= LEAST_DENOMINATOR), F.col("__xy") / F.col("__xx"))
    own = own.withColumn("slope", slope).withColumn("intercept", F.col("__y") - F.col("slope") * F.col("__x"))
    x_range = F.array_max("__p")["x"] - F.array_min("__p")["x"]
    usable = (points >= LEAST_POINTS) & (x_range >= LEAST_RANGE) & (F.col("slope") <= 0) & (F.col("intercept") >= 0) & (F.abs("intercept") < float("inf"))
    cap = F.when(F.col("distinct_kmers") > 1, F.log2(F.col("distinct_kmers").cast("double"))).otherwise(0.0)
    entropy = F.when(F.col("support") <= 1, 0.0).when(F.coalesce(usable, F.lit(False)), F.least(F.greatest("intercept", "raw_entropy"), cap)).otherwise(F.col("raw_entropy"))
    return own.withColumn("entropy", entropy).drop("curve", "slope", "__p", "__x", "__y", "__xx", "__xy")


def entropy_of_counts(counts: DataFrame, by: list[str] | None = None, count: str = "count") -> DataFrame:
    """Shannon entropy in bits of a table of counts, for each group."""
    by = by or []
    n = counts.groupBy(*by, count).agg(F.count(F.lit(1)).alias("types")).groupBy(*by).agg(F.collect_list(F.struct(F.col(count).cast("long").alias("count"), "types")).alias("spectrum"), F.sum(F.col(count) * F.col("types")).alias("n"))
    bits = total(F.col("spectrum"), lambda x: x["types"] * (x["count"] / F.col("n")) * F.log2(x["count"] / F.col("n")))
    return n.select(*by, F.when((F.col("n") > 0) & (bits < 0), -bits).otherwise(F.lit(0.0)).alias("entropy"))
