"""Statistics over runs: percentiles of three kinds, intervals, bootstraps, slopes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Standard normal quantile of a two-sided interval of 95 %.
Z = 1.96


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nearest_rank(c: str, share: float) -> Column:
    """Aggregate: the value at rank ceil(n * share)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {c})")


def linear_rank(c: str, share: float) -> Column:
    """Aggregate: linear interpolation between ranks."""
    return F.expr(f"percentile({c}, {share})")


def rounded_rank(df: DataFrame, by: list[str], c: str, tail: float) -> DataFrame:
    """(by, low, high): the values at ranks round(tail (n - 1)) and n - 1 minus that, half to even, from 0."""
    order = Window.partitionBy(*by).orderBy(c)
    ranked = df.where(F.col(c).isNotNull()).withColumn("_r", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    at = F.bround(tail * (F.col("_n") - 1), 0)
    return ranked.groupBy(*by).agg(F.max(F.when(F.col("_r") == at, F.col(c))).alias("low"), F.max(F.when(F.col("_r") == F.col("_n") - 1 - at, F.col(c))).alias("high"))


def wilson(successes, total, z: float = Z) -> tuple[Column, Column]:
    """Wilson interval of a proportion, clamped to 0 and 1; null without trials."""
    k, n = _col(successes).cast("double"), _col(total).cast("double")
    p = k / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def slope(x, y) -> Column:
    """Aggregate: least-squares slope of y over x."""
    return F.regr_slope(_col(y), _col(x))


def elasticity(cost_small, cost_large, size_small, size_large) -> Column:
    """How a cost grows with size, as a power of it."""
    return F.ln(_col(cost_large) / _col(cost_small)) / F.ln(_col(size_large) / _col(size_small))


def _interval(draws: list[float], confidence: float = 0.95) -> tuple[float, float]:
    draws = sorted(draws)
    at = round((1 - confidence) / 2 * (len(draws) - 1))
    return draws[at], draws[len(draws) - 1 - at]


def paired_bootstrap(pairs: DataFrame, by: list[str], a: str, b: str, resamples: int = 5000, seed: int = 1) -> DataFrame:
    """(by, mean_diff, low, high) of the mean difference a - b, pairs drawn with replacement, one task per comparison.

    A comparison's pairs must fit one task: they are a question set's answers.
    """

    def draw(key, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        diffs = (rows[a].astype(float) - rows[b].astype(float)).to_numpy()
        step = max(1, 4_000_000 // max(1, len(diffs)))  # resamples at a time
        means = [diffs[rng.integers(0, len(diffs), (min(step, resamples - i), len(diffs)))].mean(1) for i in range(0, resamples, step)]
        low, high = _interval(np.concatenate(means).tolist())
        return pd.DataFrame([[*key, diffs.mean(), low, high]], columns=[*by, "mean_diff", "low", "high"])

    kinds = ", ".join(f"{c} {t}" for c, t in pairs.dtypes if c in by)
    return pairs.select(*by, a, b).orderBy(a, b).groupBy(*by).applyInPandas(draw, f"{kinds}, mean_diff double, low double, high double")


def resample_means(values: DataFrame, by: list[str], c: str, key: str, resamples: int) -> DataFrame:
    """(by, _s, _m): the mean of each resample, in which every row counts a Poisson(1) number of times."""
    # cumulative chances of a Poisson(1) count
    steps, total, p = [], 0.0, 0.36787944117144233
    for i in range(1, 9):
        total += p
        steps.append(total)
        p /= i
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(key), "_s"), 11).cast("double")) / F.lit(float(1 << 53))
    times = sum(((unit >= s).cast("int") for s in steps), F.lit(0))
    drawn = values.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("_t", times)
    return drawn.groupBy(*by, "_s").agg((F.sum(F.col(c).cast("double") * F.col("_t")) / F.sum("_t")).alias("_m"))


def poisson_bootstrap(values: DataFrame, by: list[str], c: str, key: str, resamples: int = 200) -> DataFrame:
    """(by, low, high) of a mean at any size: every row counts a Poisson(1) number of times in each resample.

    The counts come from a hash of the row's key and the resample's number, so reruns agree; rows are summed where
    they lie, and `resamples` sums per group are all that moves.
    """
    means = resample_means(values, by, c, key, resamples)
    return means.groupBy(*by).agg(linear_rank("_m", 0.025).alias("low"), linear_rank("_m", 0.975).alias("high"))


def unpaired_bootstrap(values: DataFrame, by: str, first: str, second: str, c: str, key: str, resamples: int = 200) -> DataFrame:
    """(mean_diff, low, high) of the difference of two groups' means, each resampled for itself as poisson_bootstrap() does."""
    both = values.where(F.col(by).isin(first, second))
    drawn = resample_means(both, [by], c, key, resamples)
    of = lambda g: drawn.where(F.col(by) == g).select("_s", F.col("_m").alias(g.replace(" ", "_")))
    a, b = first.replace(" ", "_"), second.replace(" ", "_")
    spread = of(first).join(of(second), "_s").select((F.col(a) - F.col(b)).alias("_d")).agg(linear_rank("_d", 0.025).alias("low"), linear_rank("_d", 0.975).alias("high"))
    mean = lambda g: F.avg(F.when(F.col(by) == g, F.col(c)))
    return both.agg((mean(first) - mean(second)).alias("mean_diff")).join(spread)  # one row each


def block_bootstrap_f1(blocks: DataFrame, by: list[str], resamples: int = 500, seed: int = 1) -> DataFrame:
    """(by, f1, low, high) from counts per block (tp, fp, fn): whole blocks are drawn, the same ones for all groups."""

    def draw(key, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        counts = rows.sort_values("block")[["tp", "fp", "fn"]].to_numpy(float)

        def f1(x):
            tp, fp, fn = x.T
            return np.where(2 * tp + fp + fn > 0, 2 * tp / np.maximum(2 * tp + fp + fn, 1), 0.0)

        draws = f1(counts[rng.integers(0, len(counts), (resamples, len(counts)))].sum(1))
        return pd.DataFrame([[*key, float(f1(counts.sum(0))), *_interval(draws.tolist())]], columns=[*by, "f1", "low", "high"])

    kinds = ", ".join(f"{c} {t}" for c, t in blocks.dtypes if c in by)
    return blocks.groupBy(*by).applyInPandas(draw, f"{kinds}, f1 double, low double, high double")


def verdict(passed: Column, known: Column) -> Column:
    """PASS, FAIL, or INCOMPLETE where an input is missing."""
    return F.when(known, F.when(passed, "PASS").otherwise("FAIL")).otherwise("INCOMPLETE")
