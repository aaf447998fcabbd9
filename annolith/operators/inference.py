"""Resampling and permutation inference. Groups of paired scores are small (a question set each); numpy draws them in one call a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as X


def percentile_ci(draws: np.ndarray, level: float = 0.95) -> tuple[float, float]:
    tail = 50 * (1 - level)
    return float(np.percentile(draws, tail)), float(np.percentile(draws, 100 - tail))


def resampled(rng: np.random.Generator, n: int, draws: int, block: int = 500):
    """Index matrices of up to `block` draws at a time, so that memory doesn't grow with the draws."""
    for lo in range(0, draws, block):
        yield rng.integers(0, n, (min(block, draws - lo), n))


def _per_group(df: DataFrame, by: list[str], columns: list[str], fields: list[str], f) -> DataFrame:
    """f(columns as arrays, in order of `order_key`) of each group -> a row of doubles."""
    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    schema = ", ".join([f"{b} {kinds[b]}" for b in by] + [f"{x} double" for x in fields])

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order_key", *columns], kind="stable")
        return pd.DataFrame([[*key, *f(*(rows[c].to_numpy(float) for c in columns))]], columns=[*by, *fields])

    return df.select(*by, "order_key", *columns).groupBy(*by).applyInPandas(run, schema)


def bootstrap_ratio(df: DataFrame, by: list[str], num: str, den: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """Ratio of means with a percentile interval and standard error; numerator and denominator are drawn together. df has order_key."""

    def f(a, b):
        rng, out = np.random.default_rng(seed), []
        for at in resampled(rng, len(a), draws):
            d = b[at].mean(1)
            out.append(np.divide(a[at].mean(1), d, out=np.full(len(d), np.nan), where=d != 0))
        x = np.concatenate(out)
        x = x[np.isfinite(x)]
        point = a.mean() / b.mean() if b.mean() else np.nan
        return (point, *(percentile_ci(x) if len(x) else (np.nan, np.nan)), x.std(ddof=1) if len(x) > 1 else np.nan)

    return _per_group(df, by, [num, den], ["ratio", "low", "high", "se"], f)


def bootstrap_mean(df: DataFrame, by: list[str], value: str, draws: int = 1_000, seed: int = 0) -> DataFrame:
    def f(a):
        x = np.concatenate([a[at].mean(1) for at in resampled(np.random.default_rng(seed), len(a), draws)])
        return (a.mean(), *percentile_ci(x))

    return _per_group(df, by, [value], ["mean", "low", "high"], f)


def bootstrap_closeness(df: DataFrame, by: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """R_abs and P_closer with intervals, by one draw of (d_m, d_f) pairs; draws without a denominator don't count."""

    def f(m, d):
        ratios, closer = [], []
        for at in resampled(np.random.default_rng(seed), len(m), draws):
            den = d[at].mean(1)
            ok = den > 0
            ratios.append(m[at].mean(1)[ok] / den[ok])
            closer.append((m[at] < d[at]).mean(1))
        r, c = np.concatenate(ratios), np.concatenate(closer)
        return (m.mean() / d.mean() if d.mean() else np.nan, *(percentile_ci(r) if len(r) else (np.nan, np.nan)), (m < d).mean(), *percentile_ci(c))

    return _per_group(df, by, ["d_m", "d_f"], ["r_abs", "r_low", "r_high", "p_closer", "p_low", "p_high"], f)


def contrast_ci(df: DataFrame, by: list[str], value: str, group: str, weights: dict[str, float], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """A weighted sum of the means of independent groups, each resampled by itself."""
    names = list(weights)
    marked = df.withColumn("_g", F.coalesce(*[F.when(F.col(group) == n, F.lit(float(i))) for i, n in enumerate(names)])).filter("_g is not null")

    def f(x, g):
        rng = np.random.default_rng(seed)
        parts = [x[g == i] for i in range(len(names))]
        if not all(len(p) for p in parts):
            return np.nan, np.nan, np.nan
        total = sum(w * np.concatenate([p[at].mean(1) for at in resampled(rng, len(p), draws)]) for p, w in zip(parts, weights.values(), strict=True))
        return (sum(w * p.mean() for p, w in zip(parts, weights.values(), strict=True)), *percentile_ci(total))

    return _per_group(marked, by, [value, "_g"], ["contrast", "low", "high"], f)


def _flips(rng, d, draws, block=1000):
    for lo in range(0, draws, block):
        yield (rng.integers(0, 2, (min(block, draws - lo), len(d))) * 2.0 - 1) @ d / len(d)


def sign_flip_p(df: DataFrame, by: list[str], value: str, draws: int = 20_000, seed: int = 0, tolerance: float = 1e-12) -> DataFrame:
    """Two-sided p of a paired mean difference under random signs: (hits + 1) / (draws + 1)."""

    def f(d):
        hits = sum(int((np.abs(x) >= abs(d.mean()) - tolerance).sum()) for x in _flips(np.random.default_rng(seed), d, draws))
        return d.mean(), (hits + 1) / (draws + 1)

    return _per_group(df, by, [value], ["mean", "p"], f)


def difference_of_differences_p(df: DataFrame, by: list[str], value: str, group: str, first: str, second: str, draws: int = 20_000, seed: int = 0, tolerance: float = 1e-15) -> DataFrame:
    """Sign-flip p of the difference between two independently paired means."""
    marked = df.filter(F.col(group).isin(first, second)).withColumn("_g", (F.col(group) == second).cast("double"))

    def f(x, g):
        a, b = x[g == 0], x[g == 1]
        if not len(a) or not len(b):
            return np.nan, np.nan
        rng, seen = np.random.default_rng(seed), abs(a.mean() - b.mean())
        hits = sum(int((np.abs(u - v) >= seen - tolerance).sum()) for u, v in zip(_flips(rng, a, draws), _flips(rng, b, draws), strict=True))
        return a.mean() - b.mean(), (hits + 1) / (draws + 1)

    return _per_group(marked, by, [value, "_g"], ["difference", "p"], f)


def paired_effect(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean paired difference with dz, its normal interval, t and p."""
    m, s, n = F.avg(value), F.stddev_samp(value), F.count("*")
    out = df.groupBy(*by).agg(n.alias("n"), m.alias("mean"), F.try_divide(m, s).alias("dz"))
    se = F.sqrt(1 / F.col("n") + F.col("dz") * F.col("dz") / (2 * F.col("n")))
    t = F.col("dz") * F.sqrt("n")
    return out.withColumns({"dz_low": F.col("dz") - 1.96 * se, "dz_high": F.col("dz") + 1.96 * se, "t": t, "p": X.t_p_value(t, (F.col("n") - 1).cast("double"))})


def pooled_effect(df: DataFrame, by: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """Difference of two groups' means over the root of their mean variance."""
    of = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    s = df.groupBy(*by).agg(of(F.avg, first).alias("a"), of(F.avg, second).alias("b"), of(F.var_samp, first).alias("va"), of(F.var_samp, second).alias("vb"))
    sd = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return s.select(*by, F.when(sd > 1e-12, (F.col("a") - F.col("b")) / sd).otherwise(0.0).alias("d"))


def null_comparison(observed: DataFrame, null: DataFrame, key: str, value: str) -> DataFrame:
    """Each observed value against the distribution of the null's: z, and its place by magnitude among them."""
    n = null.agg(F.avg(value).alias("null_mean"), F.stddev_samp(value).alias("null_sd"), F.min(value).alias("null_min"), F.max(value).alias("null_max"), F.max(F.abs(value)).alias("null_abs_max"), F.sort_array(F.collect_list(F.abs(F.col(value)))).alias("_all"))
    j = observed.select(key, F.col(value).alias("observed")).crossJoin(F.broadcast(n))
    return j.select(key, "observed", "null_mean", "null_sd", "null_min", "null_max", "null_abs_max", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd")).alias("z"), (1 + F.size(F.filter("_all", lambda x: x > F.abs(F.col("observed"))))).alias("place"))
