"""Numeric functions as Column expressions over arrays and scalars, and the few distributions that need a loop."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

CHANCE = 0.25


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def harmonic_mean(a: Column) -> Column:
    """0 if the array is empty or any value isn't finite and positive."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf")))
    return F.when((F.size(a) == 0) | bad, 0.0).otherwise(F.size(a) / F.aggregate(a, F.lit(0.0), lambda s, x: s + F.try_divide(F.lit(1.0), x)))


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def chance_normalised(acc: Column, full: Column, chance: float = CHANCE) -> Column:
    """Share of the full model's gain over chance, from 0 to 1; null where that model isn't over chance."""
    return F.when(full > chance, clip01(F.try_divide(acc - chance, full - chance)))


def retention_score(target: Column, neighbour: Column, unrelated: Column) -> Column:
    """Harmonic mean of what the target lost and of what the other two kept."""
    return harmonic_mean(F.array(1 - target, harmonic_mean(F.array(neighbour, unrelated))))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / total(e))


def logsumexp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda x: F.exp(x - top))))


def margin(a: Column, gold: Column) -> Column:
    """The gold value over the best of the others. gold: 0-based."""
    return F.element_at(a, gold + 1) - F.array_max(F.filter(a, lambda x, i: i != gold))


def argmax(a: Column) -> Column:
    """0-based place of the largest, the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def kl(p: Column, q: Column) -> Column:
    """Divergence of two log-probability arrays, of the first from the second."""
    return total(F.zip_with(p, q, lambda x, y: F.exp(x) * (x - y)))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = successes / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs at one half; 1 if there are none. In Columns: each term from the one before."""
    n, none = (b + c).cast("double"), F.lit(0.0)
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] + F.log((n - k + 1) / k)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(F.least(b, c) > 0, F.sequence(F.lit(1), F.least(b, c).cast("int"))).otherwise(F.array().cast("array<int>"))
    tail = F.aggregate(steps, start, step, lambda s: s["sum"])
    return F.when(n == none, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction in the half where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    terms = 300
    value = 0.0
    for m in range(terms, 0, -1):  # from the tail of the fraction to its head
        k, odd = divmod(m, 2)
        d = -(a + k) * (a + b + k) / ((a + 2 * k) * (a + 2 * k + 1)) if odd else k * (b - k) / ((a + 2 * k - 1) * (a + 2 * k))
        value = d * x / (1 + value)
    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(front) / (a * (1 + value))


def student_cdf(t: float, df: float) -> float:
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t <= 0 else 1 - half


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([None if pd.isna(x) or pd.isna(d) or d <= 0 else 2 * student_cdf(-abs(x), d) for x, d in zip(t, df, strict=True)], dtype="float64")


#: Statistics of a group of values by name, as aggregates of a Column.
STATISTICS = {
    "mean": F.avg,
    "median": lambda x: F.percentile(x, 0.5),
    "frac_neg": lambda x: F.avg((x < 0).cast("double")),
    "frac_pos": lambda x: F.avg((x > 0).cast("double")),
    "sd": F.stddev_samp,
}


def scoring_rules(conditional: Column, null: Column, chars: Column, tokens: Column | None = None) -> dict[str, Column]:
    """Option scores by rule: the conditional log-likelihood or its gain over the unconditional, whole, by character or by token."""
    gain = F.zip_with(conditional, null, lambda c, z: c - z)
    per = lambda a, n: F.zip_with(a, n, lambda s, k: s / k)
    rules = {"cond_sum": conditional, "cond_per_char": per(conditional, chars), "pmi_sum": gain, "pmi_per_char": per(gain, chars)}
    if tokens is not None:
        rules |= {"cond_per_token": per(conditional, tokens), "pmi_per_token": per(gain, tokens)}
    return rules
