"""Statistics over feature activations in coordinate form (token_id, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEUTRAL, CONCEPT, BOTH = 0, 1, 2


def token_codes(origins: DataFrame) -> DataFrame:
    """(token_id, origin) -> code: concept, neutral, or both."""
    bit = F.bit_or(F.when(F.col("origin") == "concept", 1).otherwise(2))
    return origins.groupBy("token_id").agg(F.when(bit == 3, BOTH).when(bit == 1, CONCEPT).otherwise(NEUTRAL).alias("code"))


def feature_stats(cells: DataFrame, nonzero: float = 1e-12, eps: float = 1e-8) -> DataFrame:
    """(feature, code, value) of every token -> counts, means and sums of magnitudes by class, their difference and ratios."""
    a, c = F.abs("value"), F.col("code")
    num = lambda k: F.sum(((a > nonzero) & (c == k)).cast("long"))
    avg = lambda k: F.coalesce(F.avg(F.when(c == k, a)), F.lit(0.0))
    tot = lambda k: F.coalesce(F.sum(F.when(c == k, a)), F.lit(0.0))
    s = cells.groupBy("feature").agg(num(CONCEPT).alias("num_concept"), num(NEUTRAL).alias("num_neutral"), num(BOTH).alias("num_both"), avg(CONCEPT).alias("mean_abs_concept"), avg(NEUTRAL).alias("mean_abs_neutral"), tot(CONCEPT).alias("sum_abs_concept"), tot(NEUTRAL).alias("sum_abs_neutral"))
    return s.withColumns({"diff_abs": F.col("mean_abs_concept") - F.col("mean_abs_neutral"), "ratio_abs": F.col("mean_abs_concept") / (F.col("mean_abs_neutral") + eps), "sum_ratio_cn": (F.col("sum_abs_concept") + eps) / (F.col("sum_abs_neutral") + eps)})


def mass_ratio(cells: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(feature, rho, rho_norm): mean magnitude on concept tokens over that on the others; rho_norm with each token's magnitudes scaled to sum 1."""
    a = cells.withColumn("a", F.abs("value"))
    share = F.col("a") / F.greatest(F.sum("a").over(Window.partitionBy("token_id")), F.lit(eps))
    side = lambda x, yes: F.avg(F.when((F.col("code") == CONCEPT) == F.lit(yes), F.col(x)))
    return a.withColumn("s", share).groupBy("feature").agg((side("a", True) / (side("a", False) + eps)).alias("rho"), (side("s", True) / (side("s", False) + eps)).alias("rho_norm"))


def nearest_rank(values: Column, n: Column, q: float) -> Column:
    """The value at place round(q * (n - 1)) of a sorted array, halves to even."""
    return F.element_at(values, (F.bround(q * (n - 1)) + 1).cast("int"))


def rho_summary(rho: DataFrame, tau: float, column: str = "rho") -> DataFrame:
    """Where the ratios of the features lie; there is one a feature, so the array is small."""
    s = rho.agg(F.sort_array(F.collect_list(column)).alias("v"), F.count("*").alias("n"))
    over = lambda t: F.size(F.filter("v", lambda x: x >= t))
    return s.select("n", *[nearest_rank(F.col("v"), F.col("n"), q).alias(k) for k, q in (("max", 1.0), ("p99", 0.99), ("p95", 0.95), ("median", 0.5), ("min", 0.0))], F.size(F.filter("v", lambda x: x > tau)).alias("n_gt_tau"), *[over(t).alias(f"n_ge_{str(t).replace('.', '_')}") for t in (1.1, 1.25, 1.5, 2.0, 3.0)])


def top_by_magnitude(cells: DataFrame, k: int, by: str = "feature", key: str = "token_id") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.abs("value")), key))
    return cells.withColumn("rank", r).filter(F.col("rank") <= k)


def winners(cells: DataFrame, share: float, by: str = "feature") -> DataFrame:
    """The ceil(share * n) cells of largest magnitude of each column, with all that equal the last of them."""
    w = Window.partitionBy(by)
    r = F.rank().over(w.orderBy(F.desc(F.abs("value"))))
    return cells.withColumn("_r", r).withColumn("_n", F.count("*").over(w)).filter(F.col("_r") <= F.greatest(F.lit(1), F.ceil(share * F.col("_n")))).drop("_r", "_n")


def neuron_mass(cells: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(neuron, mass_norm, degree): each feature's non-zero magnitudes over their length, summed by neuron. cells: (token_id as neuron, feature, value)."""
    live = cells.filter("value <> 0")
    norms = live.groupBy("feature").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("len")).filter(F.col("len") > eps)
    return live.join(norms, "feature").groupBy(F.col("token_id").alias("neuron")).agg(F.sum(F.abs("value") / (F.col("len") + eps)).alias("mass_norm"), F.count("*").alias("degree"))


def coverage_k(mass: DataFrame, gamma: float) -> DataFrame:
    """(k): the least number of neurons, largest first, whose mass reaches gamma of the whole. One row a neuron is windowed, as many as a layer is wide."""
    w = Window.orderBy(F.desc("mass_norm"), "neuron")
    run = mass.withColumn("run", F.sum("mass_norm").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.crossJoin(mass.agg(F.sum("mass_norm").alias("all"))).agg(F.least(F.sum((F.col("run") < gamma * F.col("all")).cast("long")) + 1, F.count("*")).alias("k"))


def context_windows(tokens: DataFrame, width: int = 15) -> DataFrame:
    """(sid, pos, token) -> with context: the tokens up to `width` off within the sentence, joined."""
    w = Window.partitionBy("sid").orderBy("pos").rowsBetween(-width, width)
    return tokens.withColumn("context", F.concat_ws(" ", F.collect_list("token").over(w)))


def top_contexts(cells: DataFrame, top: int = 25, per_token: int = 3) -> DataFrame:
    """(feature, pos, token, value) -> the `top` cells of largest magnitude of each feature, at most per_token of one token, from the first 8 * top."""
    w = Window.partitionBy("feature")
    order = [F.desc(F.abs("value")), F.col("pos")]
    first = cells.withColumn("_r", F.row_number().over(w.orderBy(*order))).filter(F.col("_r") <= 8 * top)
    few = first.withColumn("_t", F.row_number().over(Window.partitionBy("feature", "token").orderBy("_r"))).filter(F.col("_t") <= per_token)
    return few.withColumn("rank", F.row_number().over(w.orderBy("_r"))).filter(F.col("rank") <= top).drop("_r", "_t")


def log_rate_ratios(tokens: DataFrame, smoothing: float = 1e-6) -> DataFrame:
    """(token, is_concept) -> log of the smoothed rate on one side over that on the other."""
    c, n = F.sum(F.col("is_concept").cast("long")), F.sum((~F.col("is_concept")).cast("long"))
    per = tokens.groupBy("token").agg(c.alias("c"), n.alias("n"))
    return per.crossJoin(F.broadcast(per.agg(F.greatest(F.sum("c"), F.lit(1)).alias("tc"), F.greatest(F.sum("n"), F.lit(1)).alias("tn")))).select("token", F.log((F.col("c") / F.col("tc") + smoothing) / (F.col("n") / F.col("tn") + smoothing)).alias("rate"))


def feature_score(lists: DataFrame, rates: DataFrame, default: float = 0.0) -> DataFrame:
    """(feature, tokens) -> the mean rate of the tokens; unknown ones have the default."""
    rows = lists.select("feature", F.explode("tokens").alias("token")).join(rates, "token", "left")
    return rows.groupBy("feature").agg(F.avg(F.coalesce("rate", F.lit(default))).alias("score"))


def row_edit(vectors: DataFrame, loadings: DataFrame, directions: DataFrame, delta: float) -> DataFrame:
    """(token_id, dim, value) minus delta times loadings (token_id, feature, w) by directions (feature, dim, d); rows without loadings stay."""
    shift = loadings.join(directions, "feature").groupBy("token_id", "dim").agg(F.sum(F.col("w") * F.col("d")).alias("shift"))
    return vectors.join(shift, ["token_id", "dim"], "left").select("token_id", "dim", (F.col("value") - delta * F.coalesce("shift", F.lit(0.0))).alias("value"))
