"""Queries of resampling and permutation inference. Point estimates have a twin; intervals are tested against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import scoring as S
from ..tables import Tables, sql
from .registry import query

DRAWS = 2_000


def pairs(spark, sf_dir):
    p = Tables(spark, sf_dir).paired_nll
    dm, df = F.abs(F.col("nll_edited") - F.col("nll_twin")), F.abs(F.col("nll_full") - F.col("nll_twin"))
    # every concept's items are cut into sets of a few hundred, as question sets are
    return p.select("concept", "item_set", F.expr("item_id % 40").alias("set"), F.col("item_id").alias("order_key"), dm.alias("d_m"), df.alias("d_f"), (F.col("nll_edited") - F.col("nll_full")).alias("d"))


def rounded(df, keys, n=6):
    return df.select(*keys, *[F.round(c, n).alias(c) for c in df.columns if c not in keys])


@query("b1_bootstrap_ratio")
def b1(spark, sf_dir):
    return rounded(I.bootstrap_ratio(pairs(spark, sf_dir), ["concept", "set"], "d_m", "d_f", DRAWS), ["concept", "set"])


@query("b2_bootstrap_closeness")
def b2(spark, sf_dir):
    return rounded(I.bootstrap_closeness(pairs(spark, sf_dir), ["concept", "set"], DRAWS), ["concept", "set"])


@query("b3_bootstrap_mean")
def b3(spark, sf_dir):
    return rounded(I.bootstrap_mean(pairs(spark, sf_dir), ["concept", "set"], "d", 1_000), ["concept", "set"])


@query("b4_contrast_interval")
def b4(spark, sf_dir):
    return rounded(I.contrast_ci(pairs(spark, sf_dir), ["concept", "set"], "d", "item_set", {"O": 1.0, "F": -0.5, "P": -0.5}, DRAWS), ["concept", "set"])


@query("b5_sign_flip")
def b5(spark, sf_dir):
    return rounded(I.sign_flip_p(pairs(spark, sf_dir), ["concept", "set"], "d", DRAWS), ["concept", "set"])


@query("b6_difference_of_differences")
def b6(spark, sf_dir):
    return rounded(I.difference_of_differences_p(pairs(spark, sf_dir), ["concept", "set"], "d", "item_set", "O", "F", DRAWS), ["concept", "set"])


@query("b7_tiered_comparison", sql("SELECT concept, item_set AS tier, count(*) AS n, round(avg(nll_edited - nll_full), 6) AS mean, round(stddev_samp(nll_edited - nll_full), 6) AS sd, round(avg((nll_edited < nll_full)::INT), 6) AS frac_neg FROM paired_nll GROUP BY concept, item_set", "paired_nll"))
def b7(spark, sf_dir):
    s = S.signed_summary(pairs(spark, sf_dir), "d", "concept", F.col("item_set").alias("tier"))
    return rounded(s.select("concept", "tier", "n", "mean", "sd", "frac_neg"), ["concept", "tier", "n"])


@query("b_point_estimates", sql("SELECT concept, item_id % 40 AS set, round(avg(abs(nll_edited - nll_twin)) / avg(abs(nll_full - nll_twin)), 6) AS ratio, round(avg((abs(nll_edited - nll_twin) < abs(nll_full - nll_twin))::INT), 6) AS p_closer FROM paired_nll GROUP BY 1, 2", "paired_nll"))
def points(spark, sf_dir):
    p, keys = pairs(spark, sf_dir), ["concept", "set"]
    a = I.bootstrap_ratio(p, keys, "d_m", "d_f", 2).select(*keys, F.round("ratio", 6).alias("ratio"))
    return a.join(I.bootstrap_closeness(p, keys, 2).select(*keys, F.round("p_closer", 6).alias("p_closer")), keys)


@query("m18_student_t")
def m18(spark, sf_dir):
    from ..functions.stats import t_p_value

    p = Tables(spark, sf_dir).part
    return p.select("p_partkey", F.round(t_p_value((F.col("p_size") - 25) / 10, (F.col("p_partkey") % 30 + 1).cast("double")), 8).alias("p"))


@query("m19_effect_sizes", sql("SELECT concept, round(CASE WHEN sqrt((va + vb) / 2) > 1e-12 THEN (a - b) / sqrt((va + vb) / 2) ELSE 0 END, 6) AS d FROM (SELECT concept, avg(CASE WHEN item_set = 'O' THEN x END) AS a, avg(CASE WHEN item_set = 'F' THEN x END) AS b, var_samp(CASE WHEN item_set = 'O' THEN x END) AS va, var_samp(CASE WHEN item_set = 'F' THEN x END) AS vb FROM (SELECT concept, item_set, nll_edited - nll_full AS x FROM paired_nll) GROUP BY concept)", "paired_nll"))
def m19(spark, sf_dir):
    return rounded(I.pooled_effect(pairs(spark, sf_dir), ["concept"], "d", "item_set", "O", "F"), ["concept"])


@query("m20_paired_effect", sql("SELECT concept, n, round(m, 6) AS mean, round(z, 6) AS dz, round(z - 1.96 * sqrt(1 / n + z * z / (2 * n)), 6) AS dz_low, round(z + 1.96 * sqrt(1 / n + z * z / (2 * n)), 6) AS dz_high, round(z * sqrt(n), 4) AS t FROM (SELECT concept, count(*) AS n, avg(x) AS m, avg(x) / stddev_samp(x) AS z FROM (SELECT concept, nll_edited - nll_full AS x FROM paired_nll) GROUP BY concept)", "paired_nll"))
def m20(spark, sf_dir):
    e = I.paired_effect(pairs(spark, sf_dir), ["concept"], "d")
    return e.select("concept", "n", *[F.round(c, 6).alias(c) for c in ("mean", "dz", "dz_low", "dz_high")], F.round("t", 4).alias("t"))
