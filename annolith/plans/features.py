"""Queries of feature statistics and vector algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as X
from ..operators import features as A
from ..tables import Tables, sql
from .registry import query

R = lambda n, *cs: [F.round(c, n).alias(c) for c in cs]


def cells(spark, sf_dir):
    return Tables(spark, sf_dir).coordinates


@query("g17_feature_stats", sql("""SELECT feature, sum((abs(value) > 1e-12 AND code = 1)::INT)::BIGINT AS num_concept, sum((abs(value) > 1e-12 AND code = 0)::INT)::BIGINT AS num_neutral, sum((abs(value) > 1e-12 AND code = 2)::INT)::BIGINT AS num_both,
round(avg(CASE WHEN code = 1 THEN abs(value) END), 6) AS mean_abs_concept, round(avg(CASE WHEN code = 0 THEN abs(value) END), 6) AS mean_abs_neutral, round(avg(CASE WHEN code = 1 THEN abs(value) END) - avg(CASE WHEN code = 0 THEN abs(value) END), 6) AS diff_abs,
round(avg(CASE WHEN code = 1 THEN abs(value) END) / (avg(CASE WHEN code = 0 THEN abs(value) END) + 1e-8), 6) AS ratio_abs FROM coordinates GROUP BY feature""", "coordinates"))
def g17(spark, sf_dir):
    return A.feature_stats(cells(spark, sf_dir)).select("feature", "num_concept", "num_neutral", "num_both", *R(6, "mean_abs_concept", "mean_abs_neutral", "diff_abs", "ratio_abs"))


@query("g18_token_codes", "SELECT l_partkey AS token_id, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') THEN 2 WHEN bool_or(l_returnflag = 'R') THEN 1 ELSE 0 END AS code FROM lineitem GROUP BY l_partkey")
def g18(spark, sf_dir):
    o = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("token_id"), F.when(F.col("l_returnflag") == "R", "concept").otherwise("neutral").alias("origin"))
    return A.token_codes(o)


RHO = """SELECT feature, avg(CASE WHEN code = 1 THEN a END) / (avg(CASE WHEN code <> 1 THEN a END) + 1e-8) AS rho, avg(CASE WHEN code = 1 THEN s END) / (avg(CASE WHEN code <> 1 THEN s END) + 1e-8) AS rho_norm
FROM (SELECT *, abs(value) AS a, abs(value) / greatest(sum(abs(value)) OVER (PARTITION BY token_id), 1e-8) AS s FROM coordinates) GROUP BY feature"""


@query("g19_mass_ratio", sql(f"SELECT feature, round(rho, 6) AS rho, round(rho_norm, 6) AS rho_norm FROM ({RHO})", "coordinates"))
def g19(spark, sf_dir):
    return A.mass_ratio(cells(spark, sf_dir)).select("feature", *R(6, "rho", "rho_norm"))


@query("g20_rho_summary", sql(f""", r AS (SELECT round(rho, 6) AS rho FROM ({RHO})), s AS (SELECT list_sort(list(rho)) AS v, count(*) AS n FROM r)
SELECT n, v[n] AS max, v[round_even(0.99 * (n - 1), 0)::INT + 1] AS p99, v[round_even(0.95 * (n - 1), 0)::INT + 1] AS p95, v[round_even(0.5 * (n - 1), 0)::INT + 1] AS median, v[1] AS min, len(list_filter(v, lambda x: x > 1.0))::INT AS n_gt_tau,
len(list_filter(v, lambda x: x >= 1.1))::INT AS n_ge_1_1, len(list_filter(v, lambda x: x >= 1.25))::INT AS n_ge_1_25, len(list_filter(v, lambda x: x >= 1.5))::INT AS n_ge_1_5, len(list_filter(v, lambda x: x >= 2.0))::INT AS n_ge_2_0, len(list_filter(v, lambda x: x >= 3.0))::INT AS n_ge_3_0 FROM s""", "coordinates"))
def g20(spark, sf_dir):
    return A.rho_summary(A.mass_ratio(cells(spark, sf_dir)).select(F.round("rho", 6).alias("rho")), 1.0)


RATES = """WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS token, lang = 'de' AS c FROM documents),
p AS (SELECT token, sum(c::INT)::BIGINT AS c, sum((NOT c)::INT)::BIGINT AS n FROM w GROUP BY token), r AS (SELECT token, ln((c / (SELECT sum(c) FROM p)::DOUBLE + 1e-6) / (n / (SELECT sum(n) FROM p)::DOUBLE + 1e-6)) AS rate FROM p)"""


def rates(spark, sf_dir):
    from ..operators.retrieval import tokens

    d = Tables(spark, sf_dir).documents
    return A.log_rate_ratios(d.select(F.explode(tokens(F.col("text"))).alias("token"), (F.col("lang") == "de").alias("is_concept")))


@query("g21_log_rate_ratio", RATES + " SELECT token, round(rate, 6) AS rate FROM r")
def g21(spark, sf_dir):
    return rates(spark, sf_dir).select("token", *R(6, "rate"))


@query("g22_feature_score", RATES + ", l AS (SELECT item_id AS feature, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '')) AS token FROM benchmark) SELECT feature, round(avg(coalesce(rate, 0)), 6) AS score FROM l LEFT JOIN r USING (token) GROUP BY feature")
def g22(spark, sf_dir):
    from ..operators.retrieval import tokens

    lists = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("feature"), tokens(F.col("text")).alias("tokens"))
    return A.feature_score(lists, rates(spark, sf_dir)).select("feature", *R(6, "score"))


@query("g23_marker_share", "SELECT doc_id, round(len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, 'ing'))) / len(string_split(text, ' '))::DOUBLE, 6) AS share FROM documents")
def g23(spark, sf_dir):
    a = F.split("text", " ")
    return Tables(spark, sf_dir).documents.select("doc_id", F.round(F.size(F.filter(a, lambda x: x.rlike("ing"))) / F.size(a), 6).alias("share"))


@query("g30_null_comparison", sql("""WITH m AS (SELECT concept, round(avg(nll_edited - nll_full), 8) AS d FROM paired_nll GROUP BY concept), n AS (SELECT avg(x) AS null_mean, stddev_samp(x) AS null_sd, min(x) AS null_min, max(x) AS null_max, max(abs(x)) AS null_abs_max, list(abs(x)) AS a FROM (SELECT item_id % 20 AS g, round(avg(nll_twin - nll_full), 8) AS x FROM paired_nll GROUP BY 1))
SELECT concept, round(d, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(null_min, 6) AS null_min, round(null_max, 6) AS null_max, round(null_abs_max, 6) AS null_abs_max, round((d - null_mean) / null_sd, 4) AS z, (1 + len(list_filter(a, lambda x: x > abs(d))))::INT AS place FROM m, n""", "paired_nll"))
def g30(spark, sf_dir):
    from ..operators.inference import null_comparison

    p = Tables(spark, sf_dir).paired_nll
    seen = p.groupBy("concept").agg(F.round(F.avg(F.col("nll_edited") - F.col("nll_full")), 8).alias("d"))
    null = p.groupBy(F.expr("item_id % 20")).agg(F.round(F.avg(F.col("nll_twin") - F.col("nll_full")), 8).alias("d"))
    return null_comparison(seen, null, "concept", "d").select("concept", *R(6, "observed", "null_mean", "null_sd", "null_min", "null_max", "null_abs_max"), F.round("z", 4).alias("z"), "place")


WORDS = "SELECT item_id AS sid, unnest(range(len(w)))::INT AS pos, unnest(w) AS token FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)"


@query("w7_context_windows", f"SELECT sid, pos, token, string_agg(token, ' ') OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS context FROM ({WORDS})")
def w7(spark, sf_dir):
    return A.context_windows(Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("sid"), F.posexplode(F.split("text", " ")).alias("pos", "token")))


@query("w8_top_contexts", sql("""WITH c AS (SELECT feature, token_id AS pos, 'k' || token_id % 6 AS token, value, row_number() OVER (PARTITION BY feature ORDER BY abs(value) DESC, token_id) AS r FROM coordinates),
t AS (SELECT *, row_number() OVER (PARTITION BY feature, token ORDER BY r) AS t FROM c WHERE r <= 80), f AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY r)::INT AS rank FROM t WHERE t <= 3) SELECT feature, pos, token, round(value, 6) AS value, rank FROM f WHERE rank <= 10""", "coordinates"))
def w8(spark, sf_dir):
    c = cells(spark, sf_dir).select("feature", F.col("token_id").alias("pos"), F.concat(F.lit("k"), F.col("token_id") % 6).alias("token"), "value")
    return A.top_contexts(c, top=10).select("feature", "pos", "token", F.round("value", 6).alias("value"), "rank")


MASS = "SELECT token_id AS neuron, sum(abs(value) / (len + 1e-12)) AS mass_norm, count(*) AS degree FROM coordinates JOIN (SELECT feature, sqrt(sum(value * value)) AS len FROM coordinates WHERE value <> 0 GROUP BY feature HAVING sqrt(sum(value * value)) > 1e-12) USING (feature) WHERE value <> 0 GROUP BY token_id"


@query("m23_neuron_mass", sql(f"SELECT neuron, round(mass_norm, 6) AS mass_norm, degree FROM ({MASS})", "coordinates"))
def m23(spark, sf_dir):
    return A.neuron_mass(cells(spark, sf_dir)).select("neuron", *R(6, "mass_norm"), "degree")


@query("w9_coverage", sql(f"SELECT least(sum((run < 0.95 * total)::INT) + 1, count(*))::BIGINT AS k FROM (SELECT sum(mass_norm) OVER (ORDER BY mass_norm DESC, neuron ROWS UNBOUNDED PRECEDING) AS run, sum(mass_norm) OVER () AS total FROM ({MASS}))", "coordinates"))
def w9(spark, sf_dir):
    return A.coverage_k(A.neuron_mass(cells(spark, sf_dir)), 0.95)


@query("w13_winners", sql("SELECT feature, token_id FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY abs(value) DESC) AS r, count(*) OVER (PARTITION BY feature) AS n FROM coordinates) WHERE r <= greatest(1, ceil(0.01 * n))", "coordinates"))
def w13(spark, sf_dir):
    return A.winners(cells(spark, sf_dir), 0.01).select("feature", "token_id")


@query("w14_top_by_magnitude", sql("SELECT feature, token_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(value) DESC, token_id)::INT AS rank FROM coordinates) WHERE rank <= 10", "coordinates"))
def w14(spark, sf_dir):
    return A.top_by_magnitude(cells(spark, sf_dir), 10).select("feature", "token_id", "rank")


@query("p12_eligible_features", sql(f"SELECT feature FROM ({RHO}) WHERE rho >= 0.95 ORDER BY feature", "coordinates"))
def p12(spark, sf_dir):
    return A.mass_ratio(cells(spark, sf_dir)).select("feature", F.col("rho").cast("string").try_cast("double").alias("rho")).filter("rho >= 0.95").select("feature").dropDuplicates().orderBy("feature")


@query("p13_feature_sources", "SELECT DISTINCT p_size AS layer, p_partkey AS feature, CASE WHEN p_size <= 17 THEN 'activation' ELSE 'projection' END AS source FROM part WHERE (p_size <= 17 AND p_partkey % 2 = 0) OR (p_size >= 18 AND p_partkey % 2 = 1)")
def p13(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    source = F.when(F.col("p_partkey") % 2 == 0, "activation").otherwise("projection")
    rows = p.select(F.col("p_size").alias("layer"), F.col("p_partkey").alias("feature"), source.alias("source"))
    return rows.filter(F.when(F.col("layer") <= 17, F.col("source") == "activation").otherwise(F.col("source") == "projection")).dropDuplicates()


@query("p14_members", "SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 AND p_size / 50.0 >= 0.5")
def p14(spark, sf_dir):
    raw = Tables(spark, sf_dir).part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, " True ").otherwise("no").alias("is_member"), (F.col("p_size") / 50).cast("string").alias("confidence"))
    return raw.filter((F.lower(F.trim("is_member")) == "true") & (F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= 0.5)).select("p_partkey")


@query("r6_stats_tokens_merge", sql(f"SELECT feature, round(rho, 6) AS rho, n FROM ({RHO}) JOIN (SELECT label AS feature, count(*) AS n FROM embeddings GROUP BY label) USING (feature)", "coordinates"))
def r6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.mass_ratio(t.coordinates).join(t.embeddings.groupBy(F.col("label").alias("feature")).agg(F.count("*").alias("n")), "feature").select("feature", *R(6, "rho"), "n")


@query("r7_left_merge", sql(f"SELECT p_partkey AS feature, round(rho, 6) AS rho FROM part LEFT JOIN ({RHO}) ON feature = p_partkey", "coordinates"))
def r7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.part.select(F.col("p_partkey").alias("feature")).join(A.mass_ratio(t.coordinates), "feature", "left").select("feature", *R(6, "rho"))


V = "SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings"


@query("m24_embedding_health", f"SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.x, lambda e: e * e))), 6) AS norm, sqrt(list_sum(list_transform(a.x, lambda e: e * e))) = 0 AS is_zero, round(list_sum(list_transform(a.x, lambda e, i: e * b.x[i])) / sqrt(list_sum(list_transform(a.x, lambda e: e * e)) * list_sum(list_transform(b.x, lambda e: e * e))), 6) AS cosine FROM ({V}) a JOIN ({V}) b ON b.vec_id = a.vec_id + 1")
def m24(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return j.select("vec_id", F.round(X.norm(F.col("x")), 6).alias("norm"), (X.norm(F.col("x")) == 0).alias("is_zero"), F.round(X.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("m25_row_edit", sql("""WITH l AS (SELECT token_id, feature, value AS w FROM coordinates WHERE feature < 4 AND code = 1), d AS (SELECT token_id AS feature, feature AS dim, value AS d FROM coordinates WHERE token_id < 4),
s AS (SELECT token_id, dim, sum(w * d) AS shift FROM l JOIN d USING (feature) GROUP BY token_id, dim) SELECT c.token_id, c.feature AS dim, round(c.value - 0.5 * coalesce(shift, 0), 6) AS value FROM coordinates c LEFT JOIN s ON s.token_id = c.token_id AND s.dim = c.feature""", "coordinates"))
def m25(spark, sf_dir):
    c = cells(spark, sf_dir)
    loadings = c.filter("feature < 4 and code = 1").select("token_id", "feature", F.col("value").alias("w"))
    directions = c.filter("token_id < 4").select(F.col("token_id").cast("int").alias("feature"), F.col("feature").alias("dim"), F.col("value").alias("d"))
    rows = c.select("token_id", F.col("feature").alias("dim"), "value")
    return A.row_edit(rows, loadings, directions, 0.5).withColumn("value", F.round("value", 6))


@query("m26_direction_norms", f"SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.x, lambda e, i: (b.x[i] - e) * (b.x[i] - e)))) / sqrt(list_sum(list_transform(a.x, lambda e: e * e))), 6) AS relative_norm FROM ({V}) a JOIN ({V}) b ON b.vec_id = a.vec_id + 1")
def m26(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    step = F.zip_with("x", "y", lambda a, b: b - a)
    return j.select("vec_id", F.round(X.norm(step) / X.norm(F.col("x")), 6).alias("relative_norm"))


@query("w9_running_share", sql(f"SELECT neuron, round(sum(mass_norm) OVER (ORDER BY mass_norm DESC, neuron ROWS UNBOUNDED PRECEDING) / sum(mass_norm) OVER (), 6) AS share FROM ({MASS})", "coordinates"))
def w9_share(spark, sf_dir):
    w = Window.orderBy(F.desc("mass_norm"), "neuron").rowsBetween(Window.unboundedPreceding, 0)
    m = A.neuron_mass(cells(spark, sf_dir))
    return m.crossJoin(m.agg(F.sum("mass_norm").alias("all"))).select("neuron", F.round(F.sum("mass_norm").over(w) / F.col("all"), 6).alias("share"))
