"""Queries of scoring, selection and paired comparison."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as X
from ..operators import scoring as S
from ..tables import Tables, sql
from .registry import query

R6 = lambda *cs: [F.round(c, 6).alias(c) for c in cs]
ARRAYS = "SELECT question_id, any_value(gold_index) AS g, list(per_char ORDER BY option_index) AS a, list(logp ORDER BY option_index) AS c, list(logp_null ORDER BY option_index) AS z, list(n_chars ORDER BY option_index) AS n FROM option_scores GROUP BY question_id"


def arrays(spark, sf_dir):
    return S.option_arrays(Tables(spark, sf_dir).option_scores, "per_char", "logp", "logp_null", "n_chars")


@query("w4_predictions", sql(f"SELECT question_id, (list_position(a, list_max(a)) - 1)::INT AS predicted, (list_position(a, list_max(a)) - 1 = g)::INT AS is_correct, len(list_filter(a, lambda x: x = list_max(a)))::INT AS n_ties, a[g + 1] - list_max(list_concat(a[:g], a[g + 2:])) AS gold_margin FROM ({ARRAYS})", "option_scores"))
def w4(spark, sf_dir):
    return S.predictions(Tables(spark, sf_dir).option_scores, "per_char")


@query("g11_group_accuracy", sql("""SELECT model, question_group, count(*) AS n, sum(is_correct)::BIGINT AS n_correct, round(avg(is_correct), 6) AS accuracy, round(avg(gold_margin), 6) AS mean_margin, round(stddev_samp(gold_margin), 6) AS sd_margin,
round(stddev_samp(gold_margin) / sqrt(count(*)), 6) AS se_margin, sum(isnan(gold_margin)::INT)::BIGINT AS n_nonfinite FROM question_scores GROUP BY model, question_group""", "question_scores"))
def g11(spark, sf_dir):
    r = S.group_accuracy(Tables(spark, sf_dir).question_scores, "model", "question_group")
    return r.select("model", "question_group", "n", "n_correct", *R6("accuracy", "mean_margin", "sd_margin", "se_margin"), "n_nonfinite")


@query("g12_signed_summary", sql("SELECT concept, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(stddev_samp(d), 6) AS sd, round(avg((d > 0)::INT), 6) AS frac_pos, round(avg((d < 0)::INT), 6) AS frac_neg FROM (SELECT concept, nll_edited - nll_full AS d FROM paired_nll) GROUP BY concept", "paired_nll"))
def g12(spark, sf_dir):
    p = Tables(spark, sf_dir).paired_nll.withColumn("d", F.col("nll_edited") - F.col("nll_full"))
    return S.signed_summary(p, "d", "concept").select("concept", "n", *R6("mean", "median", "sd", "frac_pos", "frac_neg"))


@query("g13_accuracy_by_rule", sql(f"""WITH a AS (SELECT question_id % 5 AS concept, g, c, list_transform(c, lambda x, i: x / n[i]) AS cc, list_transform(c, lambda x, i: x - z[i]) AS p, list_transform(c, lambda x, i: (x - z[i]) / n[i]) AS pc FROM ({ARRAYS}))
SELECT concept, count(*) AS n, round(avg((list_position(c, list_max(c)) = g + 1)::INT), 6) AS cond_sum, round(avg((list_position(cc, list_max(cc)) = g + 1)::INT), 6) AS cond_per_char, round(avg((list_position(p, list_max(p)) = g + 1)::INT), 6) AS pmi_sum, round(avg((list_position(pc, list_max(pc)) = g + 1)::INT), 6) AS pmi_per_char,
sum((list_position(c, list_max(c)) = 1)::INT)::BIGINT AS n_a, sum((list_position(c, list_max(c)) = 2)::INT)::BIGINT AS n_b, sum((list_position(c, list_max(c)) = 3)::INT)::BIGINT AS n_c, sum((list_position(c, list_max(c)) = 4)::INT)::BIGINT AS n_d FROM a GROUP BY concept""", "option_scores"))
def g13(spark, sf_dir):
    a = arrays(spark, sf_dir)
    rules = X.scoring_rules(F.col("logp"), F.col("logp_null"), F.col("n_chars"))
    right = {k: F.round(F.avg((X.argmax(v) == F.col("gold_index")).cast("int")), 6).alias(k) for k, v in rules.items()}
    letters = [F.sum((X.argmax(F.col("logp")) == i).cast("long")).alias(f"n_{x}") for i, x in enumerate("abcd")]
    return a.groupBy(F.expr("question_id % 5").alias("concept")).agg(F.count("*").alias("n"), *right.values(), *letters)


@query("g14_completion_summary", sql(f"""WITH s AS (SELECT question_id % 5 AS concept, g, a, list_transform(a, lambda x: exp(x - list_max(a))) AS e FROM ({ARRAYS})), p AS (SELECT *, e[g + 1] / list_sum(e) AS pg FROM s)
SELECT concept, count(*) AS n, round(avg(a[g + 1]), 6) AS mean_gold, round(avg(pg), 6) AS soft_accuracy, round(avg(ln(greatest(pg, 1e-12))), 6) AS mean_log_p, round(avg(list_max(e) / list_sum(e)), 6) AS confidence FROM p GROUP BY concept""", "option_scores"))
def g14(spark, sf_dir):
    p = arrays(spark, sf_dir).withColumn("p", X.softmax(F.col("per_char"))).withColumn("pg", F.element_at("p", F.col("gold_index") + 1))
    return p.groupBy(F.expr("question_id % 5").alias("concept")).agg(F.count("*").alias("n"), F.round(F.avg(F.element_at("per_char", F.col("gold_index") + 1)), 6).alias("mean_gold"), F.round(F.avg("pg"), 6).alias("soft_accuracy"), F.round(F.avg(F.log(F.greatest("pg", F.lit(1e-12)))), 6).alias("mean_log_p"), F.round(F.avg(F.array_max("p")), 6).alias("confidence"))


@query("g15_perplexity", "SELECT o_orderpriority AS g, count(*) AS n, round(avg(l), 6) AS macro_loss, round(sum(l * (t - 1)) / sum(t - 1), 6) AS micro_loss, round(exp(avg(l)), 6) AS macro_ppl, round(exp(sum(l * (t - 1)) / sum(t - 1)), 6) AS micro_ppl FROM (SELECT o_orderpriority, o_totalprice / 100000 AS l, o_custkey % 90 + 2 AS t FROM orders) GROUP BY o_orderpriority")
def g15(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 100000).alias("loss"), (F.col("o_custkey") % 90 + 2).alias("tokens"))
    return S.weighted_perplexity(o, "g").select("g", "n", *R6("macro_loss", "micro_loss", "macro_ppl", "micro_ppl"))


@query("g24_cell_rollup", "SELECT p_brand, count(*) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median, count(CASE WHEN p_size > 25 THEN 1 END) AS n_large, count(CASE WHEN p_size > 25 AND p_retailprice > 1000 THEN 1 END) AS n_both, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS best, round(max(p_retailprice) - min(p_retailprice), 6) AS spread FROM part GROUP BY p_brand")
def g24(spark, sf_dir):
    return Tables(spark, sf_dir).part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.percentile("p_retailprice", 0.5), 6).alias("median"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.count_if((F.col("p_size") > 25) & (F.col("p_retailprice") > 1000)).alias("n_both"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("best"), F.round(F.max("p_retailprice") - F.min("p_retailprice"), 6).alias("spread"))


DISCORDANT = "count(CASE WHEN a AND NOT b THEN 1 END) AS b, count(CASE WHEN b AND NOT a THEN 1 END) AS c, count(*) AS n FROM (SELECT lang, source, quality = 1 AS a, toxic = 1 AS b FROM labels JOIN documents USING (doc_id))"


def discordant():
    a, b = F.col("quality") == 1, F.col("toxic") == 1
    return [F.count_if(a & ~b).alias("b"), F.count_if(b & ~a).alias("c"), F.count("*").alias("n")]


@query("g25_discordant_totals", f"SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, {DISCORDANT} GROUP BY ROLLUP (lang, source)")
def g25(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.labels.join(t.documents.select("doc_id", F.col("lang").alias("l"), F.col("source").alias("s")), "doc_id")
    return totals(rows)


def totals(rows):
    r = rows.rollup("l", "s").agg(*discordant(), F.grouping("l").alias("gl"), F.grouping("s").alias("gs"))
    return r.select(F.when(F.col("gl") == 1, "ALL").otherwise(F.col("l")).alias("lang"), F.when(F.col("gs") == 1, "ALL").otherwise(F.col("s")).alias("source"), "b", "c", "n")


@query("m17_exact_paired_test", f"""WITH t AS (SELECT lang, {DISCORDANT} GROUP BY lang), k AS (SELECT lang, b, c, unnest(range(0, least(b, c) + 1)) AS k FROM t)
SELECT lang, b, c, round(least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)))), 6) AS p FROM k GROUP BY lang, b, c""")
def m17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(*discordant())
    return rows.select("lang", "b", "c", F.round(X.binomial_two_sided(F.col("b"), F.col("c")), 6).alias("p"))


@query("g26_baseline_ids", sql("SELECT concept, len(ids)::BIGINT AS n_correct, ids, round(n / total::DOUBLE, 6) AS accuracy, round(bad / total::DOUBLE, 6) AS invalid_rate FROM (SELECT question_group AS concept, list_sort(list(DISTINCT question_id) FILTER (is_correct = 1 AND question_id < 100)) AS ids, sum(is_correct) AS n, count(*) AS total, sum((gold_margin = 0)::INT) AS bad FROM question_scores GROUP BY question_group)", "question_scores"))
def g26(spark, sf_dir):
    q = Tables(spark, sf_dir).question_scores
    ids = F.array_sort(F.collect_set(F.when((F.col("is_correct") == 1) & (F.col("question_id") < 100), F.col("question_id"))))
    return q.groupBy(F.col("question_group").alias("concept")).agg(F.size(ids).cast("long").alias("n_correct"), ids.alias("ids"), F.round(F.avg("is_correct"), 6).alias("accuracy"), F.round(F.avg((F.col("gold_margin") == 0).cast("int")), 6).alias("invalid_rate"))


DOSE = "SELECT o_orderkey, o_totalprice / 100000 - 1 AS delta, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS k, o_custkey % 50 + 1 AS toks FROM orders"
BUCKET = "CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 7 THEN '4-7' ELSE '8+' END"


def dosed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    k = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    return t.orders.join(k, "o_orderkey", "left").select("o_orderkey", (F.col("o_totalprice") / 100000 - 1).alias("delta"), F.coalesce("k", F.lit(0)).alias("k"), (F.col("o_custkey") % 50 + 1).alias("toks"))


@query("g27_dose_response", f"SELECT {BUCKET} AS bucket, count(*) AS n, round(avg(delta), 6) AS mean_delta, count(CASE WHEN delta > 3 THEN 1 END) AS n_shattered FROM ({DOSE}) GROUP BY 1")
def g27(spark, sf_dir):
    d = dosed(spark, sf_dir)
    return d.groupBy(S.dose_buckets(F.col("k")).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.count_if(F.col("delta") > 3).alias("n_shattered"))


@query("r20_edited_tokens", f"SELECT k > 0 AS with_edited, count(*) AS n, round(avg(delta), 6) AS mean_delta, round(avg(k / greatest(toks, 1)::DOUBLE), 6) AS density FROM ({DOSE}) GROUP BY 1")
def r20(spark, sf_dir):
    return dosed(spark, sf_dir).groupBy((F.col("k") > 0).alias("with_edited")).agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"), F.round(F.avg(F.col("k") / F.greatest("toks", F.lit(1))), 6).alias("density"))


@query("g29_variance_decomposition", sql("SELECT concept, round(stddev_samp(m) * stddev_samp(m) - avg(se * se), 6) AS between, round(avg(se), 6) AS mean_se FROM (SELECT concept, item_set, avg(nll_edited) AS m, stddev_samp(nll_edited) / sqrt(count(*)) AS se FROM paired_nll GROUP BY concept, item_set) GROUP BY concept", "paired_nll"))
def g29(spark, sf_dir):
    per = Tables(spark, sf_dir).paired_nll.groupBy("concept", "item_set").agg(F.avg("nll_edited").alias("m"), (F.stddev_samp("nll_edited") / F.sqrt(F.count("*"))).alias("se"))
    return per.groupBy("concept").agg(F.round(F.stddev_samp("m") * F.stddev_samp("m") - F.avg(F.col("se") * F.col("se")), 6).alias("between"), F.round(F.avg("se"), 6).alias("mean_se"))


ACC = "SELECT p_brand AS topic, p_size % 4 AS m, 'c' || p_partkey AS label, (p_partkey % 10) / 10 AS target, (p_size % 7) / 7 AS neighbour, 0.3 + (p_partkey % 5) / 10 AS unrelated FROM part"
NORM = "greatest(0.0, least(1.0, ({0} - 0.25) / (0.9 - 0.25)))"
HM2 = "CASE WHEN {0} > 0 AND {1} > 0 THEN 2 / (1 / {0} + 1 / {1}) ELSE 0.0 END"
H_SQL = f"""WITH n AS (SELECT topic, m, label, {NORM.format('target')} AS t, {NORM.format('neighbour')} AS n, {NORM.format('unrelated')} AS u FROM ({ACC})), k AS (SELECT *, {HM2.format('n', 'u')} AS keep FROM n),
h AS (SELECT topic, m, label, t, n, u, CASE WHEN 1 - t > 0 AND keep > 0 THEN 2 / (1 / (1 - t) + 1 / keep) ELSE 0.0 END AS h FROM k)"""


def candidates(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    acc = p.select(F.col("p_brand").alias("topic"), F.expr("p_size % 4").alias("method"), F.concat(F.lit("c"), "p_partkey").alias("label"), (F.col("p_partkey") % 10 / 10).alias("target"), (F.col("p_size") % 7 / 7).alias("neighbour"), (0.3 + F.col("p_partkey") % 5 / 10).alias("unrelated"))
    full = p.select(F.col("p_brand").alias("topic")).distinct().select("topic", *[F.lit(0.9).alias(f"full_{g}") for g in ("target", "neighbour", "unrelated")])
    return S.selection_table(acc, full)


@query("m3_chance_normalised", H_SQL + " SELECT label, round(t, 6) AS norm_target, round(n, 6) AS norm_neighbour, round(u, 6) AS norm_unrelated FROM h")
def m3(spark, sf_dir):
    return candidates(spark, sf_dir).select("label", *R6("norm_target", "norm_neighbour", "norm_unrelated"))


@query("m4_retention_score", H_SQL + " SELECT label, round(h, 6) AS h FROM h")
def m4(spark, sf_dir):
    return candidates(spark, sf_dir).select("label", *R6("h"))


RANKED = H_SQL + ", r AS (SELECT topic, m, label, round(h, 6) AS h, row_number() OVER (PARTITION BY topic, m ORDER BY round(h, 6) DESC, round(u, 6) DESC, label)::INT AS rank, round(u, 6) AS u FROM h)"


def ranked(spark, sf_dir):
    c = candidates(spark, sf_dir).select("topic", "method", "label", F.round("h", 6).alias("h"), F.round("norm_unrelated", 6).alias("u"))
    return S.rank_candidates(c, ["topic", "method"], [F.desc("h"), F.desc("u"), F.col("label")])


@query("w1_rank_candidates", RANKED + " SELECT topic, m AS method, label, h, rank, rank = 1 AS selected FROM r")
def w1(spark, sf_dir):
    return ranked(spark, sf_dir).select("topic", "method", "label", "h", "rank", "selected")


@query("w3_tie_log", RANKED + " SELECT topic, m AS method, rank, label, next_label FROM (SELECT *, lead(label) OVER w AS next_label, lead(h) OVER w AS nh, lead(u) OVER w AS nu FROM r WINDOW w AS (PARTITION BY topic, m ORDER BY rank)) WHERE nh = h AND nu = u")
def w3(spark, sf_dir):
    return S.tie_log(ranked(spark, sf_dir), ["topic", "method"], ["h", "u"])


@query("p16_parse_labels", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'MF' WHEN 1 THEN 'RMU' ELSE 'SNMF' END AS method, 'rome' AS topic,
CASE p_partkey % 3 WHEN 0 THEN p_size / 10 WHEN 1 THEN p_size ELSE 1 END::DOUBLE AS a, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END ELSE 2 END::DOUBLE AS b, CASE p_partkey % 3 WHEN 1 THEN 100 ELSE 0 END::DOUBLE AS c FROM part""")
def p16(spark, sf_dir):
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    label = F.when(k == 0, F.concat(F.lit("mf_rome_d"), (s / 10).cast("string"))).when(k == 1, F.concat(F.lit("rmu_rome_L"), s, F.when(s % 2 == 0, "mid").otherwise("hi"), F.lit("_a100"))).otherwise("snmf_rome_judge_both")
    return Tables(spark, sf_dir).part.select("p_partkey", S.parse_config(label).alias("x")).select("p_partkey", "x.method", "x.topic", "x.tiebreak.*")


@query("m1_harmonic_mean", "SELECT l_orderkey, CASE WHEN bool_or(l_discount <= 0) THEN 0.0 ELSE round(count(*) / sum(CASE WHEN l_discount > 0 THEN 1 / l_discount END), 6) END AS h FROM lineitem GROUP BY l_orderkey")
def m1(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("a")).select("l_orderkey", F.round(X.harmonic_mean(F.col("a")), 6).alias("h"))


@query("m2_clip", "SELECT p_partkey, round(greatest(0.0, least(1.0, p_retailprice / 1000 - 0.5)), 6) AS x FROM part")
def m2(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", F.round(X.clip01(F.col("p_retailprice") / 1000 - 0.5), 6).alias("x"))


@query("m5_erasure_metrics", H_SQL + ", e AS (SELECT topic, avg(1 - t) AS efficacy, avg(n) AS specificity FROM h GROUP BY topic) SELECT topic, round(efficacy, 6) AS efficacy, round(specificity, 6) AS specificity, round(" + HM2.format("efficacy", "specificity") + ", 6) AS objective FROM e")
def m5(spark, sf_dir):
    e = candidates(spark, sf_dir).groupBy("topic").agg(F.avg(1 - F.col("norm_target")).alias("efficacy"), F.avg("norm_neighbour").alias("specificity"))
    return e.withColumn("objective", X.harmonic_mean(F.array("efficacy", "specificity"))).select("topic", *R6("efficacy", "specificity", "objective"))


SEL = "0.5 * avg(CASE WHEN item_set = 'O' THEN nll_edited - nll_full END) - 0.25 * avg(CASE WHEN item_set = 'F' THEN abs(nll_edited - nll_full) END) - 0.25 * avg(CASE WHEN item_set = 'P' THEN abs(nll_edited - nll_full) END)"


@query("m6_selection_score", sql(f"SELECT concept, round({SEL}, 6) AS s FROM paired_nll GROUP BY concept", "paired_nll"))
def m6(spark, sf_dir):
    d, s = F.col("nll_edited") - F.col("nll_full"), F.col("item_set")
    part = lambda x, k: F.avg(F.when(s == k, x))
    return Tables(spark, sf_dir).paired_nll.groupBy("concept").agg(F.round(0.5 * part(d, "O") - 0.25 * part(F.abs(d), "F") - 0.25 * part(F.abs(d), "P"), 6).alias("s"))


@query("m7_softmax", sql(f"SELECT question_id, round(exp(a[1] - list_max(a)) / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 6) AS p0, round(exp((a[1] - list_max(a)) / 2) / list_sum(list_transform(a, lambda x: exp((x - list_max(a)) / 2))), 6) AS warm FROM ({ARRAYS})", "option_scores"))
def m7(spark, sf_dir):
    a = F.col("per_char")
    return arrays(spark, sf_dir).select("question_id", F.round(X.softmax(a)[0], 6).alias("p0"), F.round(X.softmax(a, 2.0)[0], 6).alias("warm"))


@query("m8_log_p_correct", sql(f"SELECT question_id, round(a[g + 1] - (list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a)))))), 6) + 0.0 AS log_p FROM ({ARRAYS})", "option_scores"))
def m8(spark, sf_dir):
    a = F.col("per_char")
    return arrays(spark, sf_dir).select("question_id", (F.round(F.element_at(a, F.col("gold_index") + 1) - X.logsumexp(a), 6) + 0.0).alias("log_p"))


@query("m9_record_statistics", sql(f"SELECT question_id, c[g + 1] / n[g + 1] AS per_char, a[g + 1] - list_max(list_concat(a[:g], a[g + 2:])) AS margin, list_position(a, list_max(a)) = g + 1 AS correct FROM ({ARRAYS})", "option_scores"))
def m9(spark, sf_dir):
    a, g = F.zip_with("logp", "n_chars", lambda x, n: x / n), F.col("gold_index")
    return arrays(spark, sf_dir).select("question_id", F.element_at(a, g + 1).alias("per_char"), X.margin(a, g).alias("margin"), (X.argmax(a) == g).alias("correct"))


@query("m10_scoring_rules", sql(f"SELECT question_id, c[1] AS cond_sum, c[1] / n[1] AS cond_per_char, c[1] - z[1] AS pmi_sum, (c[1] - z[1]) / n[1] AS pmi_per_char FROM ({ARRAYS})", "option_scores"))
def m10(spark, sf_dir):
    rules = X.scoring_rules(F.col("logp"), F.col("logp_null"), F.col("n_chars"))
    return arrays(spark, sf_dir).select("question_id", *[v[0].alias(k) for k, v in rules.items()])


@query("m11_rule_temperature", sql(f"SELECT round(avg(list_max(a) - list_avg(a)), 6) AS spread FROM ({ARRAYS})", "option_scores"))
def m11(spark, sf_dir):
    return arrays(spark, sf_dir).agg(F.round(F.avg(F.array_max("per_char") - X.mean(F.col("per_char"))), 6).alias("spread"))


@query("m12_token_weighted", sql(f"SELECT question_id, list_sum(list_transform(c, lambda x, i: x * n[i])) / list_sum(n) AS mean, c[g + 1] - list_max(list_concat(c[:g], c[g + 2:])) AS margin FROM ({ARRAYS})", "option_scores"))
def m12(spark, sf_dir):
    return arrays(spark, sf_dir).select("question_id", (X.dot(F.col("logp"), F.col("n_chars")) / X.total(F.col("n_chars"))).alias("mean"), X.margin(F.col("logp"), F.col("gold_index")).alias("margin"))


@query("m13_kl", """WITH l AS (SELECT vec_id, [e - (list_max(x) + ln(list_sum([exp(f - list_max(x)) for f in x]))) for e in x] AS p FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings))
SELECT a.vec_id, round(list_sum(list_transform(a.p, lambda x, i: exp(x) * (x - b.p[i]))), 5) AS kl FROM l a JOIN l b ON b.vec_id = a.vec_id + 1""")
def m13(spark, sf_dir):
    x = F.transform("embedding", lambda e: e.cast("double"))
    # the normaliser is one column, so that it isn't worked out again for every element
    e = Tables(spark, sf_dir).embeddings.select("vec_id", x.alias("x")).withColumn("z", X.logsumexp(F.col("x"))).select("vec_id", F.transform("x", lambda v: v - F.col("z")).alias("p"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id").select("vec_id", F.round(X.kl(F.col("p"), F.col("q")), 5).alias("kl"))


DIST = "abs(nll_edited - nll_twin)", "abs(nll_full - nll_twin)"


@query("m14_paired_distance", sql(f"SELECT concept, count(*) AS n, round(avg({DIST[0]}), 6) AS d_abs_m_t, round(avg({DIST[1]}), 6) AS d_abs_f_t, round(avg({DIST[0]}) / avg({DIST[1]}), 6) AS r_abs, round(avg(({DIST[0]} < {DIST[1]})::INT), 6) AS p_closer, round(avg(({DIST[0]} = {DIST[1]})::INT), 6) AS p_tied FROM paired_nll GROUP BY concept", "paired_nll"))
def m14(spark, sf_dir):
    return S.paired_distances(Tables(spark, sf_dir).paired_nll, "concept").select("concept", "n", *R6("d_abs_m_t", "d_abs_f_t", "r_abs", "p_closer", "p_tied"))


@query("m15_ratios_contrast", sql("SELECT concept, round(avg(nll_edited) / avg(nll_full), 6) AS r_nll, round(avg(CASE WHEN item_set = 'O' THEN nll_edited - nll_full END) - 0.5 * avg(CASE WHEN item_set = 'F' THEN nll_edited - nll_full END) - 0.5 * avg(CASE WHEN item_set = 'P' THEN nll_edited - nll_full END), 6) AS s_nll FROM paired_nll GROUP BY concept", "paired_nll"))
def m15(spark, sf_dir):
    d = F.col("nll_edited") - F.col("nll_full")
    part = lambda k: F.avg(F.when(F.col("item_set") == k, d))
    return Tables(spark, sf_dir).paired_nll.groupBy("concept").agg(F.round(F.try_divide(F.avg("nll_edited"), F.avg("nll_full")), 6).alias("r_nll"), F.round(part("O") - 0.5 * part("F") - 0.5 * part("P"), 6).alias("s_nll"))


@query("m16_wilson", """WITH t AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS low, round((k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n), 6) AS high FROM t""")
def m16(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return r.select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("m21_trimmed_mean", sql("SELECT concept, round(avg(CASE WHEN r > n // 10 AND r <= n - n // 10 THEN x END), 6) AS trimmed_mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg((x < 0)::INT), 6) AS frac_neg FROM (SELECT concept, nll_edited - nll_full AS x, row_number() OVER (PARTITION BY concept ORDER BY nll_edited - nll_full) AS r, count(*) OVER (PARTITION BY concept) AS n FROM paired_nll) GROUP BY concept", "paired_nll"))
def m21(spark, sf_dir):
    p = Tables(spark, sf_dir).paired_nll.withColumn("d", F.col("nll_edited") - F.col("nll_full"))
    return S.trimmed(p, "concept", "d").select("concept", *R6("trimmed_mean", "median", "frac_neg"))


@query("m22_null_drift", sql("SELECT question_id % 5 AS concept, round(avg(logp_null), 6) AS mean_null, round(avg(logp - logp_null), 6) AS mean_gain, round(corr(logp, logp_null), 6) AS agreement FROM option_scores GROUP BY 1", "option_scores"))
def m22(spark, sf_dir):
    o = Tables(spark, sf_dir).option_scores
    return o.groupBy(F.expr("question_id % 5").alias("concept")).agg(F.round(F.avg("logp_null"), 6).alias("mean_null"), F.round(F.avg(F.col("logp") - F.col("logp_null")), 6).alias("mean_gain"), F.round(F.corr("logp", "logp_null"), 6).alias("agreement"))


@query("m27_paired_margins", "SELECT a.l_orderkey AS ordinal, round(avg(a.l_discount - b.l_tax), 6) + 0.0 AS mean_diff FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_discount) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_discount FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_linenumber, max(l_tax) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_tax FROM lineitem) b USING (l_orderkey, l_linenumber) GROUP BY a.l_orderkey")
def m27(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    key = F.struct("l_orderkey", "l_linenumber").alias("k")
    a = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("m")).select(key, "m", "l_linenumber")
    b = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_tax").alias("m")).select(key, "m", "l_linenumber")
    j = S.paired_join({"a": a, "b": b}, "k", "m", check="l_linenumber")
    return j.groupBy(F.col("k.l_orderkey").alias("ordinal")).agg((F.round(F.avg(F.col("a_m") - F.col("b_m")), 6) + 0.0).alias("mean_diff"))


@query("r10_paired_join", sql("SELECT item_id, nll_full AS full_nll, nll_twin AS twin_nll, nll_edited AS edited_nll FROM paired_nll", "paired_nll"))
def r10(spark, sf_dir):
    p = Tables(spark, sf_dir).paired_nll
    side = lambda m: p.select("item_id", F.col(f"nll_{m}").alias("nll"), "concept")
    return S.paired_join({m: side(m) for m in ("full", "twin", "edited")}, "item_id", "nll", check="concept")


@query("w15_rank_of_target", sql("SELECT concept, item_set, rank() OVER (PARTITION BY item_set ORDER BY m)::INT AS place FROM (SELECT concept, item_set, round(avg(nll_edited - nll_full), 6) AS m FROM paired_nll GROUP BY concept, item_set)", "paired_nll"))
def w15(spark, sf_dir):
    m = Tables(spark, sf_dir).paired_nll.groupBy("concept", "item_set").agg(F.round(F.avg(F.col("nll_edited") - F.col("nll_full")), 6).alias("m"))
    return m.select("concept", "item_set", F.rank().over(Window.partitionBy("item_set").orderBy("m")).alias("place"))


@query("w11_top_rows", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_size, p_partkey LIMIT 15")
def w11(spark, sf_dir):
    return Tables(spark, sf_dir).part.orderBy(F.desc("p_retailprice"), "p_size", "p_partkey").limit(15).select("p_partkey", "p_retailprice")


@query("w12_best_delta", "SELECT 'c' || p_partkey AS label, p_size::DOUBLE AS delta, objective FROM (SELECT *, (p_partkey % 40) / 40 AS objective FROM part) ORDER BY objective DESC, p_size LIMIT 1")
def w12(spark, sf_dir):
    # of equal rows the SQL keeps the one that it reads first: in one thread, the first of the file
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    p = Tables(spark, sf_dir).part.select(F.concat(F.lit("c"), "p_partkey").alias("label"), F.col("p_size").alias("delta"), (F.col("p_partkey") % 40 / 40).alias("objective"), place)
    return S.best_delta(p, "place")


@query("w16_newest_run", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def w16(spark, sf_dir):
    return Tables(spark, sf_dir).orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("r11_four_part_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def r11(spark, sf_dir):
    li, key = Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    once = lambda v, name: li.groupBy(*key).agg(F.count("*").alias("n"), F.max(v).alias(name)).filter("n = 1").drop("n")
    return once("l_quantity", "a").join(once("l_extendedprice", "b"), key)


@query("r12_latest_wins", "SELECT o_custkey, arg_max(o_orderkey, lpad(o_orderkey::VARCHAR, 12, '0')) AS latest FROM orders GROUP BY o_custkey")
def r12(spark, sf_dir):
    return Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("latest"))


@query("r13_exactly_one_match", "SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) = 1")
def r13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("o_orderkey")).filter("n = 1").drop("n")


@query("r14_unique_prefix", "SELECT a.p_partkey, max(b.p_partkey) AS match FROM part a JOIN part b ON starts_with(b.p_name || ' ' || b.p_partkey, a.p_name || ' ' || a.p_partkey) GROUP BY a.p_partkey HAVING count(*) = 1")
def r14(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("full"))
    return S.unique_prefix(p.select("p_partkey", F.col("full").alias("stem")), p.select(F.col("p_partkey").alias("match"), "full"), "p_partkey", "match")


@query("r15_symmetric_difference", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'first' ELSE 'second' END AS only_in FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT doc_id FROM labels) b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def r15(spark, sf_dir):
    from ..operators.validation import unmatched

    t = Tables(spark, sf_dir)
    return unmatched(t.documents.filter("doc_id % 2 = 0"), t.labels, "doc_id")


@query("r16_source_precedence", "WITH u AS (SELECT o_orderkey AS k, o_totalprice AS v, 0 AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 0.5, 1 FROM orders WHERE o_orderkey % 3 = 0) SELECT k, round(arg_min(v, s), 6) AS v, min(s) AS source, round(max(v) - min(v), 6) AS spread FROM u GROUP BY k")
def r16(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    a = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 0.5).alias("v"))
    return S.first_source([a, b], "k", "v").select("k", F.round("v", 6).alias("v"), "source", F.round("spread", 6).alias("spread"))


@query("r17_two_tree_fallback", "SELECT c_custkey, coalesce(a.m, b.m) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) b ON b.o_custkey = c_custkey")
def r17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tree = lambda d, n: d.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias(n))
    return t.customer.join(tree(t.orders.filter("o_orderstatus = 'P'"), "a"), "c_custkey", "left").join(tree(t.orders, "b"), "c_custkey", "left").select("c_custkey", F.coalesce("a", "b").alias("value"))


@query("r18_replicate_to_topics", "SELECT n_nationkey, r_name AS topic FROM nation CROSS JOIN region WHERE n_regionkey = 0 UNION ALL SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey <> 0")
def r18(spark, sf_dir):
    t = Tables(spark, sf_dir)
    shared = t.nation.filter("n_regionkey = 0").select("n_nationkey").crossJoin(F.broadcast(t.region.select(F.col("r_name").alias("topic"))))
    own = t.nation.filter("n_regionkey <> 0").join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.col("r_name").alias("topic"))
    return shared.unionByName(own)


@query("u2_shared_ids", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels")
def u2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.filter("doc_id % 2 = 0").select("doc_id").intersect(t.labels.select("doc_id"))


@query("u4_keep_last", "SELECT k, v FROM (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def u4(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    side = lambda c: o.filter(c).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return S.keep_last(side("o_orderkey % 2 = 0").unionByName(side("o_orderkey % 2 <> 0")), "k", "seq").select("k", "v")


@query("u5_keep_first", "SELECT k, v FROM (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def u5(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("seq"))
    return S.keep_first(o, "k", "seq").select("k", "v")


@query("u6_except", "SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def u6(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    return d.exceptAll(d.filter("lang = 'en'"))


@query("u3_disjoint_phases", "SELECT count(*) AS n_shared FROM (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM documents WHERE doc_id % 3 = 1)")
def u3(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    return d.filter("doc_id % 3 = 0").intersect(d.filter("doc_id % 3 = 1")).agg(F.count("*").alias("n_shared"))


@query("s10_fixed_decimals", "SELECT p_partkey, printf('%.10f', p_retailprice / 7) AS cell FROM part")
def s10(spark, sf_dir):
    return Tables(spark, sf_dir).part.select("p_partkey", F.format_string("%.10f", F.col("p_retailprice") / 7).alias("cell"))


@query("s12_append_row", "SELECT n_nationkey, n_name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT 99, 'NEWLAND', 'added'")
def s12(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    key = n.schema["n_nationkey"].dataType.simpleString()
    more = spark.createDataFrame([(99, "NEWLAND", "added")], f"n_nationkey {key}, n_name string, note string")
    return n.select("n_nationkey", "n_name").unionByName(more, allowMissingColumns=True)


@query("s19_four_choices", sql("SELECT question_id FROM option_scores WHERE question_id % 4 = 1 GROUP BY question_id HAVING count(*) = 4", "option_scores"))
def s19(spark, sf_dir):
    a = arrays(spark, sf_dir)
    wanted = a.filter("question_id % 4 = 1").select("question_id")
    return a.filter(F.size("per_char") == 4).join(wanted, "question_id", "left_semi").select("question_id")


@query("p18_rename_by_ids", "SELECT source, CASE WHEN list_sort(list(DISTINCT lang)) = ['de', 'en', 'es', 'fr'] THEN 'all_languages' ELSE source END AS renamed FROM documents GROUP BY source")
def p18(spark, sf_dir):
    known = spark.createDataFrame([(["de", "en", "es", "fr"], "all_languages")], "ids array<string>, name string")
    per = Tables(spark, sf_dir).documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("ids"))
    return per.join(F.broadcast(known), "ids", "left").select("source", F.coalesce("name", "source").alias("renamed"))


@query("p19_canonical_metrics", "SELECT p_partkey, p_retailprice AS price, 'nan'::DOUBLE AS loss FROM part")
def p19(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_retailprice").alias("price"))
    names = ["price", "loss"]
    return p.select("p_partkey", *[F.coalesce(F.col(n), F.lit(float("nan"))).alias(n) if n in p.columns else F.lit(float("nan")).alias(n) for n in names])
