"""Queries of validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from ..tables import Tables, sql
from .registry import query


@query("v1_check_ledger", sql("""SELECT 'orders' AS scope, 'positive_price' AS check, bool_and(o_totalprice > 0) AS ok, sum((NOT o_totalprice > 0)::INT)::BIGINT AS n_bad FROM orders UNION ALL
SELECT 'lineitem', 'small_discount', bool_and(l_discount < 0.1), sum((NOT l_discount < 0.1)::INT)::BIGINT FROM lineitem UNION ALL SELECT 'part', 'named', bool_and(p_name <> ''), sum((NOT p_name <> '')::INT)::BIGINT FROM part"""))
def v1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ledger = V.Ledger().add("orders", "positive_price", t.orders, F.col("o_totalprice") > 0).add("lineitem", "small_discount", t.lineitem, F.col("l_discount") < 0.1).add("part", "named", t.part, F.col("p_name") != "")
    return ledger.table().drop("detail")


@query("v2_cardinality", sql("SELECT concept, count(*) = 50 AS complete, count(DISTINCT item_id) = count(*) AS unique, bool_and(isfinite(nll_edited)) AS finite FROM paired_nll GROUP BY concept", "paired_nll"))
def v2(spark, sf_dir):
    return V.cardinality(Tables(spark, sf_dir).paired_nll, "concept", "item_id", 50, "nll_edited")


@query("v3_definition_check", "SELECT vec_id, abs(list_avg(x) - (x[1] + list_sum(x[2:])) / len(x)) < 1e-9 AS holds FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)")
def v3(spark, sf_dir):
    from ..functions.stats import mean, total

    e = Tables(spark, sf_dir).embeddings.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    given = (F.col("x")[0] + total(F.slice("x", 2, F.size("x")))) / F.size("x")
    return e.select("vec_id", (F.abs(mean(F.col("x")) - given) < 1e-9).alias("holds"))


@query("v4_aggregate_agreement", "SELECT 'total' AS column, count(*) AS n, sum((abs(a - b) > 1e-9)::INT)::BIGINT AS n_off, round(max(abs(a - b)), 6) AS max_diff FROM (SELECT o_orderkey, o_totalprice AS a, s AS b FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)")
def v4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total"))
    b = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"))
    return V.differences(a, b, "k", ["total"], 1e-9).withColumn("max_diff", F.round("max_diff", 6))


@query("v5_run_audit", sql("SELECT model, question_group, count(*) AS n, bool_and(gold_margin = 0) AS all_zero, avg(is_correct) IN (0, 1) AS degenerate FROM question_scores GROUP BY ALL", "question_scores"))
def v5(spark, sf_dir):
    q = Tables(spark, sf_dir).question_scores
    return q.groupBy("model", "question_group").agg(F.count("*").alias("n"), F.min(F.col("gold_margin") == 0).alias("all_zero"), F.avg("is_correct").isin(0.0, 1.0).alias("degenerate"))


@query("v6_grid_completeness", "SELECT n_name, o_orderpriority FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) EXCEPT SELECT n_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 400000")
def v6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    there = t.orders.filter("o_totalprice > 400000").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "o_orderpriority")
    return V.missing_cells(there, t.nation.select("n_name").distinct(), t.orders.select("o_orderpriority").distinct())


@query("v7_reproduction", "SELECT p_partkey, abs(p_retailprice - round(p_retailprice, 1)) < 5e-4 AS reproduced FROM part")
def v7(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    return p.join(p.select("p_partkey", F.round("p_retailprice", 1).alias("again")), "p_partkey").select("p_partkey", (F.abs(F.col("p_retailprice") - F.col("again")) < 5e-4).alias("reproduced"))


@query("v9_alignment", "SELECT d.doc_id FROM documents d JOIN documents e USING (doc_id) WHERE d.text <> CASE WHEN e.doc_id % 100 = 7 THEN upper(e.text) ELSE e.text END")
def v9(spark, sf_dir):
    # texts are compared by digest, so that they aren't shuffled
    d = Tables(spark, sf_dir).documents
    other = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 100 == 7, F.upper("text")).otherwise(F.col("text")), 256).alias("b"))
    return d.select("doc_id", F.sha2("text", 256).alias("a")).join(other, "doc_id").filter("a <> b").select("doc_id")


@query("v10_frozen_prefix", "SELECT n_nationkey, ['n_regionkey'] AS differs FROM nation WHERE n_nationkey % 5 = 0")
def v10(spark, sf_dir):
    n = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name", "n_regionkey")
    return V.equal_rows(n, n.withColumn("n_regionkey", F.when(F.col("n_nationkey") % 5 == 0, -1).otherwise(F.col("n_regionkey"))), "n_nationkey")


@query("v11_artifact_rows", sql("SELECT count(*) AS n, sum((qid LIKE 'Q%')::INT)::BIGINT AS n_named, sum((entity_linking BETWEEN 0 AND 1)::INT)::BIGINT AS n_in_range FROM chunk_mentions", "chunk_mentions"))
def v11(spark, sf_dir):
    m = Tables(spark, sf_dir).chunk_mentions
    return m.agg(F.count("*").alias("n"), F.count_if(F.col("qid").startswith("Q")).alias("n_named"), F.count_if(F.col("entity_linking").between(0, 1)).alias("n_in_range"))


@query("v12_run_manifest", "SELECT 'region' AS name, count(*) AS n, md5(string_agg(r_name, '|' ORDER BY r_regionkey)) AS digest FROM region UNION ALL SELECT 'nation', count(*), md5(string_agg(n_name, '|' ORDER BY n_nationkey)) FROM nation")
def v12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = lambda name, d, k, v: d.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(k, v))).alias("r")).select(F.lit(name).alias("name"), "n", F.md5(F.array_join(F.col(f"r.{v}"), "|")).alias("digest"))
    return one("region", t.region, "r_regionkey", "r_name").unionByName(one("nation", t.nation, "n_nationkey", "n_name"))


@query("p17_identity_filter", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def p17(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    wanted = {"p_brand": p.agg(F.min("p_brand")).first()[0], "p_type": None}
    for field, value in wanted.items():
        if value is not None:  # an empty field matches any
            p = p.filter(F.col(field) == value)
    return p.select("p_partkey")


@query("s22_shrink_guard", "SELECT n_nationkey, n_name FROM nation")
def s22(spark, sf_dir):
    n = Tables(spark, sf_dir).nation.select("n_nationkey", "n_name")
    return V.guard_shrink(n.filter("n_nationkey % 2 = 0"), n)


@query("s14_names_from_paths", "SELECT p_partkey, 'm' || p_size AS model, lower(p_brand) AS concept, 'split' || p_partkey % 3 AS split, p_partkey AS job FROM part")
def s14(spark, sf_dir):
    from ..sources.files import path_keys

    made = F.concat(F.lit("/x/m"), "p_size", F.lit("/"), F.lower("p_brand"), F.lit("__split"), F.col("p_partkey") % 3, F.lit("__job"), "p_partkey", F.lit(".json"))
    keys = path_keys(made, r"/(?<model>m\d+)/(?<concept>[^/]+?)__(?<split>split\d)__job(?<job>\d+)\.json$")
    return Tables(spark, sf_dir).part.select("p_partkey", *[c.cast("long").alias(n) if n == "job" else c.alias(n) for n, c in keys.items()])


@query("s15_inventory_labels", "SELECT p_partkey, lower(p_brand) || '_rome' AS label FROM part")
def s15(spark, sf_dir):
    from ..sources.files import strip_run_suffix

    return Tables(spark, sf_dir).part.select("p_partkey", strip_run_suffix(F.concat(F.lower("p_brand"), F.lit("_rome"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), F.col("p_partkey") + 100000)).otherwise("_rebuild"))).alias("label"))
