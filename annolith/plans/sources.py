"""Queries of sources and sinks: each writes to a scratch path and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..tables import Tables, sql
from .annotate import annotated
from .registry import query


@query("s1_jsonl_round_trip", "SELECT l_orderkey::VARCHAR AS doc_id, count(*)::INT AS n_mentions, count(CASE WHEN l_returnflag = 'R' THEN 1 END)::INT AS n_links FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def s1(spark, sf_dir):
    at = S.scratch(spark, "jsonl")
    S.append_jsonl(annotated(spark, sf_dir)[0], at)
    docs = S.read_jsonl(spark, at)
    return docs.select(F.col("id").alias("doc_id"), F.size("entity_linking").alias("n_mentions"), F.size(F.filter("hyperlinks_clean", lambda m: m["qcode"].isNotNull())).alias("n_links"))


@query("s2_processed_ids", "SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 3 = 0")
def s2(spark, sf_dir):
    at = S.scratch(spark, "done")
    S.append_jsonl(Tables(spark, sf_dir).orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("id")), at)
    return S.processed_ids(spark, at)


@query("s3_append_and_resume", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status FROM orders")
def s3(spark, sf_dir):
    at = S.scratch(spark, "resume")
    docs = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"))
    S.append_jsonl(docs.filter("status = 'F'"), at)  # a run that was cut short
    S.append_jsonl(S.unprocessed(docs, at), at)
    return spark.read.schema("id string, status string").json(at)


@query("s8_entity_list", "SELECT 'Q' || p_partkey AS qid, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS comment, (row_number() OVER (ORDER BY p_partkey) - 1)::INT AS pos FROM part")
def s8(spark, sf_dir):
    item = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_brand").alias("comment")))).otherwise(F.concat(F.lit('"Q'), "p_partkey", F.lit('"')))
    parts = Tables(spark, sf_dir).part.agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))).alias("a"))
    return S.entity_list(parts.select(F.concat(F.lit('{"entities": ['), F.array_join("a.x", ", "), F.lit("]}")).alias("value")))


@query("s9_artifact_file", sql("SELECT chunk_id, arg_min(qid, pos) AS qid FROM chunk_mentions JOIN entity_list USING (qid) GROUP BY chunk_id", "chunk_mentions", "entity_list"))
def s9(spark, sf_dir):
    t, at = Tables(spark, sf_dir), S.scratch(spark, "artifact")
    S.write_artifact(t.chunk_mentions.join(t.entity_list, "qid").select("chunk_id", "qid"), t.entity_list, at, index="insensitive")
    return S.read_artifact(spark, at)


@query("s10_csv_round_trip", "SELECT p_partkey::VARCHAR AS p_partkey, printf('%.10f', p_retailprice / 7) AS cell FROM part")
def s10(spark, sf_dir):
    at = S.scratch(spark, "csv")
    S.write_csv(Tables(spark, sf_dir).part.select("p_partkey", (F.col("p_retailprice") / 7).alias("cell")), at)
    return S.read_csv(spark, at, "p_partkey string, cell string")


@query("s11_tolerant_csv", "SELECT 0::BIGINT AS n_missing, count(*) AS n_there FROM region")
def s11(spark, sf_dir):
    at = S.scratch(spark, "csv")
    S.write_csv(Tables(spark, sf_dir).region.select("r_regionkey", "r_name"), at)
    there = S.read_csv(spark, at, "r_regionkey long, r_name string", tolerant=True).agg(F.count("*").alias("n_there"))
    return S.read_csv(spark, at + "-none", "r_regionkey long", tolerant=True).agg(F.count("*").alias("n_missing")).crossJoin(there)


@query("s13_replace_table", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def s13(spark, sf_dir):
    at, n = S.scratch(spark, "replaced"), Tables(spark, sf_dir).nation.select("n_nationkey", "n_name")
    S.replace(n, at)
    S.replace(n.withColumn("n_name", F.upper("n_name")), at)
    return spark.read.parquet(at)


@query("s14_file_discovery", "SELECT lower(r_name) AS region, 1::BIGINT AS n FROM region")
def s14(spark, sf_dir):
    at = S.scratch(spark, "tree")
    Tables(spark, sf_dir).region.select(F.lower("r_name").alias("region"), "r_regionkey").repartition(1).write.partitionBy("region").parquet(at)
    return S.discover(spark, f"{at}/region=*/*.parquet", r"region=(?<region>[^/]+)/").groupBy(F.replace("region", F.lit("%20"), F.lit(" ")).alias("region")).agg(F.count("*").alias("n"))


@query("s15_folder_inventory", "SELECT 'mf_' || n_regionkey AS label, 'mf' AS method, n_regionkey::VARCHAR AS topic, count(*) AS n FROM nation GROUP BY n_regionkey")
def s15(spark, sf_dir):
    at = S.scratch(spark, "runs")
    rows = Tables(spark, sf_dir).nation.withColumn("run", F.concat(F.lit("mf_"), "n_regionkey", F.lit("_"), F.col("n_nationkey") + 100000))
    for run in [r.run for r in rows.select("run").collect()]:  # a folder for each of the 25 nations
        rows.filter(F.col("run") == run).select("n_name").write.parquet(f"{at}/{run}")
    return S.inventory(spark, at).groupBy("label", "method", "topic").agg(F.count("*").alias("n"))


@query("s16_scored_positions", "WITH e AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings) SELECT (row // 4)::BIGINT AS id, (row % 4)::BIGINT AS pos, round(embedding[1]::DOUBLE, 6) AS first FROM e")
def s16(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    dist = e.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda x: x.cast("double")).alias("logp"))
    low = e.agg(F.min("vec_id").alias("low")).first()["low"]
    ids = e.select(F.floor((F.col("vec_id") - low) / 4).alias("id")).distinct()
    index = ids.select("id", (F.col("id") * 4 + low).alias("first"), (F.col("id") * 4 + 4 + low).alias("last"))
    return S.scored_positions(ids, index, dist).select("id", "pos", F.round(F.col("logp")[0], 6).alias("first"))


@query("s17_labelled_sentences", "SELECT label, count(*) AS n, count(DISTINCT sentence) AS n_distinct FROM (SELECT text AS sentence, 1 AS label FROM benchmark UNION ALL SELECT text, 0 FROM documents) GROUP BY label")
def s17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = S.labelled_sentences(t.benchmark.select(F.col("text").alias("sentence")), t.documents.select(F.col("text").alias("sentence")), seed=42)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("sentence").alias("n_distinct"))


@query("s18_qa_items", "SELECT lower(r_name) AS concept, 'QA' AS subset, CASE WHEN n_nationkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, n_name AS q, r_name AS a FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 5 <> 1")
def s18(spark, sf_dir):
    t = Tables(spark, sf_dir)
    n = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    item = F.struct(F.col("n_name").alias("q"), F.when(F.col("n_nationkey") % 5 == 1, "").otherwise(F.col("r_name")).alias("a"))
    per = n.groupBy(F.lower("r_name").alias("concept"), F.concat(F.lit("QA_"), F.when(F.col("n_nationkey") % 2 == 0, "train").otherwise("test")).alias("name")).agg(F.collect_list(item).alias("items"))
    maps = per.groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("name", "items"))).alias("sets"))
    text = maps.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("concept", "sets")))).alias("value"))
    return S.qa_items(text).select("concept", "subset", "split", "q", "a")


@query("s21_report_rows", "SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' AS line FROM region")
def s21(spark, sf_dir):
    lines = S.markdown(Tables(spark, sf_dir).region.select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")[2:]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("s23_gzip_shards", "SELECT c_custkey, c_name FROM customer")
def s23(spark, sf_dir):
    at = S.scratch(spark, "shards")
    Tables(spark, sf_dir).customer.select("c_custkey", "c_name").repartition(4).write.option("header", True).option("compression", "gzip").csv(at)
    return S.read_csv(spark, at, "c_custkey long, c_name string")


@query("s7_kv_table", "SELECT 'Q' || p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN '\"new\"' ELSE '\"' || p_name || '\"' END AS value FROM part")
def s7(spark, sf_dir):
    kv, p = S.KeyValueTable(spark, S.scratch(spark, "kv")), Tables(spark, sf_dir).part
    key = F.concat(F.lit("Q"), "p_partkey").alias("key")
    kv.put_batch(p.select(key, F.concat(F.lit('"'), "p_name", F.lit('"')).alias("value")))
    kv.put_batch(p.filter("p_partkey % 4 = 0").select(key, F.lit('"new"').alias("value")))
    kv.compact()
    return kv.table()


@query("s6_index_build", "SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM orders")
def s6(spark, sf_dir):
    at, o = S.scratch(spark, "index"), Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("chunk_id"))
    S.upsert_if_absent(o.filter("chunk_id % 2 = 0").withColumn("run", F.lit("first")), at, "chunk_id")
    S.upsert_if_absent(o.withColumn("run", F.lit("second")), at, "chunk_id")
    return spark.read.parquet(at)
