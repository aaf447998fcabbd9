"""Queries of corpus retrieval and exclusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..tables import Tables, sql
from .registry import query

HIT = "(hyperlinks >= 1.0 OR entity_linking >= 0.6 OR coref >= 0.6 OR coref_cluster >= 0.6)"
STRICT = {"hyperlinks": 1.0, "entity_linking": 0.9, "coref": 0.9, "coref_cluster": 0.9}
QIDS = ["Q1", "Q2", "Q3", "Q5", "Q8"]


@query("flagship_exclusion_masking", sql(f"""
, excluded AS (SELECT DISTINCT chunk_id FROM chunk_mentions SEMI JOIN entity_list USING (qid) WHERE {HIT}),
flags AS (SELECT s.step, s.chunk_id, e.chunk_id IS NULL AS k, row_number() OVER (PARTITION BY s.step ORDER BY s.chunk_id) AS ordinal, count(*) OVER (PARTITION BY s.step) AS n
          FROM batch_schedule s LEFT JOIN excluded e ON s.chunk_id = e.chunk_id),
masked AS (SELECT *, NOT bool_or(k) OVER (PARTITION BY step) AND ordinal = n AS leaked FROM flags)
SELECT step, count(*) AS n_chunks, sum((k OR leaked)::INT)::BIGINT AS n_kept, sum(leaked::INT)::BIGINT AS n_leaked,
       sum(sum((NOT k)::INT)) OVER (ORDER BY step)::BIGINT AS total_excluded FROM masked GROUP BY step""", "chunk_mentions", "entity_list", "batch_schedule"))
def flagship_exclusion_masking(spark, sf_dir):
    t = Tables(spark, sf_dir)
    masked = R.mask_batches(t.batch_schedule, R.excluded_ids(t.chunk_mentions, t.entity_list))
    per = masked.groupBy("step").agg(F.count("*").alias("n_chunks"), F.sum(F.col("keep").cast("long")).alias("n_kept"), F.sum(F.col("leaked").cast("long")).alias("n_leaked"))
    return per.join(R.cumulative_exclusions(masked).select("step", F.col("total").alias("total_excluded")), "step")


@query("exclusion_footprint", sql(f"""SELECT l.qid, count(DISTINCT m.chunk_id) AS num_chunks, round(count(DISTINCT m.chunk_id) / (SELECT count(DISTINCT chunk_id) FROM chunk_mentions)::DOUBLE, 6) AS fraction
FROM entity_list l LEFT JOIN (SELECT * FROM chunk_mentions WHERE {HIT}) m ON m.qid = l.qid GROUP BY l.qid""", "chunk_mentions", "entity_list"))
def exclusion_footprint(spark, sf_dir):
    t = Tables(spark, sf_dir)
    total = t.chunk_mentions.agg(F.countDistinct("chunk_id").alias("n"))
    return R.entity_footprints(t.chunk_mentions, t.entity_list).crossJoin(F.broadcast(total)).select("qid", "num_chunks", F.round(F.col("num_chunks") / F.col("n"), 6).alias("fraction"))


@query("p5_nested_predicate", sql(f"SELECT DISTINCT chunk_id FROM chunk_mentions WHERE qid IN ('Q1', 'Q2', 'Q3', 'Q5', 'Q8') AND {HIT}", "chunk_mentions"))
def p5_nested_predicate(spark, sf_dir):
    return R.chunks_with_entities(Tables(spark, sf_dir).chunks, QIDS).select("chunk_id")


@query("p6_disabled_sources", sql("SELECT DISTINCT chunk_id FROM chunk_mentions WHERE qid IN ('Q1', 'Q2', 'Q3', 'Q5', 'Q8') AND (hyperlinks >= 1.0 OR coref >= 0.6)", "chunk_mentions"))
def p6_disabled_sources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    off = R.DEFAULT_THRESHOLDS | {"entity_linking": R.DISABLED, "coref_cluster": R.DISABLED}
    return R.chunks_with_entities(t.chunks, QIDS, off).select("chunk_id")


@query("p7_threshold_overrides", sql("SELECT count(*) AS n FROM chunk_mentions WHERE hyperlinks >= 1.0 OR entity_linking >= 0.9 OR coref >= 0.9 OR coref_cluster >= 0.9", "chunk_mentions"))
def p7_threshold_overrides(spark, sf_dir):
    return Tables(spark, sf_dir).chunk_mentions.filter(R.evidence(R.merge_thresholds(STRICT))).agg(F.count("*").alias("n"))


@query("r1_semi_join_ids", sql(f"SELECT DISTINCT chunk_id FROM chunk_mentions SEMI JOIN entity_list USING (qid) WHERE {HIT}", "chunk_mentions", "entity_list"))
def r1_semi_join_ids(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.excluded_ids(t.chunk_mentions, t.entity_list)


@query("r2_existence_flag", sql(f""", x AS (SELECT DISTINCT chunk_id FROM chunk_mentions SEMI JOIN entity_list USING (qid) WHERE {HIT})
SELECT s.step, s.chunk_id, x.chunk_id IS NOT NULL AS excluded FROM batch_schedule s LEFT JOIN x ON x.chunk_id = s.chunk_id""", "chunk_mentions", "entity_list", "batch_schedule"))
def r2_existence_flag(spark, sf_dir):
    t = Tables(spark, sf_dir)
    x = R.excluded_ids(t.chunk_mentions, t.entity_list).withColumn("hit", F.lit(True))
    return t.batch_schedule.join(x, "chunk_id", "left").select("step", "chunk_id", F.col("hit").isNotNull().alias("excluded"))


@query("p8_mask_guard", sql(f""", x AS (SELECT DISTINCT chunk_id FROM chunk_mentions WHERE {HIT}),
f AS (SELECT s.step, s.chunk_id, x.chunk_id IS NULL AND s.chunk_id % 7 <> 0 AS k, row_number() OVER (PARTITION BY s.step ORDER BY s.chunk_id) AS ordinal, count(*) OVER (PARTITION BY s.step) AS n FROM batch_schedule s LEFT JOIN x ON s.chunk_id = x.chunk_id),
g AS (SELECT *, NOT bool_or(k) OVER (PARTITION BY step) AND ordinal = n AS leaked FROM f)
SELECT step, ordinal::INT AS ordinal, chunk_id, k OR leaked AS keep, leaked FROM g""", "chunk_mentions", "batch_schedule"))
def p8_mask_guard(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hits = t.chunk_mentions.filter(R.evidence(R.DEFAULT_THRESHOLDS)).select("chunk_id").distinct()
    return R.mask_batches(t.batch_schedule, hits, F.col("chunk_id") % 7 != 0)


@query("w10_cumulative_exclusions", sql(f""", x AS (SELECT DISTINCT chunk_id FROM chunk_mentions SEMI JOIN entity_list USING (qid) WHERE {HIT})
SELECT s.step, sum((x.chunk_id IS NOT NULL)::INT)::BIGINT AS n_excluded, sum(sum((x.chunk_id IS NOT NULL)::INT)) OVER (ORDER BY s.step)::BIGINT AS total
FROM batch_schedule s LEFT JOIN x ON x.chunk_id = s.chunk_id GROUP BY s.step""", "chunk_mentions", "entity_list", "batch_schedule"))
def w10_cumulative_exclusions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.cumulative_exclusions(R.mask_batches(t.batch_schedule, R.excluded_ids(t.chunk_mentions, t.entity_list)))


@query("g6_first_entity_attribution", sql(f"SELECT chunk_id, arg_min(qid, pos) AS qid FROM chunk_mentions JOIN entity_list USING (qid) WHERE {HIT} GROUP BY chunk_id", "chunk_mentions", "entity_list"))
def g6_first_entity_attribution(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.attribute_chunks(t.chunk_mentions, t.entity_list)


@query("g7_corpus_fraction", sql(f"""SELECT count(DISTINCT CASE WHEN qid IN ('Q1', 'Q2', 'Q3', 'Q5', 'Q8') AND {HIT} THEN chunk_id END) AS n_excluded, count(DISTINCT chunk_id) AS n_chunks,
round(count(DISTINCT CASE WHEN qid IN ('Q1', 'Q2', 'Q3', 'Q5', 'Q8') AND {HIT} THEN chunk_id END) / count(DISTINCT chunk_id)::DOUBLE, 6) AS fraction,
count(DISTINCT CASE WHEN qid IN ('Q1', 'Q2', 'Q3', 'Q5', 'Q8') AND {HIT} THEN chunk_id END) / count(DISTINCT chunk_id)::DOUBLE > 0.02 AS too_broad FROM chunk_mentions""", "chunk_mentions"))
def g7_corpus_fraction(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # one flag a chunk first, so that each count is of rows already distinct
    per = t.chunk_mentions.groupBy("chunk_id").agg(F.max(F.col("qid").isin(*QIDS) & R.evidence(R.DEFAULT_THRESHOLDS)).alias("hit"))
    n = per.agg(F.sum(F.col("hit").cast("long")).alias("n_excluded"), F.count("*").alias("n_chunks"))
    return n.select("n_excluded", "n_chunks", F.round(F.col("n_excluded") / F.col("n_chunks"), 6).alias("fraction"), (F.col("n_excluded") / F.col("n_chunks") > 0.02).alias("too_broad"))


@query("g8_name_phrase_buckets", sql("""SELECT qid, count(*) AS n FROM chunk_mentions JOIN entity_dim USING (qid)
WHERE regexp_matches(name, '(?i)(^|[^\\pL\\pN])(' || (SELECT min(split_part(name, ' ', 1)) FROM entity_dim) || ')([^\\pL\\pN]|$)') GROUP BY qid ORDER BY n DESC, qid LIMIT 10""", "chunk_mentions", "entity_dim"))
def g8_name_phrase_buckets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    phrase = t.entity_dim.agg(F.min(F.split_part("name", F.lit(" "), F.lit(1)))).first()[0]
    return R.name_buckets(t.chunk_mentions, t.entity_dim, phrase)


@query("g9_surface_names", sql("""SELECT family AS qid, name, n FROM (SELECT family, name, count(*) AS n, row_number() OVER (PARTITION BY family ORDER BY count(*) DESC, name) AS r
FROM chunk_mentions JOIN entity_dim USING (qid) GROUP BY family, name) WHERE r <= 5""", "chunk_mentions", "entity_dim"))
def g9_surface_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    counts = t.chunk_mentions.groupBy("qid").agg(F.count("*").alias("n")).join(t.entity_dim, "qid").groupBy("family", "name").agg(F.sum("n").alias("n"))
    r = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "name"))
    return counts.withColumn("r", r).filter("r <= 5").select(F.col("family").alias("qid"), "name", "n")


@query("g10_footprint_choice", sql(f""", f AS (SELECT family AS concept, qid, count(DISTINCT chunk_id) AS n FROM chunk_mentions JOIN entity_dim USING (qid) WHERE {HIT} GROUP BY family, qid),
r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY n DESC, qid) AS rank FROM f)
SELECT concept, arg_min(qid, rank) AS qid, max(n) AS n, count(*) - 1 AS n_others FROM r GROUP BY concept""", "chunk_mentions", "entity_dim"))
def g10_footprint_choice(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.chunk_mentions.filter(R.evidence(R.DEFAULT_THRESHOLDS)).groupBy("qid").agg(F.countDistinct("chunk_id").alias("n"))
    return R.largest_candidate(per.join(t.entity_dim, "qid").select(F.col("family").alias("concept"), "qid", "n"))


@query("s4_id_scan", "SELECT o_orderkey AS chunk_id FROM orders")
def s4_id_scan(spark, sf_dir):
    return Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("chunk_id"))


@query("s5_point_lookup", sql("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT item_id * 3 FROM benchmark)"))
def s5_point_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang", "source").join(t.benchmark.select((F.col("item_id") * 3).alias("doc_id")), "doc_id", "left_semi")


@query("s6_upsert_if_absent", "SELECT o_orderkey AS chunk_id, o_custkey AS article_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def s6_upsert_if_absent(spark, sf_dir):
    t = Tables(spark, sf_dir)
    there = t.lineitem.filter("l_quantity > 40").select(F.col("l_orderkey").alias("chunk_id"))
    return t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("article_id")).join(there, "chunk_id", "left_anti")


@query("s7_kv_lookup_default", sql("SELECT l_orderkey AS chunk_id, l_linenumber, coalesce(p_name, '') AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) ON p_partkey = l_partkey"))
def s7_kv_lookup_default(spark, sf_dir):
    t = Tables(spark, sf_dir)
    store = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t.lineitem.join(store, "l_partkey", "left").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", F.coalesce("p_name", F.lit("")).alias("name"))


@query("s9_artifact_first_entity", sql("SELECT chunk_id, arg_min(qid, pos) AS qid FROM chunk_mentions JOIN entity_list USING (qid) GROUP BY chunk_id", "chunk_mentions", "entity_list"))
def s9_artifact_first_entity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    artifact = t.chunk_mentions.join(t.entity_list, "qid").groupBy("qid", "pos").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return artifact.select("qid", "pos", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.min_by("qid", "pos").alias("qid"))


@query("s20_preview", "SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 1, 220) AS preview FROM documents ORDER BY doc_id LIMIT 20")
def s20_preview(spark, sf_dir):
    from ..functions.text import preview

    return Tables(spark, sf_dir).documents.orderBy("doc_id").limit(20).select("doc_id", preview(F.col("text"), 220).alias("preview"))


@query("r8_dimension_default", sql("SELECT m.chunk_id, m.mention_pos, m.qid, coalesce(d.name, '') AS name FROM chunk_mentions m LEFT JOIN entity_dim d USING (qid)", "chunk_mentions", "entity_dim"))
def r8_dimension_default(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.chunk_mentions.join(t.entity_dim, "qid", "left").select("chunk_id", "mention_pos", "qid", F.coalesce("name", F.lit("")).alias("name"))


@query("r9_resume_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def r9_resume_anti_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("r19_chunk_to_step", sql("SELECT DISTINCT m.chunk_id, s.step FROM chunk_mentions m JOIN batch_schedule s USING (chunk_id) WHERE m.qid IN ('Q1', 'Q2')", "chunk_mentions", "batch_schedule"))
def r19_chunk_to_step(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ragged = t.batch_schedule.groupBy("step").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    wanted = t.chunk_mentions.filter(F.col("qid").isin("Q1", "Q2")).select("chunk_id").distinct()
    return ragged.select("step", F.explode("chunk_ids").alias("chunk_id")).join(wanted, "chunk_id", "left_semi").select("chunk_id", "step").distinct()


@query("t22_match_phrase", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') || ' ', ' of the ')")
def t22_match_phrase(spark, sf_dir):
    return Tables(spark, sf_dir).documents.filter(R.match_phrase(F.col("text"), "of the")).select("doc_id")


@query("t23_case_sensitive_match", "SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(text, '[^\\pL\\pN]+'), lambda x: x <> ''), ' ') || ' ', ' The ')")
def t23_case_sensitive_match(spark, sf_dir):
    return Tables(spark, sf_dir).documents.filter(R.match_phrase(F.col("text"), "The", fold=False)).select("doc_id")


@query("t22_bm25", """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'der')) AS a, len(list_filter(t, lambda x: x = 'thing')) AS b FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE a > 0 OR b > 0""")
def t22_bm25(spark, sf_dir):
    return R.bm25(Tables(spark, sf_dir).documents, ["der", "thing"]).withColumn("score", F.round("score", 6))


@query("t22_cooccurrence", sql(f"""SELECT DISTINCT a.chunk_id FROM chunk_mentions a JOIN chunk_mentions b USING (chunk_id) WHERE a.qid <> b.qid AND a.hyperlinks >= 1.0 AND b.coref >= 0.9""", "chunk_mentions"))
def t22_cooccurrence(spark, sf_dir):
    # two different entities of a chunk: bounded aggregates instead of pairs of mentions
    t = Tables(spark, sf_dir).chunk_mentions
    linked, chained = F.when(F.col("hyperlinks") >= 1, F.col("qid")), F.when(F.col("coref") >= 0.9, F.col("qid"))
    per = t.groupBy("chunk_id").agg(F.min(linked).alias("a"), F.max(linked).alias("b"), F.min(chained).alias("c"), F.max(chained).alias("d"))
    return per.filter("a is not null and c is not null and not (a = b and b = c and c = d)").select("chunk_id")
