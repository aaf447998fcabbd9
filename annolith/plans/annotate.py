"""Queries of evidence merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import sampling as S
from ..tables import Tables, sql
from .registry import query


def annotated(spark, sf_dir):
    """Annotated documents from line items: a document an order, a mention a line."""
    t = Tables(spark, sf_dir)
    li = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    # mention places of 40 characters a line; equal lines of an order differ by part
    a = (F.col("l_linenumber") * 40 + F.col("l_partkey") % 7).cast("int")
    link = F.struct(a.alias("start"), (a + F.length("p_name")).alias("end"), F.col("p_name").alias("surface_form"), F.translate("p_name", " ", "_").alias("uri"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Q"), "l_partkey")).alias("qcode"))
    ent = F.struct(a.alias("start"), F.length("p_name").alias("ln"), F.col("p_name").alias("text"), F.struct(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("Q"), F.col("l_partkey") % 50)).alias("wikidata_entity_id"), F.when(F.col("l_partkey") % 2 == 0, F.col("p_name")).alias("human_readable_name")).alias("predicted_entity"), (F.col("l_quantity") / 50).alias("entity_linking_model_confidence_score"))
    span = F.struct(F.array(a - 4, a + F.length("p_name")).alias("o"), F.concat(F.lit("the "), "p_name").alias("t"))
    # lines are narrower than the lists of them: they are dealt out by document before these are made
    lines = li.select("l_partkey", "l_linenumber", "p_name", "l_returnflag", "l_quantity", F.col("l_orderkey").cast("string").alias("id")).repartition("id")
    docs = lines.groupBy("id").agg(F.array_sort(F.collect_list(link)).alias("hyperlinks_clean"), F.array_sort(F.collect_list(ent)).alias("entity_linking"), F.array_sort(F.collect_list(span)).alias("spans"))
    coref = F.struct(F.array(F.transform("spans", lambda s: s["o"])).alias("clusters_char_offsets"), F.array(F.transform("spans", lambda s: s["t"])).alias("clusters_char_text"))
    return docs.select("id", "hyperlinks_clean", "entity_linking", coref.alias("coref")), t.entity_dim.select("qid", "name").dropDuplicates(["qid"])


LINES = "SELECT l.*, p_name, (l_linenumber * 40 + l_partkey % 7)::INT AS a FROM lineitem l JOIN part ON p_partkey = l_partkey"


@query("p1_linking_mentions", f"SELECT l_orderkey::VARCHAR AS doc_id, a AS start, (a + len(p_name))::INT AS end, p_name AS text, 'Q' || l_partkey % 50 AS id, coalesce(CASE WHEN l_partkey % 2 = 0 THEN p_name END, (SELECT any_value(d.p_name) FROM part d WHERE d.p_partkey = l_partkey % 50), '') AS name, l_quantity / 50 AS confidence FROM ({LINES}) WHERE l_returnflag <> 'N'")
def p1(spark, sf_dir):
    return A.linked_mentions(*annotated(spark, sf_dir)).drop("seq", "type")


@query("p2_hyperlink_mentions", f"SELECT l_orderkey::VARCHAR AS doc_id, a AS start, (a + len(p_name))::INT AS end, p_name AS text, 'Q' || l_partkey AS id, p_name AS name, 1.0::DOUBLE AS confidence FROM ({LINES}) WHERE l_returnflag = 'R'")
def p2(spark, sf_dir):
    return A.hyperlink_mentions(annotated(spark, sf_dir)[0]).drop("seq", "type")


@query("u1_evidence_union", f"SELECT l_orderkey::VARCHAR AS doc_id, count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS n_entities, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_links FROM ({LINES}) GROUP BY l_orderkey HAVING count(CASE WHEN l_returnflag <> 'N' THEN 1 END) > 0")
def u1(spark, sf_dir):
    docs, dim = annotated(spark, sf_dir)
    both = A.linked_mentions(docs, dim).unionByName(A.hyperlink_mentions(docs))
    return both.groupBy("doc_id").agg(F.count(F.when(F.col("type") == "entity", 1)).alias("n_entities"), F.count(F.when(F.col("type") == "link", 1)).alias("n_links"))


@query("p3_valid_entities", "SELECT l_orderkey AS chunk_id, count(*)::INT AS n_mentions, round(sum(CASE WHEN l_quantity > 30 THEN 0.0 ELSE l_discount END)::DOUBLE, 6) AS total FROM lineitem WHERE l_partkey % 5 <> 0 AND l_returnflag <> 'N' GROUP BY l_orderkey")
def p3(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    cand = F.struct(F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("Q"), "l_partkey")).alias("qid"), F.lit("n").alias("name"), F.when(F.col("l_quantity") > 30, "none").otherwise(F.col("l_discount").cast("string")).alias("aggregated_score"))
    mention = F.struct(F.col("l_linenumber").alias("char_start"), F.col("l_linenumber").alias("char_end"), F.when(F.col("l_returnflag") != "N", F.lit("m")).alias("text_mention"), F.array(cand).alias("candidates"))
    chunks = li.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(A.valid_entities(F.collect_list(mention)).alias("e")).filter(F.size("e") > 0)
    return chunks.select("chunk_id", F.size("e").alias("n_mentions"), F.round(F.aggregate("e", F.lit(0.0), lambda x, m: x + m["candidates"][0]["aggregated_score"]), 6).alias("total"))


@query("p4_chunk_body", "SELECT o_orderkey AS chunk_id, o_custkey AS article_id, c_name AS title, 'customer ' || c_custkey AS metadata_source, o_orderpriority AS text FROM orders JOIN customer ON c_custkey = o_custkey")
def p4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("article_id"), F.col("c_name").alias("title"), F.concat(F.lit("customer "), "c_custkey").alias("metadata_source"), F.col("o_orderpriority").alias("text"))


OVERLAP = "FROM spans a JOIN candidates b ON a.doc_id = b.doc_id AND NOT (b.cand_end <= a.span_start OR b.cand_start >= a.span_end)"


@query("r3_overlap_join", sql(f"SELECT a.doc_id, span_start, span_end, cand_start, cand_end, qid {OVERLAP}", "spans", "candidates"))
def r3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.overlap_join(t.spans, t.candidates)


@query("r3_overlap_join_pieces", sql(f"SELECT a.doc_id, span_start, span_end, cand_start, cand_end, qid {OVERLAP}", "spans", "candidates"))
def r3_pieces(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.overlap_join(t.spans, t.candidates, bucket=32)


@query("r4_containment_first", """WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, (l_linenumber * 10)::INT AS start, (l_linenumber * 10 + l_quantity % 9)::INT AS "end" FROM lineitem),
s AS (SELECT DISTINCT l_orderkey AS doc_id, (l_linenumber * 15 - 10)::INT AS s_start, (l_linenumber * 15 + 12)::INT AS s_end FROM lineitem)
SELECT doc_id, start, "end", min(s_start) AS s_start, arg_min(s_end, s_start) AS s_end FROM m JOIN s USING (doc_id) WHERE s_start <= start AND "end" <= s_end GROUP BY doc_id, start, "end" """)
def r4(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem
    n = F.col("l_linenumber")
    m = li.select(F.col("l_orderkey").alias("doc_id"), (n * 10).cast("int").alias("start"), (n * 10 + F.col("l_quantity") % 9).cast("int").alias("end")).distinct()
    s = li.select(F.col("l_orderkey").alias("doc_id"), (n * 15 - 10).cast("int").alias("s_start"), (n * 15 + 12).cast("int").alias("s_end")).distinct()
    return A.contained_first(m, s)


@query("r5_best_anchor")
def r5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.expr("l_suppkey % 3").alias("cluster"), F.col("l_linenumber").alias("n"), "p_name", "l_partkey", "l_quantity")
    spans = named.filter("n % 2 = 0").groupBy("doc_id", "cluster", F.col("n").alias("span")).agg(F.min("p_name").alias("span_text"))
    anchors = named.filter("n % 2 = 1").select("doc_id", "cluster", (F.col("n") * 1_000_000 + F.col("l_partkey")).alias("seq"), F.col("p_name").alias("text"), F.concat(F.lit("Q"), "l_partkey").alias("id"), (F.col("l_quantity") / 50).alias("confidence"))
    return A.inferred_spans(spans, anchors).withColumn("score", F.round("score", 6))


EVIDENCE = """SELECT l_orderkey AS doc_id, (l_linenumber / 2)::INT * 10 AS start, 'Q' || l_partkey % 5 AS qid, CASE l_suppkey % 4 WHEN 0 THEN 'hyperlinks' WHEN 1 THEN 'entity_linking' WHEN 2 THEN 'coref' ELSE 'coref_cluster' END AS source,
CASE l_suppkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN l_quantity / 50 WHEN 2 THEN l_discount * 9.7 ELSE l_tax * 11.3 END::DOUBLE AS score,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq FROM lineitem"""
PIVOT = f"""SELECT doc_id, start, qid, """ + ", ".join(f"coalesce(round_even(arg_max(score, seq) FILTER (source = '{s}'), 2), 0.0)::DOUBLE AS {s}" for s in A.WEIGHTS) + f""" FROM ({EVIDENCE.replace("(l_linenumber / 2)::INT", "floor(l_linenumber / 2)::INT")}) WHERE score <> 0 GROUP BY doc_id, start, qid"""


def evidence(spark, sf_dir):
    from pyspark.sql import Window

    li = Tables(spark, sf_dir).lineitem
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    k = F.col("l_suppkey") % 4
    source = F.when(k == 0, "hyperlinks").when(k == 1, "entity_linking").when(k == 2, "coref").otherwise("coref_cluster")
    score = F.when(k == 0, 1.0).when(k == 1, F.col("l_quantity") / 50).when(k == 2, F.col("l_discount") * 9.7).otherwise(F.col("l_tax") * 11.3)
    start = (F.floor(F.col("l_linenumber") / 2) * 10).cast("int")
    return li.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 5).alias("end"), F.concat(F.lit("Q"), F.col("l_partkey") % 5).alias("qid"), source.alias("source"), score.alias("score"), F.lit("").alias("name"), F.lit("t").alias("text"), seq.alias("seq"))


@query("g1_evidence_pivot", f"SELECT *, round_even(least(1.0, greatest(0.0, (hyperlinks * 4 + entity_linking * 3 + coref * 2 + coref_cluster) / 10)), 5)::DOUBLE AS aggregated_score FROM ({PIVOT})")
def g1(spark, sf_dir):
    return A.pivot_evidence(evidence(spark, sf_dir)).select("doc_id", "start", "qid", *A.WEIGHTS, A.weighted_score(digits=5).alias("aggregated_score"))


@query("g2_evidence_mean", f"SELECT * FROM (SELECT doc_id, start, qid, round_even(least(1.0, greatest(0.0, (hyperlinks * 1.0 + entity_linking * 1.0 + coref * 0.75 + coref_cluster * 0.5) / 3.25)), 2)::DOUBLE AS aggregated_score FROM ({PIVOT})) WHERE aggregated_score > 0")
def g2(spark, sf_dir):
    rows = A.pivot_evidence(evidence(spark, sf_dir)).select("doc_id", "start", "qid", A.weighted_score(A.MEAN_WEIGHTS).alias("aggregated_score"))
    return rows.filter("aggregated_score > 0")


CONTRIB = "SELECT l_orderkey AS doc_id, l_suppkey % 3 AS cluster, 'Q' || l_partkey % 4 AS id, l_linenumber AS start, l_quantity / 50 AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq FROM lineitem"


def contributions(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"))
    return Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("doc_id"), F.expr("l_suppkey % 3").alias("cluster"), F.concat(F.lit("Q"), F.col("l_partkey") % 4).alias("id"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"), (F.col("l_quantity") / 50).alias("weight"), seq.alias("seq"))


@query("g3_cluster_softmax", f"""WITH o AS (SELECT doc_id, cluster, id, start, arg_min(weight, seq) AS w FROM ({CONTRIB}) GROUP BY doc_id, cluster, id, start), s AS (SELECT doc_id, cluster, id, sum(w) AS total FROM o GROUP BY doc_id, cluster, id)
SELECT doc_id, cluster, id, round(exp(total) / sum(exp(total)) OVER (PARTITION BY doc_id, cluster), 6) AS score FROM s""")
def g3(spark, sf_dir):
    return A.cluster_entity_scores(contributions(spark, sf_dir)).select("doc_id", "cluster", "id", F.round("score", 6).alias("score"))


@query("g4_span_score", f"SELECT doc_id, cluster, start AS span, id, max(weight) AS score FROM ({CONTRIB}) GROUP BY doc_id, cluster, start, id")
def g4(spark, sf_dir):
    return A.span_scores(contributions(spark, sf_dir).withColumnRenamed("start", "span"))


@query("g5_strong_clusters", f"SELECT doc_id, cluster FROM ({CONTRIB}) GROUP BY doc_id, cluster HAVING max(weight) >= 0.3")
def g5(spark, sf_dir):
    return A.strong_clusters(A.span_scores(contributions(spark, sf_dir).withColumnRenamed("start", "span")))


@query("ca_annotate_documents")
def ca(spark, sf_dir):
    return A.annotate(*annotated(spark, sf_dir)).select("doc_id", F.explode("entities").alias("m")).select("doc_id", "m.char_start", "m.char_end", "m.text_mention", F.explode("m.candidates").alias("c")).select("doc_id", "char_start", "char_end", "text_mention", "c.qid", "c.name", "c.scores_by_source.*", "c.aggregated_score")


POOLS = "SELECT DISTINCT chunk_id, qid FROM chunk_mentions"
OWNED = f"SELECT chunk_id, arg_min(qid, (pool_size, qid)) AS qid, min(pool_size) AS pool_size FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS pool_size FROM ({POOLS})) GROUP BY chunk_id"


def pools(spark, sf_dir):
    return Tables(spark, sf_dir).chunk_mentions.select("chunk_id", "qid").distinct()


@query("w5_rarest_owner", sql(OWNED, "chunk_mentions"))
def w5(spark, sf_dir):
    return S.rarest_owner(pools(spark, sf_dir))


@query("w6_balanced_order", sql(f"""SELECT chunk_id, qid, turn, row_number() OVER (ORDER BY turn, size, qid) - 1 AS place FROM (
SELECT chunk_id, qid, row_number() OVER (PARTITION BY qid ORDER BY md5('11|' || qid || '|' || chunk_id), chunk_id)::INT AS turn, count(*) OVER (PARTITION BY qid) AS size FROM ({OWNED}))""", "chunk_mentions"))
def w6(spark, sf_dir):
    return S.balanced_order(S.rarest_owner(pools(spark, sf_dir)), seed=11)


@query("o1_sorted_distinct", sql("SELECT DISTINCT chunk_id FROM chunk_mentions WHERE qid = 'Q7' ORDER BY chunk_id", "chunk_mentions"))
def o1(spark, sf_dir):
    return Tables(spark, sf_dir).chunk_mentions.filter("qid = 'Q7'").select("chunk_id").distinct().orderBy("chunk_id")


@query("o2_accept_until", """WITH g AS (SELECT doc_id, md5('3|' || doc_id) AS place, lang || length(text) % 50 AS key, len(text) > 200 AS accepted FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS r FROM g WHERE accepted) SELECT doc_id, place, key FROM f WHERE r = 1 ORDER BY place LIMIT 25""")
def o2(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    gated = d.select("doc_id", S.draw(3, "doc_id").alias("place"), F.concat("lang", F.length("text") % 50).alias("key"), (F.length("text") > 200).alias("accepted"))
    return S.accept_until(gated, 25).select("doc_id", "place", "key")


@query("o3_seeded_take", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def o3(spark, sf_dir):
    return S.take(Tables(spark, sf_dir).documents.select("doc_id", "source"), 50, 42, "doc_id")


@query("o4_frozen_phases", """WITH v AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id) AS r FROM documents WHERE len(text) >= 100 AND source IS NOT NULL) SELECT doc_id, CASE WHEN r <= 50 THEN 'selection' ELSE 'test' END AS phase FROM v WHERE r <= 100""")
def o4(spark, sf_dir):
    from pyspark.sql import Window

    good = Tables(spark, sf_dir).documents.filter((F.length("text") >= 100) & F.col("source").isNotNull()).select("doc_id")
    r = F.row_number().over(Window.orderBy(S.draw(9, "doc_id"), "doc_id"))
    return S.take(good, 100, 9, "doc_id").withColumn("r", r).select("doc_id", F.when(F.col("r") <= 50, "selection").otherwise("test").alias("phase"))


@query("o5_stratified_sample", """WITH q AS (SELECT lang, greatest(1, round(count(*) * 0.1))::BIGINT AS quota FROM documents GROUP BY lang),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('8|' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE r <= quota""")
def o5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    quotas = t.documents.groupBy("lang").agg(F.greatest(F.lit(1), F.round(F.count("*") * 0.1)).cast("long").alias("quota"))
    pool = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return S.stratified_sample(pool, quotas, "lang", "doc_id", 8)


@query("o6_option_order", sql("SELECT question_id, option_index, (row_number() OVER (PARTITION BY question_id ORDER BY sha1(question_id || '|' || option_index)) - 1)::INT AS shown_at FROM option_scores", "option_scores"))
def o6(spark, sf_dir):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("question_id").orderBy(F.sha1(F.concat_ws("|", "question_id", "option_index")))) - 1
    return Tables(spark, sf_dir).option_scores.select("question_id", "option_index", at.alias("shown_at"))


@query("o7_few_shot", sql("SELECT letter, question_id FROM (SELECT substr('ABCD', gold_index + 1, 1) AS letter, question_id, row_number() OVER (PARTITION BY gold_index ORDER BY question_id) AS r FROM option_scores WHERE option_index = 0) WHERE r = 1", "option_scores"))
def o7(spark, sf_dir):
    q = Tables(spark, sf_dir).option_scores.filter("option_index = 0")
    return q.groupBy(F.substring(F.lit("ABCD"), 1, 4).substr(F.col("gold_index") + 1, F.lit(1)).alias("letter")).agg(F.min("question_id").alias("question_id"))


@query("o8_verification_sample", "SELECT o_orderkey FROM orders ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT 20")
def o8(spark, sf_dir):
    return S.take(Tables(spark, sf_dir).orders.select("o_orderkey"), 20, 1, "o_orderkey")


def harvestable(spark, sf_dir):
    """Chunks from documents, with a mention of their third word."""
    from ..functions.text import instr

    d = Tables(spark, sf_dir).documents
    word = F.regexp_extract("text", r"^(?:\S+\s+){2}(\S+)", 1)
    a = instr(F.col("text"), word) - 1
    cand = F.struct(F.concat(F.lit("Q"), F.col("doc_id") % 5).alias("qid"), F.struct(F.lit(1.0).alias("hyperlinks"), F.lit(0.2).alias("entity_linking"), F.lit(0.0).alias("coref"), F.lit(0.0).alias("coref_cluster")).alias("scores_by_source"))
    mention = F.struct(a.alias("char_start"), (a + F.length(word)).alias("char_end"), word.alias("text_mention"), F.array(cand).alias("candidates"))
    return d.select(F.col("doc_id").alias("chunk_id"), "text", F.array(mention).alias("entities"))


@query("p10_harvest_reasons")
def p10(spark, sf_dir):
    from ..operators.retrieval import DEFAULT_THRESHOLDS, evidence as clears

    picked = S.select_mentions(harvestable(spark, sf_dir), ["Q1", "Q2", "Q3"], lambda sc: clears(DEFAULT_THRESHOLDS, lambda s: sc[s]))
    return S.harvest(picked)


@query("g31_rejections")
def g31(spark, sf_dir):
    return p10(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query("w2_best_mention", sql("SELECT chunk_id, arg_max(mention_pos, (hyperlinks, entity_linking, coref, coref_cluster, -mention_pos, -hash_part)) AS mention_pos FROM (SELECT *, substr(qid, 2)::INT AS hash_part FROM chunk_mentions) GROUP BY chunk_id", "chunk_mentions"))
def w2(spark, sf_dir):
    m = Tables(spark, sf_dir).chunk_mentions
    key = F.struct("hyperlinks", "entity_linking", "coref", "coref_cluster", -F.col("mention_pos"), -F.substring("qid", 2, 20).cast("int"))
    return m.groupBy("chunk_id").agg(F.max_by("mention_pos", key).alias("mention_pos"))


@query("p9_mention_gate", "SELECT l_orderkey AS chunk_id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (1, 2, 3, 5, 8) AND l_returnflag <> 'N' AND lower(trim(p_name)) NOT IN ('it', 'they') GROUP BY l_orderkey")
def p9(spark, sf_dir):
    from ..functions.text import NO_ANCHOR

    t = Tables(spark, sf_dir)
    m = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).withColumn("start", F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")))
    gate = F.col("l_partkey").isin(1, 2, 3, 5, 8) & F.col("start").isNotNull() & (F.trim("p_name") != "") & ~F.lower(F.trim("p_name")).isin(*NO_ANCHOR)
    return m.filter(gate).groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.count("*").alias("n"))
