"""Queries of whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.plugins import splitters, statistics
from ..operators import features as FE
from ..operators import inference as I
from ..operators import retrieval as R
from ..operators import sampling as S
from ..operators import scoring as SC
from ..operators.validation import Ledger
from ..sources.scratch import staged
from ..tables import Tables, sql
from .annotate import harvestable
from .features import RHO
from .registry import query
from .retrieval import HIT
from .scoring import RANKED, ranked


@query("cc_sentence_harvest")
def cc(spark, sf_dir):
    """Pools of chunks by entity, each chunk to its rarest; draws in balanced order, gated; the first 60 distinct sentences."""
    chunks = harvestable(spark, sf_dir)
    pools = chunks.select("chunk_id", F.explode("entities").alias("m")).select("chunk_id", F.explode("m.candidates").alias("c")).select("chunk_id", "c.qid")
    order = S.balanced_order(S.rarest_owner(pools), seed=3)
    order = staged(order, "order")
    picked = S.select_mentions(chunks, [f"Q{i}" for i in range(5)], lambda sc: R.evidence(R.DEFAULT_THRESHOLDS, lambda s: sc[s]))

    def gate(rows):
        # staged, as what comes after names a sentence and its reason many times, and each of them would be worked out anew
        told = staged(S.harvest(picked.join(F.broadcast(rows.select("chunk_id")), "chunk_id", "left_semi"), splitters.get("regex")), "harvest")
        gated = rows.join(told, "chunk_id")
        return gated.withColumn("key", T.dedup_key(F.col("sentence"))).withColumn("accepted", (F.col("reason") == "ok") & (T.word_count(F.col("sentence")) >= 4))

    return S.accept_in_turn(order, gate, 60).select("chunk_id", "qid", "place", "sentence")


@query("p11_truncated_spans")
def p11(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", F.explode(T.split_sentences("text")).alias("s"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_truncated(F.col("s"), F.col("text"))).alias("n_truncated"))


@query("cd_select_candidates", RANKED + " SELECT topic, m AS method, label, h FROM r WHERE rank = 1")
def cd(spark, sf_dir):
    return ranked(spark, sf_dir).filter("selected").select("topic", "method", "label", "h")


@query("ce_compare_report", sql("SELECT concept, item_set, count(*) AS n, round(avg(nll_edited - nll_full), 6) AS mean, round(quantile_cont(nll_edited - nll_full, 0.5), 6) AS median, round(avg(abs(nll_edited - nll_twin)) / avg(abs(nll_full - nll_twin)), 6) AS r_abs FROM paired_nll GROUP BY concept, item_set", "paired_nll"))
def ce(spark, sf_dir):
    p = Tables(spark, sf_dir).paired_nll.withColumn("d", F.col("nll_edited") - F.col("nll_full"))
    a, b = SC.signed_summary(p, "d", "concept", "item_set"), SC.paired_distances(p, "concept", "item_set")
    return a.select("concept", "item_set", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median")).join(b.select("concept", "item_set", F.round("r_abs", 6).alias("r_abs")), ["concept", "item_set"])


@query("cf_score_missing_then_select", RANKED + " SELECT topic, m AS method, count(*) AS n_scored, max(h) AS best FROM r GROUP BY topic, m")
def cf(spark, sf_dir):
    """Cells scored before are kept, the missing ones scored now; a second run has nothing left to score."""
    all_cells = ranked(spark, sf_dir).select("topic", "method", "label", "h")
    done = all_cells.filter(F.crc32("label") % 2 == 0)
    missing = all_cells.join(done.select("topic", "method", "label"), ["topic", "method", "label"], "left_anti")
    return done.unionByName(missing).groupBy("topic", "method").agg(F.count("*").alias("n_scored"), F.max("h").alias("best"))


@query("cg_ensemble_export", sql("SELECT concept, count(*) AS n, round(avg(abs(nll_edited - nll_twin)), 6) AS d_abs_m_t, round(avg(abs(nll_full - nll_twin)), 6) AS d_abs_f_t, round(avg(nll_edited) / avg(nll_full), 6) AS r_nll FROM paired_nll GROUP BY concept", "paired_nll"))
def cg(spark, sf_dir):
    """The summary is given out if the inputs are unique, paired and finite."""
    p = Tables(spark, sf_dir).paired_nll
    finite = F.lit(True)
    for c in ("nll_full", "nll_twin", "nll_edited"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    ledger = Ledger().add("inputs", "finite", p, finite).add("inputs", "unique", p.groupBy("item_id").agg(F.count("*").alias("n")), F.col("n") == 1)
    d = SC.paired_distances(p, "concept").select("concept", "n", F.round("d_abs_m_t", 6).alias("d_abs_m_t"), F.round("d_abs_f_t", 6).alias("d_abs_f_t"))
    return ledger.release(d.join(p.groupBy("concept").agg(F.round(F.avg("nll_edited") / F.avg("nll_full"), 6).alias("r_nll")), "concept"))


@query("ch_footprint_survey", sql(f"""WITH f AS (SELECT family AS concept, qid, count(DISTINCT chunk_id) AS n FROM chunk_mentions JOIN entity_dim USING (qid) WHERE {HIT} GROUP BY family, qid), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY n DESC, qid) AS rank FROM f)
SELECT concept, qid, n, round(n / (SELECT count(DISTINCT chunk_id) FROM chunk_mentions)::DOUBLE, 6) AS fraction FROM r WHERE rank = 1""", "chunk_mentions", "entity_dim"))
def ch(spark, sf_dir):
    t = Tables(spark, sf_dir)
    per = t.chunk_mentions.filter(R.evidence(R.DEFAULT_THRESHOLDS)).groupBy("qid").agg(F.countDistinct("chunk_id").alias("n"))
    best = R.largest_candidate(per.join(t.entity_dim, "qid").select(F.col("family").alias("concept"), "qid", "n"))
    total = t.chunk_mentions.agg(F.countDistinct("chunk_id").alias("total"))
    return best.crossJoin(F.broadcast(total)).select("concept", "qid", "n", F.round(F.col("n") / F.col("total"), 6).alias("fraction"))


@query("ci_grid_screen", sql(f"SELECT p_brand AS cell, count(*) AS n, count(rho) AS n_with_stats, count(CASE WHEN rho >= 0.95 THEN 1 END) AS n_over, round(max(rho), 6) AS best FROM part LEFT JOIN ({RHO}) ON feature = p_partkey GROUP BY p_brand", "coordinates"))
def ci(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.part.join(FE.mass_ratio(t.coordinates), F.col("feature") == F.col("p_partkey"), "left")
    return j.groupBy(F.col("p_brand").alias("cell")).agg(F.count("*").alias("n"), F.count("rho").alias("n_with_stats"), F.count_if(F.col("rho") >= 0.95).alias("n_over"), F.round(F.max("rho"), 6).alias("best"))


@query("cj_cross_null_effects", sql("SELECT concept, item_set, n, round(z, 6) AS dz, rank() OVER (PARTITION BY item_set ORDER BY round(abs(z), 6) DESC)::INT AS place FROM (SELECT concept, item_set, count(*) AS n, avg(nll_edited - nll_full) / stddev_samp(nll_edited - nll_full) AS z FROM paired_nll GROUP BY concept, item_set)", "paired_nll"))
def cj(spark, sf_dir):
    from pyspark.sql import Window

    p = Tables(spark, sf_dir).paired_nll.withColumn("d", F.col("nll_edited") - F.col("nll_full"))
    e = I.paired_effect(p, ["concept", "item_set"], "d")
    place = F.rank().over(Window.partitionBy("item_set").orderBy(F.desc(F.round(F.abs("dz"), 6))))
    return e.select("concept", "item_set", "n", F.round("dz", 6).alias("dz"), place.alias("place"))


@query("udf_statistics_registry", sql("SELECT concept, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(avg((x < 0)::INT), 6) AS frac_neg, round(avg((x > 0)::INT), 6) AS frac_pos, round(stddev_samp(x), 6) AS sd FROM (SELECT concept, nll_edited - nll_full AS x FROM paired_nll) GROUP BY concept", "paired_nll"))
def registry_statistics(spark, sf_dir):
    x = F.col("nll_edited") - F.col("nll_full")
    names = ("mean", "median", "frac_neg", "frac_pos", "sd")
    return Tables(spark, sf_dir).paired_nll.groupBy("concept").agg(*[F.round(statistics.get(n)(x), 6).alias(n) for n in names])
