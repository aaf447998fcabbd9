"""Retrieval over entity-annotated chunks: predicates on nested candidates, exclusion sets, masks and footprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("hyperlinks", "entity_linking", "coref", "coref_cluster")
#: A candidate counts if any source's score reaches its threshold.
DEFAULT_THRESHOLDS = {"hyperlinks": 1.0, "entity_linking": 0.6, "coref": 0.6, "coref_cluster": 0.6}
DISABLED = -1


def merge_thresholds(given: dict | None = None) -> dict[str, float]:
    """Defaults overridden by `given`; unknown sources, booleans, non-numbers and values outside 0..1 are errors."""
    out = dict(DEFAULT_THRESHOLDS)
    for source, value in (given or {}).items():
        if source not in out:
            raise ValueError(f"no evidence source is named {source!r}; there are {', '.join(SOURCES)}")
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise ValueError(f"the threshold of {source} must be a number, not {value!r}")
        if not 0 <= value <= 1:
            raise ValueError(f"the threshold of {source} must be from 0 to 1, not {value}")
        out[source] = float(value)
    return out


def active_thresholds(thresholds: dict[str, float]) -> dict[str, float]:
    """Without the sources that are switched off by -1; it is an error if none is left."""
    on = {s: t for s, t in thresholds.items() if t != DISABLED}
    if not on:
        raise ValueError("all evidence sources are switched off")
    return on


def evidence(thresholds: dict[str, float], score=F.col) -> Column:
    """Whether any active source's score reaches its threshold; a missing score doesn't."""
    return reduce(Column.__or__, [F.coalesce(score(s) >= t, F.lit(False)) for s, t in sorted(active_thresholds(thresholds).items())])


def chunks_with_entities(chunks: DataFrame, qids: list[str], thresholds: dict[str, float] | None = None) -> DataFrame:
    """The nested form of the predicate: some candidate of some mention is of qids and has the evidence, the same candidate for both."""
    limits = thresholds or DEFAULT_THRESHOLDS
    wanted = lambda c: c["qid"].isin(*qids) & evidence(limits, lambda s: c["scores_by_source"][s])
    return chunks.filter(F.exists("entities", lambda m: F.exists(m["candidates"], wanted)))


def excluded_ids(mentions: DataFrame, entities: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Distinct chunk_id of mentions of the listed entities that have the evidence."""
    return mentions.filter(evidence(thresholds or DEFAULT_THRESHOLDS)).join(entities.select("qid"), "qid", "left_semi").select("chunk_id").distinct()


def entity_footprints(mentions: DataFrame, entities: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(qid, num_chunks) of every listed entity, 0 if no chunk has it: one pass, not one query an entity."""
    found = mentions.filter(evidence(thresholds or DEFAULT_THRESHOLDS)).join(entities.select("qid"), "qid", "left_semi")
    return entities.select("qid").join(found.groupBy("qid").agg(F.countDistinct("chunk_id").alias("num_chunks")), "qid", "left").fillna(0, ["num_chunks"])


def attribute_chunks(mentions: DataFrame, entities: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(chunk_id, qid): each excluded chunk with the first listed entity that it mentions."""
    hits = mentions.filter(evidence(thresholds or DEFAULT_THRESHOLDS)).join(entities, "qid")
    return hits.groupBy("chunk_id").agg(F.min_by("qid", "pos").alias("qid"))


def mask_batches(schedule: DataFrame, excluded: DataFrame, existing: Column | None = None) -> DataFrame:
    """(step, ordinal, chunk_id, keep, leaked): keep where a chunk isn't excluded and was in use before.

    If that leaves nothing of a step, its last row is kept and marked as leaked."""
    step = Window.partitionBy("step")
    rows = schedule.join(excluded.select("chunk_id", F.lit(True).alias("_out")).distinct(), "chunk_id", "left")
    rows = rows.withColumn("_keep", F.col("_out").isNull() & (existing if existing is not None else F.lit(True)))
    rows = rows.withColumn("ordinal", F.row_number().over(step.orderBy("chunk_id")))
    alone = ~F.max("_keep").over(step) & (F.col("ordinal") == F.count("*").over(step))
    return rows.select("step", "ordinal", "chunk_id", (F.col("_keep") | alone).alias("keep"), alone.alias("leaked"))


def cumulative_exclusions(masked: DataFrame) -> DataFrame:
    """(step, n_excluded, total): how many rows each step loses, and the sum so far. Steps are few: one row each is windowed."""
    per = masked.groupBy("step").agg(F.sum((~F.col("keep") | F.col("leaked")).cast("long")).alias("n_excluded"))
    return per.withColumn("total", F.sum("n_excluded").over(Window.orderBy("step")))


def name_buckets(mentions: DataFrame, names: DataFrame, phrase: str, n: int = 10) -> DataFrame:
    """The n entities with most candidates among those whose name has the phrase's words in a row, whatever the case."""
    words = rf"(?i)(^|[^\p{{Alnum}}]){r'[^\p{Alnum}]+'.join(phrase.split())}([^\p{{Alnum}}]|$)"
    found = mentions.join(names.filter(F.col("name").rlike(words)), "qid")
    return found.groupBy("qid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qid").limit(n)


def largest_candidate(footprints: DataFrame) -> DataFrame:
    """(concept, qid, n) -> the concept's entity of most chunks, with its runners-up by falling count."""
    ranked = footprints.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "qid")))
    return ranked.groupBy("concept").agg(F.max_by("qid", -F.col("rank")).alias("qid"), F.max("n").alias("n"), (F.count("*") - 1).alias("n_others"))


def tokens(text: Column, fold: bool = True) -> Column:
    """Words of letters and digits, in order; fold: lower-cased."""
    return F.filter(F.split(F.lower(text) if fold else text, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def match_phrase(text: Column, phrase: str, fold: bool = True) -> Column:
    """Whether the phrase's words stand in a row among the text's."""
    words = (phrase.lower() if fold else phrase).split()
    joined = F.concat(F.lit(" "), F.array_join(tokens(text, fold), " "), F.lit(" "))
    return joined.contains(f" {' '.join(words)} ")


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents with any query word, by BM25 with the usual idf ln(1 + (N - n + 0.5) / (n + 0.5)).

    One pass gives every document its length and its counts of the query's words; the corpus statistics are one row."""
    words = [w.lower() for w in dict.fromkeys(query)]
    toks = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("t"))
    occurs = lambda w: F.size(F.filter("t", lambda x: x == F.lit(w)))
    counts = [occurs(w).alias(f"tf{i}") for i, w in enumerate(words)]
    rows = toks.select(id_col, F.size("t").alias("len"), *counts)
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(words))])
    idf = lambda i: F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    part = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    any_word = reduce(Column.__or__, [F.col(f"tf{i}") > 0 for i in range(len(words))])
    return rows.filter(any_word).crossJoin(F.broadcast(stats)).select(id_col, reduce(Column.__add__, [part(i) for i in range(len(words))]).alias("score"))
