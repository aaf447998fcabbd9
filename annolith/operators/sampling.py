"""Reproducible sampling: orders by hash, quotas, balanced draws and harvests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import staged


def draw(seed: int, *keys: str) -> Column:
    """A hash that orders rows at random, the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """df with `ordinal`, the place of each row in the order, from 0, without bringing all rows to one task.

    Rows are sorted into range partitions and written with their places in them, so that both branches read the same
    ones; each partition's count gives the next one its start."""
    ranged = df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    ranged = staged(ranged, "ordinals")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(starts), "_part").withColumn("ordinal", F.col("start") + F.col("_row") - F.col("low")).drop("_part", "_row", "n", "low", "start")


def hashed_batches(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """(key, batch): rows in seeded order, cut into batches of `size`."""
    rows = df.select(key).withColumn("_draw", draw(seed, key))
    return ordinals(rows, F.col("_draw"), F.col(key)).select(key, F.floor(F.col("ordinal") / size).alias("batch"))


def take(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in seeded order; the order of df's rows doesn't matter."""
    return df.withColumn("_draw", draw(seed, *keys)).orderBy("_draw", *keys).limit(n).drop("_draw")


def rarest_owner(pairs: DataFrame) -> DataFrame:
    """(chunk_id, qid) pairs -> each chunk with its qid of fewest chunks, the first by name of equals."""
    distinct = pairs.select("chunk_id", "qid").distinct()
    sizes = distinct.groupBy("qid").agg(F.count("*").alias("pool_size"))
    ranked = distinct.join(sizes, "qid").groupBy("chunk_id").agg(F.min(F.struct("pool_size", "qid")).alias("o"))
    return ranked.select("chunk_id", "o.qid", "o.pool_size")


def balanced_order(owned: DataFrame, seed: int) -> DataFrame:
    """(chunk_id, qid, turn, place): the i-th draw of every pool comes before any (i+1)-th, small pools first."""
    sizes = owned.groupBy("qid").agg(F.count("*").alias("size"))
    turn = F.row_number().over(Window.partitionBy("qid").orderBy(draw(seed, "qid", "chunk_id"), "chunk_id"))
    rows = owned.select("chunk_id", "qid").withColumn("turn", turn).join(sizes, "qid")
    return ordinals(rows, F.col("turn"), F.col("size"), F.col("qid")).select("chunk_id", "qid", "turn", F.col("ordinal").alias("place"))


def stratified_sample(pool: DataFrame, quotas: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """Of every stratum as many rows as its quota, in seeded order. quotas: (by, quota)."""
    placed = pool.join(quotas, by).withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(draw(seed, key), key)))
    return placed.filter("_place <= quota").drop("_place", "quota")


def accept_until(gated: DataFrame, target: int) -> DataFrame:
    """Rows in order of place of which the first `target` accepted ones, without repeats of a key, are the sample.

    gated: (place, key, accepted, ...). Repeats are those accepted rows whose key was accepted earlier."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    kept = gated.filter("accepted").withColumn("_first", first).filter("_first = 1").drop("_first")
    return kept.orderBy("place").limit(target)


def accept_in_turn(order: DataFrame, gate, target: int, step: int = 1024) -> DataFrame:
    """accept_until(gate(order), target), gating rows only as far as the target takes: twice as many places at each turn, up to all.

    order: (place, ...), places from 0 without gaps, a written table; gate gives each row for itself (key, accepted) beside its
    columns. A row is a repeat of earlier places alone, so the first `target` of a prefix that holds so many are those of the whole table."""
    total = order.count()
    while True:
        found = staged(accept_until(gate(order.filter(F.col("place") < step)), target), "accepted")
        if step >= total or found.count() >= target:
            return found
        step *= 2


def length_report(df: DataFrame, by: str, text: str) -> DataFrame:
    """Word counts of each group: n, extremes, median, population deviation, distinct counts, and exclusive deciles from ten texts on."""
    words = df.select(by, T.word_count(F.col(text)).alias("w"))
    per = words.groupBy(by).agg(
        F.count("*").alias("n"), F.min("w").alias("min"), F.max("w").alias("max"), F.percentile("w", 0.5).alias("median"),
        F.round(F.stddev_pop("w"), 6).alias("stdev"), F.countDistinct("w").alias("distinct_lengths"),
    )
    # the exclusive p-quantile of n values is between the places floor and ceil of p * (n + 1)
    counts = words.groupBy(by, "w").agg(F.count("*").alias("c"))
    run = Window.partitionBy(by).orderBy("w")
    steps = counts.withColumn("upto", F.sum("c").over(run))
    array = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("upto", "w"))).alias("s"), F.sum("c").alias("total"))
    value = lambda place: F.get(F.filter("s", lambda x: x["upto"] >= place), F.lit(0))["w"]
    at = lambda i: F.greatest(F.lit(1.0), F.least(F.col("total") - 1.0, F.floor(i * (F.col("total") + 1) / 10).cast("double")))
    decile = lambda i: value(at(i)) + (value(at(i) + 1) - value(at(i))) * (i * (F.col("total") + 1) / 10 - at(i))
    deciles = array.select(by, F.when(F.col("total") >= 10, F.array(*[F.round(decile(i), 1) for i in range(1, 10)])).otherwise(F.array().cast("array<double>")).alias("deciles"))
    names = [*per.columns, "deciles"]
    deciles = deciles.withColumnRenamed(by, "_by")
    return per.join(deciles, F.col(by).eqNullSafe(F.col("_by"))).select(names)


def distribution_gate(report: DataFrame, target: int, median: tuple[float, float], least_stdev: float, least_distinct: int) -> DataFrame:
    """Which of the four conditions each group of a length report meets."""
    by = report.columns[0]
    return report.select(by, (F.col("n") >= target).alias("enough"), F.col("median").between(*median).alias("median_ok"), (F.col("stdev") >= least_stdev).alias("spread_ok"), (F.col("distinct_lengths") >= least_distinct).alias("varied"))


def select_mentions(chunks: DataFrame, qids: list[str], evidence) -> DataFrame:
    """(chunk_id, text, mention): the best mention of each chunk, by its scores in order of the sources; the first of equals.

    evidence: a function of a scores struct to a boolean Column. Mentions without offsets, of blank or pronoun surface don't count."""
    surface = lambda m: F.trim(F.coalesce(m["text_mention"], F.lit("")))
    fit = lambda m: (surface(m) != "") & ~F.lower(surface(m)).isin(*T.NO_ANCHOR) & m["char_start"].isNotNull() & m["char_end"].isNotNull()
    score = lambda c: F.struct(*[F.coalesce(c["scores_by_source"][s], F.lit(0.0)).alias(s) for s in ("hyperlinks", "entity_linking", "coref", "coref_cluster")])
    best = lambda m: F.array_max(F.transform(F.filter(m["candidates"], lambda c: c["qid"].isin(*qids) & evidence(c["scores_by_source"])), score))
    ranked = F.transform("entities", lambda m, i: F.when(fit(m) & best(m).isNotNull(), F.struct(best(m).alias("score"), (-i).alias("first"), m.alias("mention"))))
    found = F.array_max(F.transform(F.filter(ranked, lambda x: x.isNotNull()), lambda x: F.struct(x["score"], x["first"])))
    return chunks.withColumn("_best", found).withColumn("mention", F.when(F.col("_best").isNotNull(), F.element_at("entities", (1 - F.col("_best")["first"]).cast("int")))).drop("_best")


def harvest(mentioned: DataFrame, splitter=T.split_sentences) -> DataFrame:
    """(chunk_id, sentence, reason): the sentence around each chunk's mention, or which gate the chunk didn't pass."""
    m, text = F.col("mention"), F.coalesce("text", F.lit(""))
    cut = mentioned.withColumn("_s", splitter("text"))
    around = F.get(F.filter("_s", lambda s: (s["start"] <= m["char_start"]) & (m["char_end"] <= s["end"])), F.lit(0))
    a, b = m["char_start"], m["char_end"]
    off = (a < 0) | (a >= b) | (b > F.length(text)) | (F.trim(text.substr(a + 1, b - a)) != F.trim(m["text_mention"]))
    reason = (
        F.when(F.trim(text) == "", "empty_text").when(m.isNull(), "no_qualifying_mention").when(F.size("_s") == 0, "no_sentences").when(off, "offset_mismatch")
        .when(around.isNull(), "mention_outside_spans").when(T.is_truncated(around, text), "truncated_span").otherwise("ok")
    )
    return cut.select("chunk_id", F.when(reason == "ok", around["sentence"]).alias("sentence"), reason.alias("reason"))
