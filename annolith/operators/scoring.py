"""Scores of paired models: accuracies, margins, ranks, selections, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as X


def group_accuracy(rows: DataFrame, *by: str) -> DataFrame:
    """(is_correct, gold_margin) rows -> n, n_correct, accuracy, mean, deviation and standard error of the margins."""
    sd = F.coalesce(F.stddev_samp("gold_margin"), F.lit(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("is_correct").cast("long").alias("n_correct"), F.avg("is_correct").alias("accuracy"), F.avg("gold_margin").alias("mean_margin"), sd.alias("sd_margin"), (sd / F.sqrt(F.count("*"))).alias("se_margin"), F.sum(F.isnan("gold_margin").cast("long")).alias("n_nonfinite"))


def option_arrays(options: DataFrame, *values: str) -> DataFrame:
    """One row a question, each value an array in order of the options."""
    per = options.groupBy("question_id").agg(F.first("gold_index").alias("gold_index"), F.array_sort(F.collect_list(F.struct("option_index", *values))).alias("o"))
    return per.select("question_id", "gold_index", *[F.col(f"o.{v}").alias(v) for v in values])


def predictions(options: DataFrame, score: str) -> DataFrame:
    """(question_id, predicted, is_correct, n_ties, gold_margin): the first option of the best score, and how clear it was."""
    q, a = option_arrays(options, score), F.col(score)
    ties = F.size(F.filter(a, lambda x: x == F.array_max(a)))
    return q.select("question_id", X.argmax(a).alias("predicted"), (X.argmax(a) == F.col("gold_index")).cast("int").alias("is_correct"), ties.alias("n_ties"), X.margin(a, F.col("gold_index")).alias("gold_margin"))


def rank_candidates(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """rows with rank and selected (rank 1) within `by`. order: a total order, best first."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", r).withColumn("selected", F.col("rank") == 1)


def tie_log(ranked: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Pairs of neighbours in rank that agree on all keys."""
    w = Window.partitionBy(*by).orderBy("rank")
    nxt = F.lead(F.struct("label", *keys)).over(w)
    same = [F.col(k).eqNullSafe(F.col(f"_next.{k}")) for k in keys]
    out = ranked.withColumn("_next", nxt).filter(F.col("_next").isNotNull())
    for s in same:
        out = out.filter(s)
    return out.select(*by, "rank", "label", F.col("_next.label").alias("next_label"))


#: Kinds of candidate labels, family_topic_parameters: a delta (d0.35), a layer, band and strength (L9mid_a250), a selection and side (ratio_in).
FAMILIES = {"mf": ("MF", "delta"), "rmu": ("RMU", "layered"), "snmf": ("SNMF", "sided")}


def parse_config(label: Column, families: dict[str, tuple[str, str]] = FAMILIES) -> Column:
    """A candidate's label as (method, topic, tie-break); null if its family isn't known.

    families: method name and kind by family. The tie-break orders milder candidates first: the smaller delta; the
    lower layer, the middle band, the smaller strength; ratio before other selections, in before out before both."""
    part = lambda i: F.get(F.split(label, "_"), F.lit(i))
    fam = F.lower(part(0))
    layer, band = F.regexp_extract(part(2), r"^L(\d+)(hi|mid)", 1), F.regexp_extract(part(2), r"^L(\d+)(hi|mid)", 2)
    number = lambda x: F.coalesce(F.substring(x, 2, 30).try_cast("double"), F.lit(0.0))
    side = F.coalesce(part(3), F.lit(""))
    key = lambda a, b, c: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))
    zero = F.lit(0.0)
    kinds = {
        "delta": key(number(part(2)), zero, zero),
        "layered": key(F.coalesce(layer.try_cast("int"), F.lit(0)), F.when(band == "mid", 0).otherwise(1), number(part(3))),
        "sided": key(F.when(part(2) == "ratio", 0).otherwise(1), F.when(side == "in", 0).when(side == "out", 1).when(side == "both", 2).otherwise(9), zero),
    }
    cases = [F.when(fam == f, F.struct(F.lit(method).alias("method"), part(1).alias("topic"), kinds[kind].alias("tiebreak"))) for f, (method, kind) in families.items()]
    return F.coalesce(*cases)


def selection_table(acc: DataFrame, full: DataFrame) -> DataFrame:
    """Accuracies (topic, method, label, target, neighbour, unrelated) and the full model's (topic, full_*) -> normalised values and the score h; null where the full model isn't over chance."""
    j = acc.join(full, "topic")
    n = {g: X.chance_normalised(F.col(g), F.col(f"full_{g}")) for g in ("target", "neighbour", "unrelated")}
    return j.select("topic", "method", "label", *[n[g].alias(f"norm_{g}") for g in n], X.retention_score(n["target"], n["neighbour"], n["unrelated"]).alias("h"))


def signed_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    x = F.col(value)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_samp(x).alias("sd"), F.avg((x > 0).cast("double")).alias("frac_pos"), F.avg((x < 0).cast("double")).alias("frac_neg"))


def paired_distances(rows: DataFrame, *by: str) -> DataFrame:
    """(nll_full, nll_twin, nll_edited) -> how near the edited model comes to the twin, against the full model's distance."""
    dm, df = F.abs(F.col("nll_edited") - F.col("nll_twin")), F.abs(F.col("nll_full") - F.col("nll_twin"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(dm).alias("d_abs_m_t"), F.avg(df).alias("d_abs_f_t"), F.try_divide(F.avg(dm), F.avg(df)).alias("r_abs"), F.avg((dm < df).cast("double")).alias("p_closer"), F.avg((dm == df).cast("double")).alias("p_tied"))


def paired_join(models: dict[str, DataFrame], key: str, value: str, check: str | None = None) -> DataFrame:
    """One row a key that all models have, with <model>_<value>; rows whose `check` differs between models raise when read."""
    out: DataFrame | None = None
    for name, df in models.items():
        side = df.select(key, F.col(value).alias(f"{name}_{value}"), *([F.col(check).alias(f"_{name}_{check}")] if check else []))
        out = side if out is None else out.join(side, key)
    names = list(models)
    if check:
        for other in names[1:]:
            a, b = F.col(f"_{names[0]}_{check}"), F.col(f"_{other}_{check}")
            out = out.withColumn(key, F.when(a.eqNullSafe(b), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{check} differs between {names[0]} and {other} at "), F.col(key).cast("string")))))
        out = out.drop(*[f"_{n}_{check}" for n in names])
    return out


def weighted_perplexity(rows: DataFrame, *by: str) -> DataFrame:
    """(loss, tokens) -> macro and micro mean loss and their perplexities; a text of n tokens weighs n - 1."""
    w = F.col("tokens") - 1
    micro = F.try_divide(F.sum(F.col("loss") * w), F.sum(w))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("loss").alias("macro_loss"), micro.alias("micro_loss"), F.exp(F.avg("loss")).alias("macro_ppl"), F.exp(micro).alias("micro_ppl"))


def dose_buckets(count: Column) -> Column:
    return F.when(count == 0, "0").when(count == 1, "1").when(count <= 3, "2-3").when(count <= 7, "4-7").otherwise("8+")


def best_delta(grid: DataFrame, place: str = "label") -> DataFrame:
    """The row of largest objective, the smallest delta of equals, the least `place` of equals in both; if no objective is over 0, the smallest delta, set to 0."""
    g = grid.withColumn("delta", F.col("delta").cast("double")).filter("delta is not null").withColumn("objective", F.coalesce("objective", F.lit(0.0)))
    row, order = F.struct("label", "delta", "objective"), lambda *first: F.struct(*first, "delta", F.col(place).alias("place"))
    top = g.agg(F.min_by(row, order((-F.col("objective")).alias("objective"))).alias("best"), F.min_by(row, order()).alias("least"), F.max(F.abs("objective")).alias("any"))
    one = F.when(F.col("any") > 0, F.col("best")).otherwise(F.col("least").withField("delta", F.lit(0.0)))
    return top.select(one.alias("x")).select("x.*")


def first_source(trees: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value, source, spread): each key from the first tree that has it, and how far later copies are off."""
    rows = None
    for i, t in enumerate(trees):
        side = t.select(key, F.col(value).alias(value), F.lit(i).alias("source"))
        rows = side if rows is None else rows.unionByName(side)
    per = rows.groupBy(key).agg(F.min_by(value, "source").alias(value), F.min("source").alias("source"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    return per.select(key, value, "source", F.greatest(F.col("_hi") - F.col(value), F.col(value) - F.col("_lo")).alias("spread"))


def keep_last(df: DataFrame, key: str, seq: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return df.withColumn("_r", r).filter("_r = 1").drop("_r")


def keep_first(df: DataFrame, key: str, seq: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("_r", r).filter("_r = 1").drop("_r")


def trimmed(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean without a tenth of the values at either end, median, and share below 0, of each group."""
    w = Window.partitionBy(by)
    ranked = rows.select(by, F.col(value).alias("x")).withColumn("r", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w))
    k = F.floor(F.col("n") / 10)
    inner = F.when((F.col("r") > k) & (F.col("r") <= F.col("n") - k), F.col("x"))
    return ranked.groupBy(by).agg(F.avg(inner).alias("trimmed_mean"), F.percentile("x", 0.5).alias("median"), F.avg((F.col("x") < 0).cast("double")).alias("frac_neg"))


def unique_prefix(stems: DataFrame, texts: DataFrame, key: str, match: str, stem: str = "stem", full: str = "full") -> DataFrame:
    """(key, match) of the stems that exactly one text starts with.

    A text meets the stems by its prefixes of the lengths that stems have: an equi-join, in which lengths, no rows,
    are what every text is combined with."""
    sizes = F.broadcast(stems.agg(F.collect_set(F.length(stem)).alias("_sizes")))
    cuts = texts.crossJoin(sizes).select(match, full, F.explode(F.filter("_sizes", lambda n: n <= F.length(full))).alias("_n"))
    starts = cuts.select(match, F.col(full).substr(F.lit(1), F.col("_n")).alias(stem))
    return stems.select(key, stem).join(starts, stem).groupBy(key).agg(F.count("*").alias("n"), F.max(match).alias(match)).filter("n = 1").drop("n")
