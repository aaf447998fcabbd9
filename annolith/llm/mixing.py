"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: the total size is shared among the sources by weight; no source gets
more than `epochs` times its size, and what is above is reshared by weight.
That is one water level: a source gets the smaller of its cap and weight times
level.  With the sources in order of cap / weight the level is closed-form from
a prefix sum of caps and a suffix sum of weights, so no loop is needed.

Sampling: a source's target is a whole number of repetitions of all its
documents and a rest of words.  The rest is taken from the documents in seeded
order, the last one in part, so that the words taken are the target's.  Running
sums within a source are over hash bins, then within a bin: no task sees a
whole source, however large its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def water_levels(sources: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size) -> also weight and target. One row per source, so the windows here see as many rows as there are sources.

    Sources in code point order, null last, have the given weights in turn. If all sizes are 0, so are the targets."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    w = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * epochs)
    ranked = w.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("rank", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level).withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(all_rows))
    return found.select("source", "source_size", "weight", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double")).alias("target"))


OUT = ("size", "source_size", "target", "taken", "whole_repeats")


def mix_sources(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target (its source's), taken (words the mix takes, repeats counted) and whole_repeats.

    No document is taken more than `epochs` times its size, and each source's taken words are its target, rounded.
    Null texts have size 0; a null source is a source; rows that repeat an id are documents of their own. The draw
    depends on the seed, the ids and the sizes alone, so reruns agree. Columns of docs with the names of the result's
    are replaced. An empty table gives an empty result."""
    docs = docs.drop(*[c for c in OUT if c in docs.columns and c not in (id_col, text_col, source_col)])
    return mix_sized(docs.withColumn("_mix_size", word_count(F.col(text_col))), epochs, weights, seed, id_col, source_col)


def mix_sized(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """As mix_sources(), of rows whose sizes are counted already, in _mix_size; that column is left out of the result."""
    sized = docs.withColumn("_mix_draw", F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")))).withColumn("_mix_bin", F.substring("_mix_draw", 1, 3))
    docs = docs.drop("_mix_size")
    bins = sized.groupBy(F.col(source_col).alias("source"), F.col("_mix_bin").alias("bin")).agg(F.sum("_mix_size").alias("n"))
    levels = water_levels(bins.groupBy("source").agg(F.sum("n").alias("source_size")), epochs, weights)
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = starts.alias("b").join(levels.alias("l"), F.col("b.source").eqNullSafe(F.col("l.source"))).select(F.col("b.source").alias("_mix_source"), F.col("bin").alias("_mix_bin2"), F.col("start").alias("_mix_start"), "source_size", "target", whole.alias("whole_repeats"))
    plan = plan.withColumn("_mix_rest", F.floor(F.col("target") - F.col("whole_repeats") * F.col("source_size") + F.lit(0.5)).cast("long"))
    joined = sized.join(plan, F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bin") == F.col("_mix_bin2")))
    inside = Window.partitionBy("_mix_source", "_mix_bin2").orderBy("_mix_draw", id_col, "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_mix_start") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("_mix_size"), F.col("_mix_rest") - at))
    out = joined.withColumn("size", F.col("_mix_size")).withColumn("taken", F.col("whole_repeats") * F.col("_mix_size") + part)
    return out.select(*docs.columns, *OUT)
