"""Extensions as streams: resumable ingestion and masking with a running count. What they compute is what the batch operators do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_new(stream: DataFrame, sink: str, checkpoint: str, key: str = "id", late: str = "1 hour", time_col: str | None = None):
    """Append rows of unseen key to a Parquet sink; starts where the checkpoint left off.

    With an event time the keys kept are those within the watermark; without one, of each micro-batch those that the
    sink hasn't, so that the state doesn't grow. The query stops when the input at hand is done."""
    if time_col:
        rows = stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark([key])
        return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    from ..sources.files import exists

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key])
        if exists(batch.sparkSession, sink):
            new = new.join(batch.sparkSession.read.parquet(sink).select(key), key, "left_anti")
        new.write.mode("append").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def masked_stream(schedule: DataFrame, excluded: DataFrame) -> DataFrame:
    """A stream of (step, chunk_id) with keep: a stream-static join with the excluded ids."""
    marks = excluded.select("chunk_id", F.lit(True).alias("_out")).distinct()
    return schedule.join(marks, "chunk_id", "left").select("step", "chunk_id", F.col("_out").isNull().alias("keep"))


def exclusion_counts(masked: DataFrame) -> DataFrame:
    """The running number of excluded rows, as a streaming aggregate (output mode complete)."""
    return masked.groupBy("step").agg(F.sum((~F.col("keep")).cast("long")).alias("n_excluded"))


def windowed_counts(events: DataFrame, time_col: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window; rows later than the watermark are left out."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, width), by).agg(F.count("*").alias("n"))
