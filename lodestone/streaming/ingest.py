"""Incremental ingestion and monitoring with Structured Streaming.

A stream of change events is split by operation in ``foreachBatch``: upserts go
through chunking into the chunk table, deletions become tombstones of the state
table, and the batch's own folder makes a repeated batch overwrite itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators import chunking


def read_changes(spark: SparkSession, path: str, schema, per_trigger: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def rates(stream: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by window and group, late events within the watermark included."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def once(stream: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Events with the same key within the watermark count once."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def dispatch(out: str, operation: Column, key: str = "doc_id", text: str = "text", at: str | None = None):
    """A ``foreachBatch`` function: chunks of upserted rows and tombstones of deleted ones, below ``out``.

    Of several upserts of a key the newest by ``at`` counts (of equals, and without ``at``, the one with the largest text).
    """

    def batch(df: DataFrame, number: int) -> None:
        marked = df.withColumn("_op", operation)
        newest = Window.partitionBy(key).orderBy(*([F.desc_nulls_last(at)] if at else []), F.desc_nulls_last(text))
        upserts = marked.where("_op <> 'SINGLE_DELETE'").withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
        chunks = chunking.chunk(upserts.withColumn("content_type", F.lit("text")), key, text)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        marked.where("_op = 'SINGLE_DELETE'").select(key).distinct().write.mode("overwrite").parquet(f"{out}/deleted/batch={number}")

    return batch


def leases(stream: DataFrame, key: str, at: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """(key, status, attempts): jobs as keyed state. A started job that is not finished before its lease ends, by the
    events' own time, is reported as expired, so another worker can take it. ``stream`` has ``event`` in started,
    done, failed."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("new", 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "status": ["expired"], "attempts": [attempts]})
            return
        seen = pd.concat(list(batches)).sort_values(at, kind="stable")
        for event in seen["event"]:
            attempts += int(event == "started")
            status = "running" if event == "started" else event
        if status == "done":
            if state.exists:
                state.remove()
        else:
            state.update((status, attempts))
            end = int(pd.Timestamp(seen[at].iloc[-1]).timestamp() * 1000) + seconds * 1000
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]], "status": [status], "attempts": [attempts]})

    kind = stream.schema[key].dataType.simpleString()
    timed = stream.withWatermark(at, late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into a memory table (tests and small views)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
