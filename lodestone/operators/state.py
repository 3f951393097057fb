"""State tables, change detection, sinks and jobs as set operations on DataFrames.

A table is never updated row by row: each operator takes the stored table and a
batch and returns the new table (or the rows to write), so the same code runs
over a micro-batch or over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE_KEY = ("project_id", "source_type", "source", "document_id")


def upsert(stored: DataFrame, batch: DataFrame, key: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Stored rows that the batch does not name, and the batch's last row of each key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    new = batch.withColumn("_last", last).where("_last = 1").drop("_last")
    return stored.join(new.select(*key), list(key), "left_anti").select(*stored.columns).unionByName(new.select(*stored.columns))


def delete(stored: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return stored.join(keys, list(key), "left_anti")


def soft_delete(state: DataFrame, gone: DataFrame, key: tuple[str, ...]) -> DataFrame:
    hit = gone.select(*key).distinct().withColumn("_gone", F.lit(True))
    return state.join(hit, list(key), "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).select(*state.columns)


def diff(state: DataFrame, snapshot: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """(key, change): new, updated or unchanged; deleted only where the snapshot is ``complete``.

    Both sides need ``content_hash`` and ``updated_at`` (the source's own time); deleted state rows count as absent.
    """
    s = state.where(~F.col("is_deleted")).select(key, F.col("content_hash").alias("_h"), F.col("updated_at").alias("_u"), F.lit(True).alias("_in_state"))
    d = snapshot.select(key, "content_hash", "updated_at", F.lit(True).alias("_in_snapshot"))
    both = s.join(d, key, "full_outer")
    changed = (F.col("_h") != F.col("content_hash")) | (F.col("updated_at") > F.col("_u"))
    label = F.when(F.col("_in_state").isNull(), "new").when(F.col("_in_snapshot").isNull(), "deleted").when(changed, "updated").otherwise("unchanged")
    out = both.select(key, label.alias("change"))
    return out if complete else out.where(F.col("change") != "deleted")


def classify(state: DataFrame, batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The batch's rows to process: new, moved (another URI) or updated."""
    s = state.select(*key, F.col("uri").alias("_uri"), F.col("content_hash").alias("_hash"), F.lit(True).alias("_known"))
    j = batch.join(s, list(key), "left")
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_uri") != F.col("uri"), "moved").when(F.col("_hash") != F.col("content_hash"), "updated")
    return j.withColumn("change", change).where(F.col("change").isNotNull()).select(*batch.columns, "change")


def tombstones(state: DataFrame, gone: DataFrame) -> DataFrame:
    """Deleted documents rebuilt from their state URI."""
    parts = F.split("uri", ":", 3)
    return state.join(gone, "uri", "left_semi").select("uri", F.get(parts, F.lit(0)).alias("source_type"), F.get(parts, F.lit(1)).alias("source"), F.url_decode(F.get(parts, F.lit(2))).alias("url"), F.lit(True).alias("is_deleted"))


def since(history: DataFrame, *key: str, minutes: int = 5) -> DataFrame:
    """The lower bound of the next incremental pull: five minutes before the last success."""
    last = history.where(F.col("status") == "SUCCESS").groupBy(*key).agg(F.max("finished_at").alias("last"))
    return last.withColumn("since", F.col("last") - F.expr(f"INTERVAL {minutes} MINUTES"))


def duplicate_chunks(stored_ids: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(duplicate chunk ids with their kind, documents that stay successful)."""
    twice = batch.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.lit("same batch").alias("kind"))
    again = batch.join(stored_ids, "chunk_id", "left_semi").select("chunk_id").distinct().withColumn("kind", F.lit("stored"))
    dup = twice.unionByName(again).groupBy("chunk_id").agg(F.min("kind").alias("kind"))
    bad = batch.join(dup, "chunk_id", "left_semi").select("document_id").distinct()
    return dup, batch.select("document_id").distinct().join(bad, "document_id", "left_anti")


def ingestion_history(stored: DataFrame, runs: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """History after a batch of runs: the time moves only on success, a zero count keeps the old one."""
    last = runs.groupBy(*key).agg(F.max_by("status", "finished_at").alias("_status"), F.max_by("document_count", "finished_at").alias("_count"), F.max("finished_at").alias("_at"))
    j = stored.join(last, list(key), "full_outer")
    at = F.when(F.col("finished_at").isNull() | (F.col("_status") == "SUCCESS"), F.coalesce("_at", "finished_at")).otherwise(F.col("finished_at"))
    count = F.when(F.coalesce("_count", F.lit(0)) > 0, F.col("_count")).otherwise(F.coalesce("document_count", F.lit(0)))
    return j.select(*key, F.coalesce("_status", "status").alias("status"), at.alias("finished_at"), count.alias("document_count"))


def project_statistics(state: DataFrame) -> DataFrame:
    return state.groupBy("project_id").agg(
        F.sum(F.when(~F.col("is_deleted"), 1).otherwise(0)).alias("documents"),
        F.countDistinct("source").alias("sources"),
        F.max("updated_at").alias("latest"),
    )


def config_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sources whose configuration hash is new or differs."""
    digest = lambda df: df.select(key, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))).cast("binary"), 256).alias("hash"))
    return digest(new).join(digest(old).withColumnRenamed("hash", "_old"), key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("hash"))).select(key)


# --- Jobs ----------------------------------------------------------------------------------------


def enqueue(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """``jobs`` and new pending ones for (id, type, source, payload map<string,string>): the payload as JSON with sorted keys."""
    payload = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("payload"))))
    new = requests.select("id", "type", "source", F.lit("pending").alias("status"), now.alias("enqueued_at"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("timestamp").alias("visible_at"), payload.alias("payload_json"))
    return jobs.unionByName(new, allowMissingColumns=True)


def extend_lease(jobs: DataFrame, held: DataFrame, now: Column, lease: int) -> DataFrame:
    """A new deadline for running jobs that (id, attempts) still hold; others stay as they are."""
    h = held.select("id", F.col("attempts").alias("_a")).distinct()
    mine = (F.col("status") == "running") & (F.col("_a") == F.col("attempts"))
    return jobs.join(h, "id", "left").withColumn("visible_at", F.when(mine, now + F.expr(f"INTERVAL {lease} SECONDS")).otherwise(F.col("visible_at"))).select(*jobs.columns)


def reset(jobs: DataFrame, statuses: tuple[str, ...] = ("failed", "done")) -> DataFrame:
    """Ended jobs as pending ones without attempts or deadline."""
    ended = F.col("status").isin(*statuses)
    out = jobs.withColumn("visible_at", F.when(~ended, F.col("visible_at"))).withColumn("attempts", F.when(ended, 0).otherwise(F.col("attempts")).cast("long"))
    return out.withColumn("status", F.when(ended, "pending").otherwise(F.col("status")))


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    waiting = (F.col("status") == "pending") & (F.col("visible_at").isNull() | (F.col("visible_at") <= now))
    lost = (F.col("status") == "running") & (F.col("visible_at") < now)
    return jobs.where(waiting | lost)


def claim(jobs: DataFrame, now: Column, n: int, lease: int, serial: str | None = None) -> DataFrame:
    """The oldest ``n`` claimable jobs as running, their lease set; at most one of each ``serial`` group."""
    c = claimable(jobs, now)
    if serial:
        c = c.withColumn("_first", F.row_number().over(Window.partitionBy(serial).orderBy("enqueued_at", "id"))).where("_first = 1").drop("_first")
    return c.orderBy("enqueued_at", "id").limit(n).withColumn("status", F.lit("running")).withColumn("attempts", F.col("attempts") + 1).withColumn("visible_at", now + F.expr(f"INTERVAL {lease} SECONDS"))


def finish(jobs: DataFrame, outcomes: DataFrame, now: Column, most: int = 5, base_seconds: int = 30) -> DataFrame:
    """Apply (id, attempts, ok): fenced by a running row with the same attempt; failures back off, and fail for good after ``most``."""
    o = outcomes.select(F.col("id"), F.col("attempts").alias("_a"), F.col("ok").alias("_ok"))
    j = jobs.join(o, "id", "left")
    mine = (F.col("status") == "running") & (F.col("_a") == F.col("attempts"))
    retry = mine & ~F.col("_ok") & (F.col("attempts") < most)
    delay = F.make_dt_interval(secs=(base_seconds * F.pow(F.lit(2), F.col("attempts") - 1)).cast("decimal(18,6)"))
    status = F.when(mine & F.col("_ok"), "done").when(retry, "pending").when(mine, "failed").otherwise(F.col("status"))
    visible = F.when(retry, now + delay).when(mine, F.lit(None)).otherwise(F.col("visible_at"))
    return j.withColumn("_s", status).withColumn("visible_at", visible).withColumn("status", F.col("_s")).select(*jobs.columns)


def due_sources(sources: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Sources without an active job: what the scheduler enqueues."""
    return sources.join(jobs.where(F.col("status").isin("pending", "running")).select(key), key, "left_anti")


def rate_limited(events: DataFrame, client: str, at: str, seconds: int, most: int) -> DataFrame:
    """Requests with the number of the client's requests in the window that ends with them."""
    t = F.unix_micros(at)
    w = Window.partitionBy(client).orderBy(t).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count(F.lit(1)).over(w)).withColumn("refused", F.col("in_window") > most)


# --- Monitoring ----------------------------------------------------------------------------------


def batch_summary(rows: DataFrame, by: str, size: str, ok: Column) -> DataFrame:
    s = F.col(size)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.round(100 * F.avg(F.when(ok, 1.0).otherwise(0.0)), 4).alias("success_rate"),
        F.min(s).alias("smallest"), F.max(s).alias("largest"), F.round(F.avg(s), 4).alias("mean"), F.round(F.median(s), 4).alias("median"),
    )


def rates(events: DataFrame, at: str, by: str, width: str = "5 minutes") -> DataFrame:
    """Events by tumbling window and group; the same expression serves a stream under a watermark."""
    return events.groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
