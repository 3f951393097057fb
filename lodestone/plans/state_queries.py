"""State, change detection, sink, job and monitoring queries (K, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import state
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table

# The stored state lacks every 7th document, holds older hashes for every 5th, and has some that are gone.
_STATE = "st AS (SELECT doc_id, coalesce(project_id, 'none') AS project_id, source_type, source, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS content_hash, created_day AS updated_at, doc_id % 13 = 1 AS is_deleted, source_type||':'||source||':'||CAST(doc_id AS VARCHAR) AS uri FROM results WHERE doc_id % 7 <> 0 UNION ALL SELECT 1000000 + doc_id, 'none', source_type, source, 'x', 0, false, 'x' FROM results WHERE doc_id % 50 = 0)"
_SNAP = "sn AS (SELECT doc_id, coalesce(project_id, 'none') AS project_id, source_type, source, md5(text) AS content_hash, created_day + CASE WHEN doc_id % 11 = 3 THEN 1 ELSE 0 END AS updated_at, source_type||':'||CASE WHEN doc_id % 17 = 0 THEN 'moved' ELSE source END||':'||CAST(doc_id AS VARCHAR) AS uri FROM results)"


def stored(spark, sf):
    r = results(spark, sf).withColumn("project_id", F.coalesce("project_id", F.lit("none")))
    s = r.where("doc_id % 7 <> 0").select(
        "doc_id", "project_id", "source_type", "source", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.md5(F.col("text"))).alias("content_hash"),
        F.col("created_day").alias("updated_at"), (F.col("doc_id") % 13 == 1).alias("is_deleted"), F.concat_ws(":", "source_type", "source", F.col("doc_id").cast("string")).alias("uri"),
    )
    gone = r.where("doc_id % 50 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("none").alias("project_id"), "source_type", "source", F.lit("x").alias("content_hash"), F.lit(0).cast("long").alias("updated_at"), F.lit(False).alias("is_deleted"), F.lit("x").alias("uri"))
    return s.unionByName(gone)


def snapshot(spark, sf):
    r = results(spark, sf).withColumn("project_id", F.coalesce("project_id", F.lit("none")))
    moved = F.when(F.col("doc_id") % 17 == 0, F.lit("moved")).otherwise(F.col("source"))
    return r.select("doc_id", "project_id", "source_type", "source", F.md5(F.col("text")).alias("content_hash"), (F.col("created_day") + F.when(F.col("doc_id") % 11 == 3, 1).otherwise(0)).alias("updated_at"), F.concat_ws(":", "source_type", moved, F.col("doc_id").cast("string")).alias("uri"))


@query("state_snapshot_diff", f"""WITH {R}, {_STATE}, {_SNAP}, s AS (SELECT * FROM st WHERE NOT is_deleted) SELECT coalesce(s.doc_id, sn.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN sn.doc_id IS NULL THEN 'deleted' WHEN s.content_hash <> sn.content_hash OR sn.updated_at > s.updated_at THEN 'updated' ELSE 'unchanged' END AS change FROM s FULL JOIN sn ON s.doc_id = sn.doc_id""")
def snapshot_diff(spark, sf):
    return state.diff(stored(spark, sf), snapshot(spark, sf), "doc_id")


@query("state_reconcile_deletions", f"WITH {R}, {_STATE}, {_SNAP} SELECT doc_id FROM st WHERE NOT is_deleted AND doc_id NOT IN (SELECT doc_id FROM sn)")
def reconcile(spark, sf):
    return state.diff(stored(spark, sf), snapshot(spark, sf), "doc_id").where("change = 'deleted'").select("doc_id")


@query("state_classify_batch", f"""WITH {R}, {_STATE}, {_SNAP}, j AS (SELECT sn.doc_id, CASE WHEN st.doc_id IS NULL THEN 'new' WHEN st.uri <> sn.uri THEN 'moved' WHEN st.content_hash <> sn.content_hash THEN 'updated' END AS change FROM sn LEFT JOIN st ON st.doc_id = sn.doc_id AND st.source_type = sn.source_type AND st.source = sn.source) SELECT doc_id, change FROM j WHERE change IS NOT NULL""")
def classify_batch(spark, sf):
    return state.classify(stored(spark, sf), snapshot(spark, sf), ("source_type", "source", "doc_id")).select("doc_id", "change")


@query("state_tombstones", f"WITH {R}, {_STATE} SELECT uri, source_type, source, CAST(doc_id AS VARCHAR) AS url, true AS is_deleted FROM st WHERE is_deleted")
def tombstones(spark, sf):
    s = stored(spark, sf)
    return state.tombstones(s, s.where("is_deleted").select("uri"))


@query("state_upsert", f"WITH {R}, {_STATE}, {_SNAP}, n AS (SELECT doc_id, content_hash, updated_at FROM sn WHERE doc_id % 3 = 0) SELECT doc_id, content_hash, updated_at FROM n UNION ALL SELECT doc_id, content_hash, updated_at FROM st WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def upsert(spark, sf):
    cols = ["doc_id", "content_hash", "updated_at"]
    batch = snapshot(spark, sf).where("doc_id % 3 = 0").select(*cols)
    twice = batch.withColumn("v", F.lit(1)).unionByName(batch.withColumn("content_hash", F.lit("early")).withColumn("v", F.lit(0)))
    return state.upsert(stored(spark, sf).select(*cols), twice, ("doc_id",), [F.desc("v")])


@query("state_delete_points", f"WITH {R}, {_STATE} SELECT doc_id FROM st WHERE doc_id NOT IN (SELECT doc_id FROM results WHERE is_attachment)")
def delete_points(spark, sf):
    return state.delete(stored(spark, sf), results(spark, sf).where("is_attachment").select("doc_id"), ("doc_id",)).select("doc_id")


@query("state_soft_delete", f"WITH {R}, {_STATE} SELECT doc_id, is_deleted OR doc_id % 8 = 0 AND doc_id < 1000000 AS is_deleted FROM st")
def soft_delete(spark, sf):
    return state.soft_delete(stored(spark, sf), results(spark, sf).where("is_attachment"), ("doc_id",)).select("doc_id", "is_deleted")


@query("state_duplicate_chunks", """WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS chunk_id FROM lineitem WHERE l_quantity >= 25), s AS (SELECT CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS chunk_id FROM lineitem WHERE l_quantity < 3),
 bad AS (SELECT DISTINCT document_id FROM b WHERE chunk_id IN (SELECT chunk_id FROM s) OR chunk_id IN (SELECT chunk_id FROM b GROUP BY 1 HAVING count(*) > 1)) SELECT DISTINCT document_id FROM b WHERE document_id NOT IN (SELECT document_id FROM bad)""")
def duplicate_chunks(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("chunk_id"), "l_quantity")
    return state.duplicate_chunks(li.where("l_quantity < 3").select("chunk_id"), li.where("l_quantity >= 25").drop("l_quantity"))[1]


_RUNS = "r AS (SELECT event_type AS source, ts AS finished_at, CASE WHEN value > 40 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CAST(user_id % 4 AS BIGINT) AS document_count FROM events)"


def runs(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("finished_at"), F.when(F.col("value") > 40, "FAILED").otherwise("SUCCESS").alias("status"), (F.col("user_id") % 4).alias("document_count"))


@query("state_incremental_since", f"WITH {_RUNS} SELECT source, max(finished_at) AS last, max(finished_at) - INTERVAL 5 MINUTES AS since FROM r WHERE status = 'SUCCESS' GROUP BY source")
def incremental_since(spark, sf):
    return state.since(runs(spark, sf), "source")


@query("state_ingestion_history", f"""WITH {_RUNS}, l AS (SELECT source, arg_max(status, finished_at) AS s, arg_max(document_count, finished_at) AS c, max(finished_at) AS a FROM r GROUP BY 1), o(source, status, finished_at, document_count) AS (VALUES ('click', 'SUCCESS', TIMESTAMP '2020-01-01', 7), ('gone', 'FAILED', TIMESTAMP '2020-01-02', 3))
SELECT source, coalesce(s, status) AS status, CASE WHEN finished_at IS NULL OR s = 'SUCCESS' THEN coalesce(a, finished_at) ELSE finished_at END AS finished_at, CAST(CASE WHEN coalesce(c, 0) > 0 THEN c ELSE coalesce(document_count, 0) END AS BIGINT) AS document_count FROM o FULL JOIN l USING (source)""")
def ingestion_history(spark, sf):
    old = spark.sql("SELECT * FROM VALUES ('click', 'SUCCESS', TIMESTAMP '2020-01-01', 7L), ('gone', 'FAILED', TIMESTAMP '2020-01-02', 3L) AS t(source, status, finished_at, document_count)")
    out = state.ingestion_history(old, runs(spark, sf), ("source",))
    return out.withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))


@query("state_project_statistics", f"WITH {R}, {_STATE} SELECT project_id, CAST(sum(CASE WHEN NOT is_deleted THEN 1 ELSE 0 END) AS BIGINT) AS documents, CAST(count(DISTINCT source) AS BIGINT) AS sources, max(updated_at) AS latest FROM st GROUP BY 1")
def project_statistics(spark, sf):
    return state.project_statistics(stored(spark, sf))


@query("state_project_collections", f"WITH {R} SELECT coalesce(project_id, 'none') AS project_id, max(source) AS collection FROM results GROUP BY 1")
def project_collections(spark, sf):
    return results(spark, sf).groupBy(F.coalesce("project_id", F.lit("none")).alias("project_id")).agg(F.max("source").alias("collection"))


@query("state_config_changes", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3 OR s_suppkey % 6 = 1")
def config_changes(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    old = s.where("s_suppkey % 10 <> 3").withColumn("s_name", F.when(F.col("s_suppkey") % 6 == 1, F.lit("before")).otherwise(F.col("s_name")))
    return state.config_changes(old, s, "s_suppkey")


@query("state_points_projection", f"WITH {R} SELECT document_id AS id, coalesce(parent_id, document_id) AS document_id, source_title AS title, source_url AS url, lower(source_type) AS source_type FROM results")
def points_projection(spark, sf):
    return results(spark, sf).select(F.col("document_id").alias("id"), F.coalesce("parent_id", "document_id").alias("document_id"), F.col("source_title").alias("title"), F.col("source_url").alias("url"), F.lower("source_type").alias("source_type"))


_JOBS = """j AS (SELECT event_id AS id, event_type AS type, CAST(user_id % 20 AS BIGINT) AS source, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'done' ELSE 'pending' END AS status, ts AS enqueued_at, CAST(event_id % 6 AS BIGINT) AS attempts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS visible_at FROM events)"""
_NOW = "TIMESTAMP '2024-01-02 00:00:00'"


def jobs(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        i.alias("id"), F.col("event_type").alias("type"), (F.col("user_id") % 20).alias("source"), F.when(i % 3 == 0, "running").when(i % 7 == 0, "done").otherwise("pending").alias("status"),
        F.col("ts").alias("enqueued_at"), (i % 6).alias("attempts"), F.when(i % 4 != 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("visible_at"),
    )


def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-02 00:00:00'")


_CLAIM = f"(status = 'pending' AND (visible_at IS NULL OR visible_at <= {_NOW}) OR status = 'running' AND visible_at < {_NOW})"


@query("jobs_claim", f"WITH {_JOBS}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY enqueued_at, id) AS r FROM j WHERE {_CLAIM}) SELECT id, 'running' AS status, attempts + 1 AS attempts FROM c WHERE r = 1 ORDER BY enqueued_at, id LIMIT 10")
def jobs_claim(spark, sf):
    return state.claim(jobs(spark, sf), now(), 10, 300, "source").select("id", "status", "attempts")


@query("jobs_finish", f"""WITH {_JOBS}, o AS (SELECT id, attempts - CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS a, id % 2 = 0 AS ok FROM j WHERE id % 5 = 0), m AS (SELECT j.*, coalesce(status = 'running' AND o.a = attempts, false) AS mine, ok FROM j LEFT JOIN o USING (id))
SELECT id, CASE WHEN mine AND ok THEN 'done' WHEN mine AND attempts < 5 THEN 'pending' WHEN mine THEN 'failed' ELSE status END AS status, CASE WHEN mine AND NOT ok AND attempts < 5 THEN {_NOW} + to_microseconds(CAST(30000000 * pow(2, attempts - 1) AS BIGINT)) WHEN mine THEN NULL ELSE visible_at END AS visible_at FROM m""")
def jobs_finish(spark, sf):
    j = jobs(spark, sf)
    o = j.where("id % 5 = 0").select("id", (F.col("attempts") - F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("attempts"), (F.col("id") % 2 == 0).alias("ok"))
    return state.finish(j, o, now()).select("id", "status", "visible_at")


@query("jobs_enqueue", f"""WITH {_JOBS} SELECT id, status, attempts, CAST(NULL AS VARCHAR) AS payload_json FROM j UNION ALL SELECT CAST(100000000 + doc_id AS BIGINT), 'pending', 0, '{{"lang":"' || lang || '","source":"' || source || '"}}' FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def jobs_enqueue(spark, sf):
    d = table(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    asked = d.select((F.col("doc_id") + 100000000).alias("id"), F.lit("ingest").alias("type"), (F.col("doc_id") % 20).alias("source"), F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("payload"))
    return state.enqueue(jobs(spark, sf), asked, now()).select("id", "status", "attempts", "payload_json")


@query("jobs_extend_lease", f"WITH {_JOBS} SELECT id, CASE WHEN status = 'running' AND id % 5 = 0 AND id % 10 <> 0 THEN {_NOW} + INTERVAL 300 SECONDS ELSE visible_at END AS visible_at FROM j")
def jobs_extend_lease(spark, sf):
    j = jobs(spark, sf)
    held = j.where("id % 5 = 0").select("id", (F.col("attempts") - F.when(F.col("id") % 10 == 0, 1).otherwise(0)).alias("attempts"))
    return state.extend_lease(j, held, now(), 300).select("id", "visible_at")


@query("jobs_reset", f"WITH {_JOBS} SELECT id, CASE WHEN status = 'done' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'done' THEN 0 ELSE attempts END AS attempts, CASE WHEN status <> 'done' THEN visible_at END AS visible_at FROM j")
def jobs_reset(spark, sf):
    return state.reset(jobs(spark, sf)).select("id", "status", "attempts", "visible_at")


@query("jobs_list", f"WITH {_JOBS} SELECT id, status FROM j WHERE status = 'pending' ORDER BY enqueued_at DESC, id LIMIT 20 OFFSET 40")
def jobs_list(spark, sf):
    return jobs(spark, sf).where("status = 'pending'").orderBy(F.desc("enqueued_at"), "id").offset(40).limit(20).select("id", "status")


@query("jobs_schedule", f"WITH {_JOBS} SELECT DISTINCT CAST(user_id AS BIGINT) AS source FROM events WHERE user_id NOT IN (SELECT source FROM j WHERE status IN ('pending', 'running') AND enqueued_at > TIMESTAMP '2024-01-01 12:00:00')")
def jobs_schedule(spark, sf):
    sources = table(spark, sf, "events").select(F.col("user_id").alias("source")).distinct()
    return state.due_sources(sources, jobs(spark, sf).where("enqueued_at > TIMESTAMP_NTZ '2024-01-01 12:00:00'"), "source")


@query("monitor_rate_limit", "SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS in_window, count(*) OVER w > 3 AS refused FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW)")
def rate_limit(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return state.rate_limited(e, "user_id", "ts", 3600, 3).select("event_id", "in_window", "refused")


@query("monitor_batch_summary", "SELECT source, CAST(count(*) AS BIGINT) AS total, round(100 * avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END), 4) AS success_rate, min(n_chars) AS smallest, max(n_chars) AS largest, round(avg(n_chars), 4) AS mean, round(median(n_chars), 4) AS median FROM documents GROUP BY 1")
def batch_summary(spark, sf):
    return state.batch_summary(table(spark, sf, "documents"), "source", "n_chars", F.col("n_chars") > 500)


@query("monitor_rates", "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def rates(spark, sf):
    return state.rates(table(spark, sf, "events"), "ts", "event_type")


@query("monitor_conversion_metrics", f"WITH {R} SELECT file_type, CAST(sum(is_converted::INT) AS BIGINT) AS converted, CAST(count(*) AS BIGINT) AS n, CAST(sum(is_attachment::INT) AS BIGINT) AS attachments FROM results GROUP BY 1")
def conversion_metrics(spark, sf):
    yes = lambda c: F.sum(F.col(c).cast("int"))
    return results(spark, sf).groupBy("file_type").agg(yes("is_converted").alias("converted"), F.count(F.lit(1)).alias("n"), yes("is_attachment").alias("attachments"))


@query("change_event_parse", """SELECT event_id, CASE event_type WHEN 'error' THEN 'SINGLE_DELETE' WHEN 'view' THEN 'FULL_SCAN' ELSE 'SINGLE_UPSERT' END AS operation, CAST(json_extract(props, '$.k') AS VARCHAR) AS entity_id FROM events""")
def change_event_parse(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "SINGLE_DELETE").when(F.col("event_type") == "view", "FULL_SCAN").otherwise("SINGLE_UPSERT")
    return e.select("event_id", op.alias("operation"), F.get_json_object("props", "$.k").alias("entity_id"))
