from lodestone.streaming import ingest
from pyspark.sql import functions as F

from lodestone.session import table


def test_rates_match_batch(spark, sf, tmp_path):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_changes(spark, f"{tmp_path}/in", e.schema)
    got = ingest.run_available(ingest.rates(stream, "ts", "event_type"), "rates", f"{tmp_path}/cp", "complete")
    want = e.groupBy(F.window("ts", "5 minutes").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert got.select("start", "event_type", "n").exceptAll(want).count() == 0 and got.count() == want.count()


def test_duplicates_count_once(spark, sf, tmp_path):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).limit(50)
    e.union(e).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_changes(spark, f"{tmp_path}/in", e.schema)
    assert ingest.run_available(ingest.once(stream, "event_id", "ts"), "once", f"{tmp_path}/cp").count() == 50


def test_dispatch(spark, sf, tmp_path):
    d = table(spark, sf, "documents")
    d.write.parquet(f"{tmp_path}/in")
    op = F.when(F.col("doc_id") % 10 == 0, "SINGLE_DELETE").otherwise("SINGLE_UPSERT")
    q = ingest.read_changes(spark, f"{tmp_path}/in", d.schema).writeStream.foreachBatch(ingest.dispatch(f"{tmp_path}/out", op)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/deleted").count() == 20
    assert spark.read.parquet(f"{tmp_path}/out/chunks").select("doc_id").distinct().count() == 180


def test_leases(spark, tmp_path):
    rows = [(1, "started", 1), (1, "done", 2), (2, "started", 1), (2, "failed", 2), (2, "started", 3), (3, "started", 90)]
    df = spark.createDataFrame(rows, "id long, event string, minute int").selectExpr("id", "event", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, minute, 0) AS at")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.read_changes(spark, f"{tmp_path}/in", df.schema)
    got = ingest.run_available(ingest.leases(stream, "id", "at", 600), "leases", f"{tmp_path}/cp", "update").collect()
    assert {(r.id, r.status, r.attempts) for r in got} == {(1, "done", 1), (2, "running", 2), (2, "expired", 2), (3, "running", 1)}
