"""Collections: layout, probe and search by fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import collection, query as understanding, retrieval
from lodestone.plans.model import R, results
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.storage import cut, folder


def created(spark, sf):
    """All results as points with their vectors, where there are some, and sparse weights."""
    r = results(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense"))
    w = retrieval.encode_documents(r, "doc_id", "text").groupBy("doc_id").agg(F.collect_list(F.struct("token", "w")).alias("sparse"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("created_day").cast("int")).cast("string")
    p = r.select("doc_id", "document_id", "project_id", "source_type", "source", F.col("source_title").alias("title"), day.alias("created_at"), "is_attachment", F.col("parent_id").alias("parent_document_id"), F.col("file_type").alias("original_file_type"), "is_converted", "chunk_index")
    path = folder(spark, "collection")
    size = v.select(F.size("dense").alias("n")).first()
    # Written, as dealing points to ranges reads them twice.
    whole = cut(p.join(v, "doc_id", "left").join(w, "doc_id", "left"), "points")
    collection.create(whole, path, size.n if size else collection.VECTOR_SIZE)
    return path


@query("collection_probe", "SELECT true AS has_named_dense, true AS has_sparse, true AS hybrid_ready, CAST(max(len(embedding)) AS INTEGER) AS vector_size, CAST(11 AS INTEGER) AS indexed FROM embeddings")
def collection_probe(spark, sf):
    c = collection.probe(spark, created(spark, sf))
    return spark.createDataFrame([(c.has_named_dense, c.has_sparse, c.hybrid_ready, c.vector_size, len(c.indexed))], "has_named_dense boolean, has_sparse boolean, hybrid_ready boolean, vector_size int, indexed int")


@query("collection_field_query", f"WITH {R} SELECT doc_id, source_type, 1.0::DOUBLE AS score FROM results WHERE source_type = 'confluence' AND chunk_index = 0 AND (project_id IN ('en', 'src3') OR source IN ('en', 'src3')) ORDER BY doc_id LIMIT 100")
def collection_field_query(spark, sf):
    where = understanding.predicate(understanding.parse("source_type:confluence chunk_index:0 colour:red"), ("en", "src3"))
    return retrieval.filter_only(collection.points(spark, created(spark, sf)), where, 100).select("doc_id", "source_type", "score")
