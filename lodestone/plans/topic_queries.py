"""Topic model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import topics
from lodestone.plans.registry import query
from lodestone.session import table
from lodestone.storage import cut


def blocks(spark, sf):
    return cut(topics.packed_texts(table(spark, sf, "documents"), topics.UPDATES), "blocks")


@query("topic_model_terms", None)
def topic_model_terms(spark, sf):
    t = topics.topic_terms(topics.fit(blocks(spark, sf)))
    return t.select("topic", "rank", "term", F.round("weight", 9).alias("weight"), F.round("coherence", 9).alias("coherence"))


@query("topic_model_documents", None)
def topic_model_documents(spark, sf):
    words = blocks(spark, sf)
    d = topics.document_topics(topics.fit(words), table(spark, sf, "documents"), bags=words)
    return d.withColumn("probability", F.round("probability", 6))
