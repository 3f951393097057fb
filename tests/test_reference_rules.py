"""Rules of clusters, complements, jobs, JSON profiles and change batches on small rows."""

from lodestone import storage
from lodestone.functions import json_profile
from lodestone.operators import similarity, state
from lodestone.streaming import ingest
from pyspark.sql import functions as F
import pytest


def test_profile_of_nested_values():
    value = {"a": [1, 2.5, {"b": None, "c": True}], "d": "x", "e": {}}
    depth, elements, complexity, types = json_profile.profile_of(value)
    inner = 1 + 0.5 * (0.1 + 0.1)
    assert (depth, elements) == (3, 9)
    assert abs(complexity - (1 + 0.5 * ((1 + 0.3 * (0.1 + 0.1 + inner)) + 0.1 + 1))) < 1e-12
    assert types == {"object": 3, "array": 1, "number": 2, "null": 1, "boolean": 1, "string": 1}


def test_profile_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, "7"), (4, "[]"), (5, "[" * 300 + "]" * 300)], "id long, t string")
    got = {r.id: (r.depth, r.elements) for r in json_profile.profile(df, "id", F.col("t")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (0, 1), 4: (0, 1), 5: (299, 300)}


def test_cluster_keys(spark):
    rows = [(["B", "a ", "b", "c", "d", "c"], ["t2", "t1", "t0"], "p"), ([], ["x"], None), (["  "], [], "q")]
    df = spark.createDataFrame(rows, "entities array<string>, topics array<string>, project_id string").withColumn("breadcrumb_text", F.lit(None).cast("string"))
    key = lambda s: [r[0] for r in df.select(similarity.cluster_key(df, s)).collect()]
    assert key("entities") == ["a|b|c", None, None]
    assert key("topics") == ["t0|t1|t2", "x", None]
    assert key("mixed") == key("no such strategy") == ["entities:B,a |topics:t2,t1|project:p", "topics:x|project:no_project", "entities:  |project:q"]


def test_enqueue_sorts_the_payload(spark):
    jobs = spark.createDataFrame([(1, "t", 0, "done", None, 2, None)], "id long, type string, source long, status string, enqueued_at timestamp, attempts long, visible_at timestamp")
    asked = spark.createDataFrame([(2, "ingest", 1, {"z": "1", "a": 'q"'})], "id long, type string, source long, payload map<string,string>")
    new = state.enqueue(jobs, asked, F.current_timestamp()).where("id = 2").first()
    assert (new.status, new.attempts, new.payload_json) == ("pending", 0, '{"a":"q\\"","z":"1"}')
    assert [tuple(r) for r in state.reset(jobs).select("status", "attempts").collect()] == [("pending", 0)]


def test_the_newest_change_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "old text of it", 1), (1, "new text of it", 2), (2, "only", 1)], "doc_id long, text string, at int")
    ingest.dispatch(str(tmp_path), F.lit("SINGLE_UPSERT"), at="at")(df, 0)
    texts = " ".join(str(r.asDict()) for r in spark.read.parquet(f"{tmp_path}/chunks/batch=0").collect())
    assert "new text" in texts and "old text" not in texts and "only" in texts


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Table:
        sparkSession = Fake()

    Fake.sparkContext = Fake()
    with pytest.raises(RuntimeError):
        storage.cut(Table())
