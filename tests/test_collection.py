"""Collections: layout that a search by fields profits from, and what a probe says."""

import pytest
from lodestone.operators import collection, query, retrieval
from lodestone.plans import collection_queries


def scan_metrics(df):
    """(files, rows) of the scan of an executed plan."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec":
            m = p.metrics()
            out.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    return out[0]


@pytest.fixture(scope="module")
def path(spark, sf):
    return collection_queries.created(spark, sf)


def test_a_field_query_reads_the_folders_that_can_match(spark, path):
    points = collection.points(spark, path)
    whole = scan_metrics(points)
    one = scan_metrics(retrieval.filter_only(points, query.predicate(query.parse("source_type:git project_id:fr")), 100))
    assert whole[1] == 200 and 0 < one[0] < whole[0] / 5 and one[1] < 30
    got = retrieval.filter_only(points, query.predicate(query.parse("document_id:doc-14")), 100).collect()
    assert [r.doc_id for r in got] == [14]
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(points.where("document_id = 'doc-14'")._jdf.queryExecution(), "formatted")
    assert "EqualTo(document_id,doc-14)" in plan


def test_probe(spark, path, tmp_path):
    c = collection.probe(spark, path)
    assert c.hybrid_ready and c.vector_size == 64 and c.indexed == tuple(collection.INDEXED)
    assert not collection.probe(spark, path, sparse_name="other").hybrid_ready
    assert collection.probe(spark, str(tmp_path / "none")) == collection.Capabilities(False, False, None, ())
    df = spark.createDataFrame([("d1", [1.0, 2.0], [("a", 1.0)]), ("d2", None, None)], "document_id string, dense array<double>, sparse array<struct<t: string, w: double>>")
    at = str(tmp_path / "c")
    assert collection.create(df, at, 2, sparse=False) and not collection.create(df, at, 2)
    c = collection.probe(spark, at)
    assert c.has_named_dense and not c.has_sparse and collection.points(spark, at).count() == 2
    with pytest.raises(ValueError, match="2 entries"):
        collection.create(df, str(tmp_path / "d"), 3)
    assert not collection.exists(spark, str(tmp_path / "d"))
