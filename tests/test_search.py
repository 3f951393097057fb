from lodestone.operators import fusion, graph, search
from lodestone.plans.model import results
from lodestone.plans.retrieval_queries import whole_batch as batch
from pyspark.sql import functions as F


def test_tools(spark, sf):
    docs, q = results(spark, sf), batch(spark, sf)
    for mode in ("wrrf", "keyword"):
        hits = search.search(docs, q, 5, mode).collect()
        assert hits and max(r["rank"] for r in hits) <= 5
    assert {r.source_type for r in search.hierarchy_search(docs, q, 5).collect()} <= {"confluence", "localfile"}
    members = search.cluster_documents(docs, "hierarchy", 3)
    name = members.first().cluster
    assert search.expand_cluster(members, name, 1, 2).count() <= 2
    assert search.answer_json(members.limit(1)).first().json.startswith("{")


def test_fusion_numbers(spark):
    v = spark.createDataFrame([(1, 10, 0.8)], "query_id long, doc_id long, score double")
    k = spark.createDataFrame([(1, 10, 0.6), (1, 11, 0.4)], "query_id long, doc_id long, score double")
    got = {r.doc_id: r.score for r in fusion.combined(v, k, 0.6, 0.3, 0.3).collect()}
    assert got == {10: 0.66}  # 0.12 falls below the threshold


def test_diversity_prefers_other_sources(spark):
    rows = [(1, k, 1.0 - k / 100, "git" if k < 8 else "jira", "h1", "s1" if k < 8 else f"s{k}") for k in range(12)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double, source_type string, section_type string, source string")
    got = [r.doc_id for r in fusion.diversify(df, 0.6, 10).collect()]
    assert len(got) == 10 and set(range(7)) <= set(got) and 8 in got


def test_iterative_graphs(spark):
    e = spark.createDataFrame([(1, 3, "x", 1.0), (2, 3, "x", 1.0), (3, 4, "x", 1.0), (8, 9, "x", 1.0)], "src long, dst long, kind string, weight double")
    nodes = spark.range(1, 10).withColumnRenamed("id", "node")
    rank = {r.node: r["rank"] for r in graph.page_rank(nodes, e, 4).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-6 and rank[4] > rank[3] > rank[1]
    h = {r.node: r for r in graph.hits(e, 2).collect()}
    assert h[3].authority > h[4].authority and h[1].hub > h[8].hub
    assert {r.node: r.component for r in graph.weak_components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_metadata_redaction(spark):
    df = spark.createDataFrame([({"_x": "1", "api_key": "k", "title": "t"},)], "md map<string,string>")
    assert df.select(search.redact_metadata(F.col("md")).alias("m")).first().m == {"api_key": "***", "title": "t"}
