"""The orchestrated search against a plain walk over its own lists."""

import pytest
from lodestone.operators import fusion, query, retrieval, search
from lodestone.plans.model import results
from pyspark.sql import functions as F

ASKED = [
    (1, "How do I fix the api code error in the implementation function endpoint"), (2, "business requirements strategy goals stakeholder"), (3, "the"), (4, "guide"), (5, None), (6, "what is an overview of the definition"),
    (7, "fix error problem issue debug fail now"),
]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, text string")


def test_configs_equal_adapt(spark, asked):
    intents = {r.query_id: (r.primary, r.confidence) for r in query.intents(asked.fillna(""), "query_id", "text").collect()}
    got = {r.query_id: r for r in query.configs(asked).collect()}
    assert set(got) == {q for q, _ in ASKED} and len({g.intent for g in got.values()}) >= 4
    for q, text in ASKED:
        want = query.adapt(*intents[q], len((text or "").split()))
        g = got[q]
        assert (g.wv, g.least, g.most, g.expand, dict(g.preferences)) == (want.vector_weight, want.min_score, want.max_results, want.expand, want.source_preferences)
        assert g.wk == pytest.approx(want.keyword_weight) and g.diversity == pytest.approx(want.diversity)


def plain(docs, asked, vector, keyword, configs, k):
    """{query: [(doc, score)]} before diversity."""
    meta, out = {d["doc_id"]: d for d in docs}, {}
    for q in configs:
        c = configs[q]
        rank = lambda hits: {d: (i, s) for i, (d, s) in enumerate(sorted(((d, s) for p, d, s in hits if p == q), key=lambda x: (-x[1], x[0])), 1)}
        v, w = rank(vector), rank(keyword)
        ids, rows = set(v) | set(w), []
        for d in ids:
            if len(ids) >= 10:
                s, least = (c.wv / (60 + v[d][0]) if d in v else 0) + (c.wk / (60 + w[d][0]) if d in w else 0), c.least * (c.wv + c.wk) / 61
            else:
                s, least = c.wv * v.get(d, (0, 0))[1] + c.wk * w.get(d, (0, 0))[1], c.least
            if round(s, 9) > least:
                m = meta[d]
                factor = min(0.5, m["factor"] + c.confidence * 0.05 + (c.preferences.get(m["source_type"], 1) - 1) * 0.2)
                rows.append((d, round(round(s, 9) * (1 + factor), 9)))
        out[q] = sorted(rows, key=lambda r: (-r[1], r[0]))
    return out


def test_lists_weights_thresholds_and_boosts(spark, sf, asked):
    docs, k, n = results(spark, sf), 15, 40
    where = F.col("source_type") != "jira"
    some = docs.where(where)
    configs = {r.query_id: r for r in query.configs(asked).collect()}
    wide = asked.fillna("").select("query_id", query.expand(F.col("text")).alias("text"))
    vector = [(r.query_id, r.doc_id, r.score) for r in search.vector_leg(some, wide, n, retrieval.hashing_embedder).collect()]
    keyword = [(r.query_id, r.doc_id, r.score) for r in retrieval.bm25(asked.fillna(""), some, n).collect()]
    meta = [r.asDict() for r in some.select("doc_id", "source_type", fusion.boost().alias("factor")).collect()]
    want = plain(meta, asked, vector, keyword, configs, k)
    rows = search.orchestrated(docs, asked, k, where=where, fetch=n).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert r.source_type != "jira" and r.intent == configs[r.query_id].intent
    assert len(got) >= 5
    for q in configs:
        most = min(k, configs[q].most)
        if configs[q].diversity == 0:
            assert [d for d, _ in got.get(q, [])] == [d for d, _ in want[q][:most]]
        else:
            # Diversity chooses among the same scored rows.
            assert all(any(d == e and abs(s - t) < 1e-8 for e, t in want[q]) for d, s in got.get(q, []))
            assert len(got.get(q, [])) == min(most, len(want[q]))


def test_the_dense_leg_and_reranking_change_the_order(spark, sf, asked):
    docs = results(spark, sf)
    order = lambda **a: [(r.query_id, r["rank"], r.doc_id) for r in sorted(search.orchestrated(docs, asked.where("query_id < 3"), 10, **a).collect(), key=lambda r: (r.query_id, r["rank"]))]
    both, sparse, ranked = order(), order(embed=None), order(rerank=True)
    assert both != sparse and both != ranked and len(both) == 20 >= len(sparse) >= 10
    assert search.orchestrated(docs, asked.limit(0)).count() == 0


def test_texts_are_read_once(spark, sf, asked):
    """Vectors, lengths, frequencies and postings come from one pass over the texts; lists from what it wrote equal those from the texts."""
    docs = results(spark, sf).where("doc_id < 150")
    docs = docs.unionByName(docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("again implementation "), "text")))
    calls = spark.sparkContext.accumulator(0)

    def counting(text):
        @F.udf("string")
        def same(x):
            calls.add(1)
            return x

        return same(text)

    told = docs.withColumn("text", counting(F.col("text")))
    some = asked.fillna("")
    said = retrieval.read(told, embed=retrieval.hashing_embedder)
    index = retrieval.indexed(said, some)
    pairs = [(retrieval.bm25(some, told, 30, index=index), retrieval.bm25(some, docs, 30)), (retrieval.sparse(some, told, 30, index=index), retrieval.sparse(some, docs, 30))]
    for got, want in pairs:
        assert sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.select("query_id", "doc_id", "score", "rank").collect()))
    assert calls.value == docs.count()
    vectors = lambda df: sorted((r.doc_id, list(r.v)) for r in df.collect())
    assert vectors(said) == vectors(docs.select("doc_id", retrieval.hashing_embedder(F.col("text")).alias("v")))
    # The search as a whole: each text once, but for what is shown of a document.
    calls.value = 0
    whole = results(spark, sf).where("doc_id < 150").withColumn("text", counting(F.col("text")))
    assert search.orchestrated(whole, some, 10).count() > 20 and calls.value == 150


def test_an_embedder_of_texts_alone_is_asked_for_each_text(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    size = lambda text: F.array(F.length(text).cast("double"))
    assert sorted((r.doc_id, r._terms, r.v) for r in retrieval.read(docs, embed=size).fillna("").collect()) == [(1, "one two", [7.0]), (2, "", [0.0])]
