"""The stored index against the search over the documents themselves."""

import random
import re

import pytest
from lodestone.operators import postings, retrieval
from pyspark.sql import functions as F


def made(n, seed, words=60):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    return [(i, " ".join(rnd.choice(vocab[: rnd.randint(3, words)]) for _ in range(rnd.choice([3, 10, 40, 200])))) for i in range(n)]


QUERIES = [(1, "w1 w2 w2 w50"), (2, "w0"), (3, "unknown words"), (4, " ".join(f"w{i}" for i in range(40))), (5, "the of"), (6, "w55 w56 W57")]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def same(got, want):
    """Ranks and scores agree; sums in other orders may round apart, so equal neighbours may change places."""
    assert [(q, r) for q, r, *_ in got] == [(q, r) for q, r, *_ in want]
    for (_, _, a, x), (_, _, b, y) in zip(got, want, strict=True):
        assert x == pytest.approx(y, abs=2e-6) and (a == b or x == pytest.approx(y, abs=2e-6))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string")


@pytest.mark.parametrize("k", [3, 20])
def test_search_equals_that_over_documents(spark, asked, tmp_path, monkeypatch, k):
    monkeypatch.setattr(postings, "BLOCK", 4)
    docs = spark.createDataFrame([*made(300, k), (900, None), (901, ""), (None, "w1")], "doc_id long, text string")
    postings.build(docs, str(tmp_path / "i"))
    got = rows(postings.bm25(spark, str(tmp_path / "i"), asked, k))
    same(got, rows(retrieval.bm25(asked, docs.where("doc_id IS NOT NULL"), k)))
    assert {q for q, *_ in got} == {1, 2, 4, 6}


def test_segments_replace_and_compact(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    at, live = str(tmp_path / "i"), dict(made(200, 1))
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    postings.build(frame(live), at)
    for number, seed in ((1, 5), (2, 6)):
        change = {i + 30 * number: t for i, t in made(60, seed)} | {number: ""}
        assert postings.add(frame(change), at) == number
        live |= change
        same(rows(postings.bm25(spark, at, asked, 10)), rows(retrieval.bm25(asked, frame(live), 10)))
    assert postings.live_forward(spark, at).count() == sum(1 for t in live.values() if t)
    postings.compact(spark, at, str(tmp_path / "j"))
    assert postings.read(spark, str(tmp_path / "j"), "stale").count() == 0
    same(rows(postings.bm25(spark, str(tmp_path / "j"), asked, 10)), rows(retrieval.bm25(asked, frame(live), 10)))


def test_a_search_reads_its_tokens_folders_and_few_blocks(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    at = str(tmp_path / "i")
    docs = spark.createDataFrame(made(400, 3), "doc_id long, text string")
    postings.build(docs, at)
    one = asked.where("query_id = 2")
    found = postings.bm25(spark, at, one, 5)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    token = spark.createDataFrame([("w0",)], "token string").select(postings.bucket()).first()[0]
    scans = [x for x in plan.split("\n\n") if f"{at}/postings" in x]
    assert scans and all(re.search(rf"PartitionFilters: .*bucket#\d+ (= {token}\b|IN \({token}\))", x) for x in scans)
    assert f"{at}/forward" not in plan
    cuts = []
    real = postings.cut
    monkeypatch.setattr(postings, "cut", lambda df, name="step": cuts.append((name, real(df, name))) or cuts[-1][1])
    postings.bm25(spark, at, one, 3).collect()
    heads, best = dict(cuts)["bounds"], dict(cuts)["best"]
    kth = best.agg(F.min("score")).first()[0]
    assert heads.where(F.col("bound") >= kth).count() < heads.count()


def test_empty_tables(spark, asked, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    postings.build(none, str(tmp_path / "i"))
    assert postings.bm25(spark, str(tmp_path / "i"), asked, 5).count() == 0
    assert postings.bm25(spark, str(tmp_path / "i"), asked.limit(0), 5).count() == 0
