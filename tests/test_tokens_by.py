"""Tokens dealt by their document: no shuffle of tokens, the same rows."""

from lodestone.operators import retrieval


def test_tokens_need_no_shuffle_of_their_own(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, None), (1, "two three"), (None, "four"), (3, "the")], "doc_id long, text string")
    dealt, plain = retrieval.encode_documents(df, "doc_id", "text"), retrieval.tokens(df, "doc_id", "text")
    assert sorted(dealt.select("token", "tf").collect()) == sorted(plain.select("token", "tf").collect()) == [("four", 1), ("one", 1), ("three", 1), ("two", 3)]
    lists = retrieval.encode_documents(df, "doc_id", "text").groupBy("doc_id").count()
    assert lists._jdf.queryExecution().sparkPlan().toString().count("hashpartitioning") <= 1
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc_id") == 1 and ", token#" not in plan.split("hashpartitioning(", 1)[1].split(")", 1)[0]
