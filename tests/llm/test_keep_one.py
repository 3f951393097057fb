"""The rows that stay of near duplicates: repeated ids, rows without id, clashing names."""

from collections import Counter

from lodestone.llm import ngram_join


def test_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (3, a + " z"), (4, b), (4, b), (4, a), (5, c), (5, "zz " + c), (None, a), (None, a), (6, None), (7, ""), (7, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _id string, c0 int").repartition(3)
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    # Id 4 is a copy of 1 by one of its rows, so all of it goes; of id 5 the smaller text stays.
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (5, c), (None, a), (None, a), (6, None), (7, "")])
    assert ngram_join.keep_one(df.limit(0)).count() == 0
