"""Targets of queries: a query meets the documents of its rarest word only."""

from lodestone.operators import lookup


def test_common_words_do_not_meet_queries_with_all_documents(spark):
    docs = spark.createDataFrame([(i, "common words all over" + (" rare common" if i in (30, 31, 40) else "")) for i in range(50)] + [(31, "common")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "Common words, rare"), (1, "common words nowhere all over"), (2, "nothing nowhere"), (3, None), (4, "over all")], "query_id long, text string")
    kept = {}

    def cut(df, name="step"):
        rows = df.collect()
        kept.setdefault(name, []).append(rows)
        return spark.createDataFrame(rows, df.schema)

    got = sorted(map(tuple, lookup.targets(queries, docs, cut).collect()))
    assert got == [(0, 0, 31), (1, 2, 31), (4, 0, 0)]
    # The first query meets three documents, the last all fifty; no other does.
    assert len(kept["met"][0]) == 3 + 50
