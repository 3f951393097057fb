"""Traversal over numbers of nodes: the same paths, and only what a start shows meets the queries."""

from lodestone.operators import traversal


def test_numbers_find_what_names_find_and_starts_are_cut_first(spark):
    edges = [(f"n{i}", f"n{j}", "x", w) for i in range(8) for j, w in ((i + 1, 0.5), (i + 2, 0.5), ((i * 3) % 8, 0.9)) if i != j]
    e = spark.createDataFrame(edges, "src string, dst string, kind string, weight double").distinct()
    nodes = spark.createDataFrame([(f"n{i}", "document", f"n{i}", [f"e{i % 3}"], ["t"], [f"k{i % 2}"]) for i in range(10)], "node string, kind string, name string, entities array<string>, topics array<string>, keywords array<string>")
    queries = spark.createDataFrame([(1, ["e0"], [], ["k1"]), (2, ["e1"], ["t"], [])], "query long, entities array<string>, topics array<string>, keywords array<string>")
    starts = spark.createDataFrame([(1, "n0"), (1, "n3"), (2, "n0"), (2, "n5")], "query long, start string")
    ids = traversal.numbers(nodes, e)
    assert [r.name for r in ids.orderBy("id").collect()] == sorted(f"n{i}" for i in range(10))
    for strategy in ("weighted", "breadth_first", "semantic"):
        met = []

        def cut(df, name="step"):
            met.append(df.select("query", "start", "node").collect())
            return df

        plain = traversal.traverse(traversal.reach(e, starts), starts, queries, nodes, strategy, results=3, cut=cut).drop("kinds")
        s = traversal.numbered(starts, ids, "start")
        paths = traversal.reach(traversal.numbered(e, ids, "src", "dst"), s, relations=False)
        found = traversal.named(traversal.traverse(paths, s, queries, traversal.numbered(nodes, ids, "node"), strategy, results=3), ids)
        rows = lambda df: sorted(map(tuple, df.select(*plain.columns).collect()))
        assert rows(found) == rows(plain) and len(rows(found)) == 6
        assert len(met[0]) == 12 if strategy != "semantic" else len(met[0]) > 12
