"""Relations of targets and odd texts."""

from lodestone.operators import relations, similarity
from lodestone.operators.conflicts import complementary
from lodestone.plans.model import results
from pyspark.sql import functions as F


def test_relations_of_targets(spark, sf):
    r = results(spark, sf)
    rows = {x.doc_id: x for x in r.select("doc_id", "document_id", "parent_id").collect()}
    got = {}
    for x in relations.of_targets(r, F.col("doc_id") % 20 == 4).collect():
        got.setdefault((x.a, x.relation), []).append((x.b, x.score))
    pairs = similarity.sharing_pairs(r, "entities", "topics").select("a", "b")
    scores = [(x.a, x.b, x.score) for x in similarity.scored(pairs.union(pairs.select("b", "a")), r).select("a", "b", "score").collect()]
    comp = complementary(r, 5).collect()
    for t in (i for i in rows if i % 20 == 4):
        want = sorted(((b, s) for a, b, s in scores if a == t and s > 0.5), key=lambda z: (-z[1], z[0]))[:5]
        assert sorted(got.get((t, "similar"), [])) == sorted(want)
        assert sorted(got.get((t, "complementary"), [])) == sorted((c.b, c.score) for c in comp if c.a == t)
        children = [i for i, x in rows.items() if x.parent_id == rows[t].document_id and i != t]
        parents = [i for i, x in rows.items() if x.document_id == rows[t].parent_id and i != t]
        family = [b for k in ("child", "parent") for b, _ in got.get((t, k), [])]
        assert sorted(family) == sorted(sorted(children + parents)[:5])
    assert any(k == "child" for _, k in got)


def test_similarity_of_odd_texts(spark):
    rows = [(1, None, "t", ["E"]), (2, "", None, ["e"]), (3, "The cat and THE dog", "x", ["e"]), (4, "a dog user password", "X y", ["e", "f"]), (5, "user's passwords", None, ["e"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_title string, entities array<string>")
    got = {(r.a, r.b): (r.text, r.overlap, r.alike) for r in relations.text_similarity(similarity.sharing_pairs(df, "entities"), df).collect()}
    assert got[1, 2] == (0.0, False, False) and got[2, 3] == (0.0, False, False)
    assert got[3, 4] == (0.25, True, True)  # cat dog | dog user password; a shared title word
    assert got[4, 5] == (0.0, False, True)  # user and password in both


def test_pairs_that_are_shown(spark):
    df = spark.createDataFrame([("c", i) for i in range(30)] + [("d", 1), ("d", 2), ("e", 7)], "cluster string, doc_id long")
    got = sorted(map(tuple, relations.shown_pairs(df, 4).collect()))
    assert got == [("c", 0, 1, 1), ("c", 0, 2, 2), ("c", 0, 3, 3), ("c", 1, 2, 4), ("d", 1, 2, 1)]
    assert relations.shown_pairs(df, 0).count() == 0 and relations.shown_pairs(df).where("cluster = 'c'").count() == 50
