"""Complements by bits of titles: the rule of technologies, and targets."""

from lodestone.operators import conflicts
from lodestone.plans.model import results


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source_title string, project_id string, topics array<string>, entities array<string>")


def test_shared_technologies_are_tested_and_counted_by_two_lists(spark):
    rows = [(0, "Golang notes", "a", ["t"], []), (1, "Golang diary", "b", ["t"], []), (2, "Python and Docker diary", "a", ["u"], []), (3, "Python, Docker, gcp", "b", ["u"], []), (4, "gcp python", "c", ["u"], ["E"]), (5, "none", "d", ["u"], ["e "])]
    got = {(r.a, r.b): r.score for r in conflicts.complementary(frame(spark, rows), 10).collect()}
    assert got[0, 1] == got[1, 0] == round(0.3 * 0.8, 6)
    assert got[2, 3] == round(0.5 * 0.8, 6) and got[3, 4] == round(0.4 * 0.8, 6)
    assert got[4, 5] == round(0.4 * 0.8, 6)  # one shared entity counts, titles do not


def test_targets_get_what_all_get(spark, sf):
    r = results(spark, sf)
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole, some = rows(conflicts.complementary(r, 4)), r.where("doc_id % 7 = 3").select("doc_id")
    assert rows(conflicts.complementary(r, 4, targets=some)) == [x for x in whole if x[0] % 7 == 3]
    assert len({x[0] for x in whole}) > 100
    assert conflicts.complementary(r, 4, targets=some.limit(0)).count() == 0


def test_missing_titles_and_lists(spark):
    rows = [(0, None, None, ["t"], None), (1, "API guide", None, ["T "], ["x"]), (2, "", "p", None, []), (2, "", "p", None, [])]
    got = {(r.a, r.b) for r in conflicts.complementary(frame(spark, rows), 5, least=0.0).collect()}
    assert got == {(0, 1), (1, 0)}
