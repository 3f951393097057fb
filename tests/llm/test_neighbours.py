import numpy as np
from lodestone.llm import neighbours
from lodestone.llm.common import table


def exact(rows, k=20, every=20):
    rows = sorted({(i, tuple(float(c) for c in v)) for i, v in rows})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            s = (x * q).sum(1)
            out[int(i)] = sorted(((-b, int(a)) for a, b in zip(ids, s, strict=True) if a != i))[:k]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    assert set(by) == {q for q, w in want.items() if w}
    for q, w in want.items():
        mine = sorted(by.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(w) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        total += len(w)
        hit += len({m[1] for m in mine} & {i for _, i in w})
    return hit / total


def test_recall_on_the_table(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = exact([(r.vec_id, r.embedding) for r in vectors.collect()])
    # Blocks as full as those of a large table.
    assert recall(neighbours.search(vectors).collect(), want) >= 0.9


def test_lengths_vary_and_one_vector_is_common(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(600, 8)) * rnd.uniform(0.5, 2, size=(600, 1))
    x[200:400] = x[200]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(df, block=256).collect()
    assert recall(got, exact(rows)) >= 0.9


def test_equal_scores_go_to_the_smaller_ids(spark):
    rnd = np.random.default_rng(8)
    # 300 distinct vectors whose inner product with the query is the same, among nearer and farther ones.
    tied = [(int(i), [0.5, float(c), float(np.sqrt(0.75 - c * c))]) for i, c in zip(range(701, 1001), np.round(rnd.uniform(-0.8, 0.8, 300), 6), strict=True)]
    rows = [(0, [1.0, 0.0, 0.0]), *rnd.permutation(np.array(tied, object)).tolist(), (5001, [0.9, 0.1, 0.0]), (5002, [0.1, 0.9, 0.0])]
    got = [r.vec_id for r in neighbours.search(spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<double>")).orderBy("rank").collect() if r.query_id == 0]
    assert got == [5001, *range(701, 720)]


def test_ties_across_the_footrule_cut_and_blocks(spark):
    rnd = np.random.default_rng(9)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(np.repeat(rnd.normal(size=(300, 6)), 9, axis=0))]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=700).collect()
    assert recall(got, exact(rows)) >= 0.9


def test_odd_rows(spark):
    bad = [(0, None), (1, [0.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [1.0, 0.0]), (23, [0.0, 2.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in bad + good], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).collect())
    assert got == [(20, 1, 21, 1.0), (20, 2, 22, 1.0), (20, 3, 40, 0.5), (20, 4, 23, 0.0), (40, 1, 23, 1.0), (40, 2, 20, 0.5), (40, 3, 21, 0.5), (40, 4, 22, 0.5)]
    assert neighbours.search(df.limit(0)).count() == 0


def test_footrule_is_that_of_the_lists():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(50, 6))
    longest2 = float((x * x).sum(1).max())
    p = neighbours.lengthened(x[:16], longest2)
    b = neighbours.Block(np.arange(50), x, p, longest2, 6, 21)
    lists = neighbours.represent(neighbours.lengthened(b.x, longest2), p, 6)
    place = lambda li, c: list(li).index(c) if c in li else 6
    for q, row in zip(lists, b.footrule(lists), strict=True):
        assert row.tolist() == [sum(abs(place(q, c) - place(e, c)) for c in set(q) | set(e)) for e in lists]
