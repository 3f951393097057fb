"""Whitening against a plain NumPy version, and its parts against theirs."""

import math

import numpy as np
import pytest
from lodestone.llm import registry, whitening
from lodestone.session import table


def plain(rows, top=4):
    """{(id, component): (n, deviation, |whitened|, explained)} of (id, vector) rows that all take part."""
    x = [[math.floor(256 * float(c)) for c in v] for _, v in rows]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float) - np.array([s / n for s in sums])
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for (i, _), v in zip(rows, x, strict=True):
        d = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        w = np.array([c - s / n for c, s in zip(v, sums, strict=True)]) @ q
        out += [(i, k + 1, n, d, abs(w[k]) / math.sqrt(e[k]), e[k] / e.sum()) for k in range(min(top, len(sums)))]
    return sorted(out)


def test_whole_table(spark, sf):
    got = registry.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    want = plain([(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()])
    got = sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained, r.identity_error) for r in got)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:6] for g in got], [w[4:] for w in want], rtol=1e-9, atol=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


def test_signs_agree_over_rows_and_partitions(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.normal(size=6) * [5, 4, 3, 2, 1, 1]).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a, b = ({(r.vec_id, r.component): r.whitened for r in whitening.whiten(df.repartition(p)).collect()} for p in (1, 23))
    for k in range(1, 5):
        x, y = (np.array([m[i, k] for i in range(300)]) for m in (a, b))
        assert np.allclose(x, y) or np.allclose(x, -y)
        assert abs(x.mean()) < 0.1 and abs((x * x).mean() - 1) < 1e-6


def test_symmetric_qr():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        a = rnd.normal(size=(n, n))
        a = a @ a.T
        e, q = whitening.symmetric_qr(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(q.T @ q, np.eye(n)) and np.allclose(a @ q, q * e)
    e, q = whitening.symmetric_qr(np.diag([1.0, 1.0, 3.0, 0.0]))
    assert e.tolist() == [3.0, 1.0, 1.0, 0.0] and np.allclose(q.T @ q, np.eye(4))
    assert whitening.symmetric_qr(np.zeros((3, 3)))[0].tolist() == [0.0, 0.0, 0.0]


def test_merged_states_equal_one_stream():
    x = np.random.default_rng(2).integers(-1000, 1000, (500, 5)) + 10**6
    whole, parts = whitening.Moments(5), [whitening.Moments(5) for _ in range(4)]
    whole.add(x)
    for p, s in zip(parts, (slice(0, 1), slice(1, 200), slice(200, 200), slice(200, 500)), strict=True):
        p.add(x[s])
    for p in parts[1:]:
        parts[0].merge(p)
    assert parts[0].n == 500 and parts[0].sums == whole.sums == x.sum(0).tolist()
    near = dict(rtol=0, atol=1e-9 * float(whole.m2.max()))
    assert np.allclose(parts[0].m2, whole.m2, **near) and np.allclose(whole.m2, 500 * np.cov(x.T, bias=True), **near)


def test_odd_rows(spark):
    good = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (2, [0.001, 0.002]), (2, [0.0015, 0.0021]), (None, [1.0, 2.0]), (3, [-1.0, 0.25])]
    bad = [(4, None), (5, []), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + bad], "vec_id long, embedding array<double>, component string, n int")
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted((r.vec_id or 0, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got.collect())
    want = plain([(i or 0, v) for i, v in good])
    assert [g[:4] for g in got] == [w[:4] for w in want] and {g[2] for g in got} == {4}
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])
    assert whitening.whiten(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_no_variance(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, k, 1, 0, None, 0.0, None) for i, _ in rows for k in (1, 2)]


def test_one_direction_and_huge_entries(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    assert got[1, 2].whitened is None and got[1, 2].explained == 0.0 and abs(got[1, 1].explained - 1) < 1e-12 and got[1, 1].identity_error < 1e-9
    huge = spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 4.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}
    wide = spark.createDataFrame([(1, [5e6, 2.0]), (2, [-5e6, 4.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(wide).collect()} == {(2 * 256 * 5 * 10**6) ** 2 + 512**2}
