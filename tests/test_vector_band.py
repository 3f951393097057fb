"""Pairs of vectors in a band, dealt into small blocks, against all pairs one by one; no plan crosses a label's rows."""

import math
import random

import pytest
from lodestone.operators import conflicts


def cosine(x, y):
    n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(b * b for b in y))
    return round(sum(a * b for a, b in zip(x, y, strict=True)) / n, 6) if n > 0 else 0.0


@pytest.mark.parametrize("block", [7, 2048])
def test_every_pair_of_the_band(spark, block):
    r = random.Random(3)
    rows = [(k, k % 2, [r.choice([-0.5, 0.25, 1.0, 2.0]) for _ in range(4)]) for k in range(60)]
    odd = [(100, 0, None), (101, 0, [0.0] * 4), (102, 0, [1.0, None, 1.0, 1.0]), (103, 0, [float("nan")] * 4), (104, 0, [1.0, 1.0]), (105, None, [1.0] * 4), (106, 0, [])]
    points = spark.createDataFrame(rows + odd, "doc_id long, label int, v array<float>")
    got = {(x.a, x.b): (x.score, x.tier) for x in conflicts.vector_band(points, 0.3, 0.95, block=block).collect()}
    want = {}
    for a, la, x in rows:
        for b, lb, y in rows:
            if a < b and la == lb and 0.3 <= (s := cosine(x, y)) <= 0.95:
                want[a, b] = (s, "primary" if s >= 0.8 else "secondary" if s >= 0.5 else "tertiary")
    assert got == want and len(got) > 100


def test_blocks_carry_the_pairs(spark):
    points = spark.createDataFrame([(k, 1, [1.0, float(k)]) for k in range(9)], "doc_id long, label int, v array<float>")
    plan = conflicts.vector_band(points, 0.3)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_caps_cut_before_the_shuffle(spark):
    pairs = spark.createDataFrame([(a, a + 1, 0.6 + a / 1000, "secondary") for a in range(50)] + [(1, 9, 0.9, "primary")], "a long, b long, score double, tier string")
    capped = conflicts.capped_by_tier(pairs, {"primary": 2, "secondary": 3})
    assert [(x.tier, x.a, x.rank) for x in capped.orderBy("tier", "rank").collect()] == [("primary", 1, 1), ("secondary", 49, 1), ("secondary", 48, 2), ("secondary", 47, 3)]
    assert "WindowGroupLimit" in capped._jdf.queryExecution().toString()
