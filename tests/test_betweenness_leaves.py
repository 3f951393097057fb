"""Documents that lead to their one section are no sources of levels; what passes through the section still counts."""

import pytest
from lodestone.operators import traversal
from lodestone.storage import cut

from tests.test_traversal import brandes


def test_leaves_are_no_sources(spark):
    pairs = [(f"leaf{k}", f"n{k % 3}") for k in range(30)] + [("n0", "n1"), ("n1", "n2"), ("n1", "n3"), ("n2", "n4"), ("n3", "n4"), ("n4", "n1"), ("lone", "end")]
    nodes, written = sorted({v for e in pairs for v in e}), {}

    def counted(df, name="step"):
        out = cut(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    got = {r.node: r.paths for r in traversal.betweenness(spark.createDataFrame(pairs, "src string, dst string"), cut=counted).collect()}
    want = {v: x for v, x in brandes(nodes, pairs).items() if x > 0}
    assert got == pytest.approx(want) and want["n1"] > 60
    assert written["sources"] == 5


def test_only_leaves(spark):
    got = traversal.betweenness(spark.createDataFrame([("a", "z"), ("b", "z")], "src string, dst string")).collect()
    assert got == []
