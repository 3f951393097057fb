"""Shortest paths are found in rounds that double their length; each meets few rows, and edges are made once."""

import pytest
from lodestone.operators import traversal
from lodestone.plans import catalog

from tests.test_traversal import brandes


def _pairs(long):
    """A chain with rungs of two ways, a cycle at its end and a way back."""
    chain = [(f"n{k}", f"n{k + 1}") for k in range(long)]
    rungs = [(f"n{k}", f"x{k}") for k in range(0, long - 1, 3)] + [(f"x{k}", f"n{k + 2}") for k in range(0, long - 1, 3)]
    return chain + rungs + [(f"n{long}", f"n{long - 3}"), (f"n{long - 2}", f"n{long - 4}")]


@pytest.mark.parametrize(("long", "spread", "most"), [(40, 1000, 35), (7, 0, 60)])
def test_rounds_of_long_paths(spark, monkeypatch, long, spread, most):
    pairs, puts, put = _pairs(long), [], traversal.Levels.put
    monkeypatch.setattr(traversal.Levels, "put", lambda self, k, df: puts.append(k) or put(self, k, df))
    got = {r.node: r.paths for r in traversal.betweenness(spark.createDataFrame(pairs, "src string, dst string"), spread).collect()}
    nodes = {v for e in pairs for v in e}
    assert got == pytest.approx({v: x for v, x in brandes(nodes, pairs).items() if x > 0})
    assert max(puts) >= 5 and len(puts) <= most


def test_edges_are_made_once(spark, sf, monkeypatch):
    made, edges = [], traversal.knowledge_edges
    monkeypatch.setattr(traversal, "knowledge_edges", lambda r: made.append(1) or edges(r))
    assert catalog.QUERIES["graph_traverse_centrality"](spark, sf).where("rank = 1").count() == 10
    assert len(made) == 1
