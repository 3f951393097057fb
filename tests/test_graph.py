"""Ranks run to their tolerance, against brute-force power iteration."""

import numpy as np
from lodestone.operators import graph
from lodestone.plans import catalog
from lodestone.plans.graph_queries import citations
from lodestone.plans.model import results


def power_rank(ids, edges):
    at = {k: i for i, k in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        m[at[d], at[s]] += w
    total = m.sum(0)
    m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(500):
        r = 0.15 / len(ids) + 0.85 * (m @ r + r[total == 0].sum() / len(ids))
    return dict(zip(ids, r, strict=True))


def test_page_rank_of_a_chain_runs_to_its_end(spark):
    edges = [(k, k + 1, 1.0) for k in range(12)] + [(12, 0, 1.0), (20, 0, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    ids = [*range(13), 20]
    got = {r.node: r["rank"] for r in graph.page_rank(spark.createDataFrame([(k,) for k in ids], "node long"), df, graph.MOST_ROUNDS, tolerance=graph.RANK_TOLERANCE).collect()}
    want = power_rank(ids, edges)
    assert sum(abs(got[k] - want[k]) for k in ids) < 1e-5


def test_citation_page_rank_is_converged(spark, sf):
    ids = [r.doc_id for r in results(spark, sf).select("doc_id").collect()]
    want = power_rank(ids, [(r.src, r.dst, r.weight) for r in citations(spark, sf).collect()])
    got = {r.node: r["rank"] for r in catalog.QUERIES["citation_page_rank_whole"](spark, sf).collect()}
    assert got.keys() == want.keys() and sum(abs(got[k] - want[k]) for k in ids) < 1e-5


def test_citation_hits_runs_to_the_reference_rounds(spark, sf):
    edges = [(r.src, r.dst, r.weight) for r in citations(spark, sf).collect()]
    ids = sorted({k for s, d, _ in edges for k in (s, d)})
    at = {k: i for i, k in enumerate(ids)}
    m = np.zeros((len(ids), len(ids)))
    for s, d, w in edges:
        m[at[s], at[d]] += w
    h = np.ones(len(ids))
    for _ in range(graph.MOST_ROUNDS):
        a = m.T @ h
        a /= a.sum()
        before, h = h, m @ a
        h /= h.sum()
        if abs(h - before).sum() < graph.HUB_TOLERANCE:
            break
    got = {r.node: r for r in catalog.QUERIES["citation_hits"](spark, sf).collect()}
    assert max(abs(got[k].hub - h[at[k]]) + abs(got[k].authority - a[at[k]]) for k in ids) < 1e-8
