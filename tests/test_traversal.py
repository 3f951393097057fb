"""Centrality and traversal against plain versions on small graphs."""

import random
from collections import defaultdict, deque

import pytest
from lodestone.operators import traversal
from lodestone.plans import catalog
from lodestone.plans.model import results


def brandes(nodes, pairs):
    """Betweenness of a directed graph, every pair of end points counted."""
    out = defaultdict(set)
    for a, b in pairs:
        if a != b:
            out[a].add(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        ways, hop, order, before, todo = defaultdict(float, {s: 1.0}), {s: 0}, [], defaultdict(list), deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in hop:
                    hop[w] = hop[v] + 1
                    todo.append(w)
                if hop[w] == hop[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        behind = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                behind[v] += ways[v] / ways[w] * (1 + behind[w])
            if w != s:
                total[w] += behind[w]
    return total


@pytest.mark.parametrize("sources", [3, 1000])
def test_betweenness_of_random_graphs(spark, sources):
    rnd = random.Random(sources)
    nodes = [f"n{i}" for i in range(25)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes), k, 1.0) for k in ("x", "y") for _ in range(35)]
    df = spark.createDataFrame(edges, "src string, dst string, kind string, weight double")
    got = {r.node: r for r in traversal.centrality(spark.createDataFrame([(n,) for n in nodes], "node string"), df, sources).collect()}
    want, n = brandes(nodes, {e[:2] for e in edges}), len(nodes)
    for v in nodes:
        degree = sum((a == v) + (b == v) for a, b, *_ in edges) / (n - 1)
        between = want[v] / ((n - 1) * (n - 2))
        assert got[v].degree == pytest.approx(degree) and got[v].betweenness == pytest.approx(between)
        assert got[v].centrality == pytest.approx(0.4 * degree + 0.6 * between)
    assert max(want.values()) > 10


def test_centrality_of_the_knowledge_graph(spark, sf):
    from lodestone.plans.traversal_queries import _nodes

    r = results(spark, sf)
    edges = [(e.src, e.dst) for e in traversal.knowledge_edges(r).collect()]
    nodes = [x.node for x in _nodes(r).collect()]
    assert len(nodes) == len(set(nodes)) and {v for e in edges for v in e} <= set(nodes)
    want, n = brandes(nodes, set(edges)), len(nodes)
    got = {x.node: x.betweenness for x in catalog.QUERIES["graph_centrality"](spark, sf).collect()}
    assert set(got) == set(nodes) and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-11 for v in nodes)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src string, dst string, kind string, weight double")
    got = traversal.centrality(spark.createDataFrame([("a",)], "node string"), none).collect()
    assert [tuple(r) for r in got] == [("a", 0.0, 0.0, 0.0)]


def plain_paths(edges, start, hops):
    """Every path without a repeated node: {node: [(weight, hops, path)]}."""
    best = {}
    for a, b, _, w in edges:
        if w >= traversal.LEAST_WEIGHT:
            best[a, b] = max(w, best.get((a, b), 0.0))
    found, at = defaultdict(list), [(0.0, (start,))]
    for k in range(1, hops + 1):
        at = [(round(w + best[e], 6), (*p, e[1])) for w, p in at for e in best if e[0] == p[-1] and e[1] not in p]
        for w, p in at:
            found[p[-1]].append((w, k, p))
    return found


def test_best_paths_avoid_their_own_nodes(spark):
    """Dense graphs in both directions, where the heaviest way to a node often passes the node that comes next."""
    rnd = random.Random(6)
    nodes = [f"n{i}" for i in range(8)]
    edges = [(a, b, rnd.choice(["x", "y"]), round(rnd.uniform(0.02, 1.0), 2)) for a in nodes for b in nodes if a != b and rnd.random() < 0.5]
    df = spark.createDataFrame(edges, "src string, dst string, kind string, weight double")
    features = spark.createDataFrame([(n, "document", n, [n], [], []) for n in nodes[:5]], "node string, kind string, name string, entities array<string>, topics array<string>, keywords array<string>")
    queries = spark.createDataFrame([(1, ["n0", "n3"], [], []), (2, ["n1"], [], []), (3, ["zz"], [], [])], "query long, entities array<string>, topics array<string>, keywords array<string>")
    central = spark.createDataFrame([(n, k / 10) for k, n in enumerate(nodes)], "node string, centrality double")
    starts = traversal.start_nodes(queries, features, central)
    assert sorted(map(tuple, starts.collect())) == [(1, "n0"), (1, "n3"), (2, "n1"), (3, "n2"), (3, "n3"), (3, "n4")]
    paths = traversal.reach(df, starts)
    asks = {1: {"n0", "n3"}, 2: {"n1"}, 3: {"zz"}}
    for strategy in traversal.STRATEGIES:
        got = sorted((r.query, r["rank"], r.start, r.node, r.hops, r.weight, r.score, tuple(r.path)) for r in traversal.traverse(paths, starts, queries, features, strategy, results=5, central=central).collect())
        want = []
        for q, start in sorted(map(tuple, starts.collect())):
            rows = []
            for node, found in plain_paths(edges, start, 3).items():
                w, k, p = min(found, key=lambda x: (-x[0], x[1], ">".join(x[2])) if strategy == "weighted" else (x[1], -x[0], ">".join(x[2])))
                score = round(0.4 / len(asks[q]), 6) if node in asks[q] and node in nodes[:5] else 0.0
                order = {"weighted": (-w,), "breadth_first": (k, -w), "semantic": (-score, k, -w), "centrality": (-nodes.index(node) / 10, k)}[strategy]
                rows.append((order, node, (q, start, node, k, w, score, p)))
            want += [x for _, _, x in sorted(rows)[:5]]
        ranked = []
        for q in asks:
            own = sorted((x for x in want if x[0] == q), key=lambda x: (-x[5], -x[4], x[1], x[2]))[:5]
            ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own, 1)]
        assert got == sorted(ranked), strategy


def test_reasoning_names_each_step(spark):
    df = spark.createDataFrame([("a", "b", "contains", 1.0), ("b", "c", "mentions", 0.7)], "src string, dst string, kind string, weight double")
    paths = traversal.reach(df, spark.createDataFrame([("a",)], "start string"))
    names = spark.createDataFrame([("a", "Guide"), ("b", "Part")], "node string, name string")
    got = {r.node: r.reasoning for r in traversal.reasoning(paths, names).collect()}
    assert got == {"b": ["Guide --contains--> Part"], "c": ["Guide --contains--> Part", "Part --mentions--> c"]}
