"""Relationships between clusters against pairs of their members."""

import itertools

import pytest
from lodestone.operators import cluster_relations as cr
from lodestone.operators import similarity
from lodestone.plans.model import results


def runs(path):
    levels = path.split(" > ")
    return {" > ".join(levels[i:j]) for i in range(len(levels)) for j in range(i + 1, len(levels) + 1)}


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute(rows, names, least=0.1, most=10):
    """names: cluster -> (entities, topics) of its key."""
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], []).append(r)
    out = []
    for a, b in itertools.combinations(sorted(by), 2):
        x, y = by[a], by[b]
        found = [jac(names[a][0], names[b][0]), jac(names[a][1], names[b][1])]
        sx, sy = ({r["source_type"] for r in z} - {None} for z in (x, y))
        found.append(min(1.0, jac(sx, sy) + 0.3) if len(sx) == 1 and sx == sy else jac(sx, sy))
        inside = sum(1 for p in x for q in y if p["breadcrumb_text"] and q["breadcrumb_text"] and (p["breadcrumb_text"] in runs(q["breadcrumb_text"]) or q["breadcrumb_text"] in runs(p["breadcrumb_text"])))
        found.append(inside / (len(x) * len(y)))
        cx, cy = (any(r["has_code_blocks"] for r in z) for z in (x, y))
        mx, my = (sum(r["word_count"] or 0 for r in z) / len(z) for z in (x, y))
        content = 0.4 if cx and cy else 0.2 if not cx and not cy else 0.0
        if min(mx, my) > 0 and min(mx, my) / max(mx, my) > 0.5:
            content += 0.3 * min(mx, my) / max(mx, my)
        found.append(content)
        best = max(range(5), key=lambda k: (round(found[k], 6), -k))
        if found[best] > least:
            out.append((a, b, cr.KINDS[best], round(found[best], 6)))
    return sorted(out, key=lambda r: (-r[3], r[0], r[1]))[:most]


@pytest.mark.parametrize("strategy", ["entities", "topics", "projects", "hierarchy", "mixed"])
def test_relationships_equal_those_over_members(spark, sf, strategy):
    r = results(spark, sf)
    rows = [x.asDict() for x in cr.members(r, strategy, 12).select("cluster", "source_type", "has_code_blocks", "word_count", "breadcrumb_text").collect()]
    names = {}
    for c in {x["cluster"] for x in rows}:
        parts = {"entities": set(), "topics": set()}
        if strategy in parts:
            parts[strategy] = set(c.split("|"))
        elif strategy == "mixed":
            for p in c.split("|"):
                kind, _, rest = p.partition(":")
                if kind in parts:
                    parts[kind] = set(rest.split(","))
        names[c] = (parts["entities"], parts["topics"])
    got = [(x.a, x.b, x.kind, x.strength) for x in cr.relationships(r, strategy, 12).collect()]
    assert got == pytest.approx(brute(rows, names)) if not got else [g[:3] for g in got] == [w[:3] for w in brute(rows, names)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in brute(rows, names)], abs=2e-6)
    assert got or strategy in ("entities", "topics", "mixed")


def test_breadcrumbs_inside_one_another(spark):
    rows = [("x", "A > B"), ("x", "A > B"), ("x", "B > C"), ("y", "A > B > C"), ("y", "A > B"), ("y", None), ("z", "B"), ("z", "AB > C")]
    df = spark.createDataFrame([("c" + c, p) for c, p in rows], "cluster string, breadcrumb_text string")
    # x-y: both "A > B" lie in both of y's, "B > C" in the longer; z's "B" lies in all five others.
    assert {(r.a, r.b): r.n for r in cr.contained(df).collect()} == {("cx", "cy"): 5, ("cx", "cz"): 3, ("cy", "cz"): 2}


def test_quality_of_clusters(spark, sf):
    r = results(spark, sf)
    got = {x.cluster: x for x in cr.quality(r, "projects", similarity.coherence(r, "projects")).collect()}
    rows = {}
    for x in cr.members(r, "projects", 10).select("cluster", "doc_id", "source_title", "text").collect():
        rows.setdefault(x.cluster, []).append(x)
    assert set(got) == set(rows) and len(rows) > 2
    for c, z in rows.items():
        sets = [set((x.source_title + " " + x.text[:200]).lower().split()) for x in sorted(z, key=lambda x: x.doc_id)[:5]]
        both = [jac(a, b) for a, b in itertools.combinations(sets, 2)]
        assert got[c].n == len(z) and got[c].similarity == pytest.approx(sum(both) / len(both), abs=2e-6)
        assert got[c].coherence is not None and got[c].entity_diversity == 0
