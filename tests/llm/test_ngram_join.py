import random
from collections import defaultdict

import numpy as np
import pytest
from lodestone.llm import ngram_join
from lodestone.llm.common import documents
from lodestone.llm.components import connected_components


def shingle_set(text, width=4):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, percent=85):
    """(n_shingles, component, links to other word sequences) by comparing all that share a shingle."""
    sets, by, index = {}, defaultdict(list), defaultdict(list)
    for i, t in rows:
        key = tuple((t or "").encode().lower().split())
        sets[key] = shingle_set(t)
        by[key].append(i)
    for key, s in sets.items():
        for x in s:
            index[x].append(key)
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    links = defaultdict(set)
    for key, s in sets.items():
        if s:
            for i in by[key]:
                join(i, by[key][0])
        near = defaultdict(int)
        for x in s:
            for other in index[x]:
                near[other] += 1
        for other, n in near.items():
            if other != key and 100 * n >= percent * (len(s) + len(sets[other]) - n):
                links[key].add(other)
                join(by[key][0], by[other][0])
    return {i: (len(sets[tuple((t or "").encode().lower().split())]), find(i), len(links[tuple((t or "").encode().lower().split())])) for i, t in rows}


def result(df):
    return {r[0]: (r.n_shingles, r.component_id, r.n_links) for r in df.collect()}


def test_whole_table_matches_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(ngram_join.link_components(docs)) == want
    assert sum(1 for i, (_, c, _) in want.items() if c != i) > 20


def test_large_near_copy_group_and_common_passage(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 8)
    monkeypatch.setattr(ngram_join, "PART", 7)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base, passage, rows = [word() for _ in range(80)], [word() for _ in range(60)], []
    for i in range(260):
        t = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            t[rnd.randrange(80)] = word()
        rows.append((i, " ".join(t)))
    rows += [(300 + i, " ".join([word() for _ in range(rnd.randint(0, 60))] + passage)) for i in range(120)]
    rows += [(500 + i, " ".join(base)) for i in range(60)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(ngram_join.link_components(df)) == brute(rows)


def test_odd_rows(spark, odd_documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one "), (6, "one two three"), (7, "ONE TWO\nTHREE"), (8, "é É"), (9, "é é"), (10, "a b c d e"), (11, "x y z w v"), (12, "x y z w v u")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string")
    assert result(ngram_join.link_components(df)) == brute(rows)
    got = result(ngram_join.link_components(odd_documents))
    assert got[4] == (1, 4, 0) and got[5] == (1, 4, 0) and len(got) == 7
    assert ngram_join.link_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_block_links_are_exact(seed):
    rnd = np.random.default_rng(seed)
    base = rnd.integers(0, 1 << 60, 60, np.uint64)
    sets = [np.unique(np.where(rnd.random(60) < rnd.choice([0.02, 0.05, 0.1]), rnd.integers(0, 1 << 60, 60, np.uint64), base)[: rnd.integers(40, 61)]) for _ in range(40)]
    ranks = rnd.choice([0, 1, 129], 1 << 14).astype(np.uint8)
    part = rnd.integers(0, 2, 40)
    for p in (np.zeros(40, int), part):
        links, degree = ngram_join.block_links(np.arange(40), sets, p, ranks)
        want = set()
        for i in range(40):
            for j in range(i + 1, 40):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n) and (p is not part or part[i] != part[j]):
                    want.add((i, j))
        assert set(links) == want
        assert degree.sum() == 2 * len(want)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(0, k) for k in range(1, 60)] + [(rnd.randint(1000, 1400), rnd.randint(1000, 1400)) for _ in range(150)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}
