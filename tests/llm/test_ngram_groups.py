"""A large group of near copies and a passage in a third of all documents: exact links, and edges in proportion to postings."""

import random

import numpy as np
from lodestone.llm import common, ngram_join

from tests.llm.test_ngram_join import shingle_set


def rows():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base, passage, out = [word() for _ in range(40)], [word() for _ in range(50)], []
    for i in range(2000):
        t = list(base)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t[rnd.randrange(40)] = word()
        out.append((i, " ".join(t)))
    out += [(3000 + i, " ".join([word() for _ in range(rnd.randint(5, 80))] + passage)) for i in range(1400)]
    out += [(6000 + i, " ".join(word() for _ in range(60))) for i in range(800)]
    return out


def linked(some):
    """(component, links) of texts that are all distinct, by one product of the incidence matrix."""
    sets = [shingle_set(t) for _, t in some]
    names = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(some), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[x] for x in s]] = 1
    both, size = (m @ m.T).astype(int), np.array([len(s) for s in sets])
    link = 100 * both >= 85 * (size[:, None] + size - both)
    np.fill_diagonal(link, False)
    least = np.array([i for i, _ in some])
    while True:
        near = np.where(link, least, np.iinfo(int).max).min(1)
        new = np.minimum(least, near)
        if (new == least).all():
            return {i: (int(c), int(d)) for (i, _), c, d in zip(some, least, link.sum(1), strict=True)}
        least = new


def test_two_thousand_near_copies_and_a_common_passage(spark):
    some = rows()
    assert len({t for _, t in some}) == len(some)
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.link_components(df).collect()}
    assert got == linked(some)
    seen = spark.read.parquet([p for _, p in common._MADE if "described" in p][-1])
    postings = sum(len(shingle_set(t)) for _, t in some)
    assert seen.where("kind = 2").count() < postings


def test_a_common_hint_stands_for_the_pair():
    posts, hints = np.zeros(4, ngram_join.POST), np.zeros(3, ngram_join.HINT)
    posts["token"], posts["cls"], posts["n"], posts["mask"], posts["common"] = 5, [2, 4, 6, 8], 20, 7, [3, 3, 3, 0]
    hints["cls"], hints["hints"] = [2, 4, 6], [[7, 9, 0], [9, 11, 0], [13, 0, 0]]
    pairs, ties = ngram_join.pairs_in_groups(posts, hints)
    assert {(a, b) for a, b, _, _ in pairs.tolist()} == {(2, 6), (2, 8), (4, 6), (4, 8), (6, 8)} and not len(ties)
    many = np.repeat(posts[:1], ngram_join.GROUP + 1)
    many["cls"] = 2 * np.arange(len(many))
    pairs, ties = ngram_join.pairs_in_groups(many, hints[:0])
    assert not len(pairs) and ties.tolist() == [[c, 5] for c in many["cls"].tolist()]


def test_chunks_keep_shingles_whole_and_lose_no_meeting():
    rnd = np.random.default_rng(3)
    posts = np.zeros(6000, ngram_join.POST)
    posts["token"], posts["cls"] = rnd.integers(0, 700, 6000), rnd.integers(0, 400, 6000)
    posts["n"], posts["mask"] = 20, 7
    chunks = list(ngram_join.in_chunks(posts, 2000))
    tokens = [set(c["token"].tolist()) for c in chunks]
    assert len(chunks) > 3 and sum(map(len, tokens)) == len(set().union(*tokens))
    whole, ties = ngram_join.pairs_in_groups(posts, np.zeros(0, ngram_join.HINT))
    parts = [ngram_join.pairs_in_groups(c, np.zeros(0, ngram_join.HINT)) for c in chunks]
    met: dict = {}
    for a, b, _, times in np.concatenate([p for p, _ in parts]).tolist():
        met[a, b] = met.get((a, b), 0) + times
    assert met == {(a, b): times for a, b, _, times in whole.tolist()}
    assert sum(len(t) for _, t in parts) == len(ties)
    assert not list(ngram_join.in_chunks(posts[:0]))
