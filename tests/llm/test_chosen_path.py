"""Chosen-path near-dedup: components against brute force, recall of links at the limit, and nodes that must branch."""

import random

import numpy as np
from lodestone.llm import chosen_path, registry
from lodestone.llm.common import documents
from lodestone.llm.ngram_join import WordHashes, shingles

from tests.llm.test_ngram_groups import rows as group_rows
from tests.llm.test_ngram_join import brute, shingle_set


def result(df):
    return {r[0]: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def wanted(rows):
    return {i: (n, c, i == c) for i, (n, c, _) in brute(rows, 80).items()}


def copies(seed, n, length, edits, word):
    rnd = random.Random(seed)
    base = [word(rnd) for _ in range(length)]
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.choice(edits)):
            t[rnd.randrange(length)] = word(rnd)
        yield t


def letters(rnd):
    return "".join(rnd.choice("abcdefgh") for _ in range(5))


def test_whole_table_matches_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    want = wanted([(r.doc_id, r.text) for r in docs.collect()])
    assert result(registry.QUERIES["op12_chosen_path_near_dedup"](spark, "/root/testdata/sf0.01")) == want
    assert sum(1 for _, c, kept in want.values() if not kept) > 20


def test_crowded_nodes_branch_in_tables_and_tasks(spark):
    rnd = random.Random(5)
    passage = [letters(rnd) for _ in range(60)]
    rows = [" ".join(t) for t in copies(1, 260, 80, [0, 0, 1, 2, 3, 5, 9], letters)]
    rows += [" ".join([letters(rnd) for _ in range(rnd.randint(0, 60))] + passage) for _ in range(200)]
    rows += [" ".join([letters(rnd) for _ in range(9)] + passage + t) for t in copies(2, 60, 40, [0, 1, 1], letters)]
    rows = list(enumerate(rows))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = wanted(rows)
    assert result(chosen_path.near_duplicates(df, held=40, small=6)) == want
    assert result(chosen_path.near_duplicates(df)) == want


def test_a_thousand_copies_near_the_limit(spark):
    """Pairs of one group lie on both sides of the limit; a passage stands in a third of all texts."""
    rows = group_rows()[::2]
    assert result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == wanted(rows)


def test_pairs_at_the_limit_are_found(spark):
    """Pairs of just 80 % and no other links: half of them in texts that share a passage with a thousand others."""
    rnd, rows = random.Random(8), []
    passage = [letters(rnd) for _ in range(30)]
    while len(rows) < 1200:
        t = [letters(rnd) for _ in range(60)] + (passage if len(rows) % 4 < 2 else [])
        # m words before the text change the set by m shingles.
        s = len(t) - 3
        m = s // 8
        a, b = [letters(rnd) for _ in range(m)] + t, t + [letters(rnd) for _ in range(m)]
        sa, sb = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert 0.80 <= len(sa & sb) / len(sa | sb) <= 0.84
        rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == wanted(rows) and sum(not k for *_, k in got.values()) == 600


def test_signatures_estimate_without_bias():
    rnd, cache, errors = random.Random(4), WordHashes(), []
    for k in range(300):
        a = [letters(rnd).encode() for _ in range(90)]
        b = a[: 3 * k // 10] + [letters(rnd).encode() for _ in range(90 - 3 * k // 10)]
        x, y = (np.unique(shingles(t, cache)) for t in (a, b))
        both = len(np.intersect1d(x, y))
        true = both / (len(x) + len(y) - both)
        (s, r), (t, q) = chosen_path.signature(x), chosen_path.signature(y)
        errors.append(((s == t).mean() - true - (1 - true) / 256, (r == q).mean() - true))
    e = np.array(errors)
    assert abs(e[:, 0].mean()) < 0.004 and abs(e[:, 1].mean()) < 0.012 and e[:, 0].std() < 0.031


def test_odd_rows(spark, odd_documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one "), (6, "one two three"), (7, "ONE TWO\nTHREE"), (8, "é É"), (9, "é é"), (10, "a b c d e"), (11, "x y z w v"), (12, "x y z w v u")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, label int")
    assert result(chosen_path.near_duplicates(df)) == wanted(rows)
    got = result(chosen_path.near_duplicates(odd_documents))
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and len(got) == 7
    assert chosen_path.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_join_their_components(spark):
    rows = [(5, "a b c d e f"), (9, "a b c d e f"), (9, "u v w x y z"), (9, "o p q r s t"), (7, "u v w x y z"), (8, "o p q r s t"), (3, "no other words here")]
    got = result(chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: c for i, (_, c, _) in got.items()} == {5: 5, 7: 5, 8: 5, 9: 5, 3: 3}


def test_a_tree_ends_where_signatures_are_equal():
    n = 40
    sig, size, label = np.zeros((n, 256), np.uint8), np.full(n, 9), np.arange(n)
    edges, met = chosen_path.grown(sig, size, label, 1, 80, small=4, deepest=3)
    assert len(edges) == n - 1 and met == set(range(n))
    assert chosen_path.grown(sig, size, np.zeros(n, int), 1, 80) == ([], set())
