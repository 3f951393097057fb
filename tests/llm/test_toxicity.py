import itertools
import math
import zlib

import numpy as np
from lodestone.llm import toxicity
from lodestone.llm.common import documents, table


def brute(chain, codes):
    """Marginals by summing over every tagging."""
    e, n = chain.emissions(np.array(codes)), len(codes)
    total, mass = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        s = sum(e[i] for i in range(n) if tags[i]) + sum(chain.move[a, b] for a, b in itertools.pairwise(tags))
        total += math.exp(s)
        mass += math.exp(s) * np.array(tags)
    return mass / total


def test_marginals_are_exact():
    rnd = np.random.default_rng(4)
    chain = toxicity.Chain([b"x", b"y"])
    chain.bias, chain.move = -0.7, rnd.normal(size=(2, 2))
    for w in (chain.here, chain.left, chain.right):
        w[1:] = rnd.normal(size=2)
    for _ in range(60):
        codes = rnd.choice([0, 0, 0, 0, 1, 2], size=rnd.integers(1, 11))
        at, p = chain.marginals(codes)
        assert np.allclose(p, brute(chain, codes)[at])
        assert (len(at) == 0) == (not codes.any())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = toxicity.score(documents(spark, sf), table(spark, sf, "labels")).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85
    assert sum(p for p, y in held if not y) / sum(1 - y for _, y in held) < 0.01


def test_odd_rows(spark, odd_documents, odd_labels):
    rows = toxicity.score(odd_documents, odd_labels).collect()
    assert len(rows) == 9 and all(r.score is not None for r in rows)
    assert toxicity.score(odd_documents.limit(0), odd_labels.limit(0)).count() == 0


def test_offsets_and_disguise():
    raw = "é Idiot, ok \U0001f600 1d10t!".encode()
    codes = toxicity.Codes([b"idiot"]).of(raw.split())
    assert codes.tolist() == [0, 1, 0, 0, 1]
    assert toxicity.offending(raw, np.array([1, 4])) == [{"start": 2, "end": 8}, {"start": 14, "end": 20}]
