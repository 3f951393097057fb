"""Searches by every query whose id is divisible by 20, with its whole text, against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from lodestone.operators import retrieval
from lodestone.plans import catalog
from lodestone.plans.model import results
from lodestone.plans.retrieval_queries import points, whole_batch
from pyspark.sql import functions as F


def counts(text):
    return Counter(t for t in re.findall(r"[A-Za-z0-9_]{2,}", text.lower()) if t not in retrieval.STOP_WORDS)


def best(scores, k):
    return {(q, d): s for q, found in scores.items() for d, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]}


def test_sparse_takes_whole_queries(spark, sf):
    asked = {r.query_id: counts(r.text) for r in whole_batch(spark, sf).collect()}
    assert asked.keys() == {0, 20}
    docs = {r.doc_id: counts(r.text) for r in results(spark, sf).select("doc_id", "text").collect()}
    want = {q: {d: round(sum(tf * 2.2 / (tf + 1.2) * (1 + math.log(qt[t])) for t, tf in dt.items() if t in qt), 6) for d, dt in docs.items()} for q, qt in asked.items()}
    got = {(r.query_id, r.doc_id): r.score for r in catalog.QUERIES["search_sparse_whole"](spark, sf).collect()}
    assert len(got) == 40
    for q in asked:
        assert np.allclose(sorted(s for (k, _), s in got.items() if k == q), sorted(s for (k, _), s in best(want, 20).items() if k == q), atol=2e-6)
    assert all(abs(want[q][d] - s) < 2e-6 for (q, d), s in got.items())


@pytest.mark.parametrize(("name", "labels", "least"), [("search_dense_whole", None, 0.1), ("search_dense_filtered_whole", (1, 3), None)])
def test_dense_takes_all_vectors(spark, sf, name, labels, least):
    rows = points(spark, sf).collect()
    v = np.array([r.v for r in rows], float)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    want = {}
    for i, r in enumerate(rows):
        if r.doc_id % 20 == 0:
            exact = v @ v[i]
            want[r.doc_id] = {x.doc_id: round(float(s), 6) for x, s in zip(rows, exact, strict=True) if (labels is None or x.label in labels) and (least is None or s >= least)}
    got = {(r.query_id, r.doc_id): r.score for r in catalog.QUERIES[name](spark, sf).collect()}
    assert {q for q, _ in got} == {r.doc_id for r in rows if r.doc_id % 20 == 0}
    assert got == pytest.approx(best(want, 10), abs=2e-6)


def test_blocks_change_nothing(spark, sf):
    p = points(spark, sf)
    q = p.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "v")
    one, many = (sorted(map(tuple, retrieval.dense_blocks(q, p, 10, block=n).collect())) for n in (512, 7))
    assert one == many and len(one) == 250
    d, b = results(spark, sf), whole_batch(spark, sf)
    one, many = (sorted(map(tuple, retrieval.in_blocks(b, lambda x: retrieval.bm25(x, d, 20), n).collect())) for n in (512, 1))
    assert one == many
