"""Keyword search where an id has several rows: they count as one document, as in one pass over all tokens."""

import math
import re
from collections import Counter, defaultdict

from lodestone.operators import retrieval


def test_bm25_counts_the_rows_of_an_id_as_one_document(spark):
    rows = [(1, "red apple red"), (1, "apple pie"), (2, "green apple"), (3, ""), (4, "blue sky over red sea"), (5, None), (6, "the of and"), (7, "pie pie pie")]
    asked = [(0, "red apple"), (1, "pie"), (2, "nothing here"), (3, "")]
    docs = defaultdict(Counter)
    for i, t in rows:
        docs[i] += Counter(w for w in re.findall(r"[A-Za-z0-9_]{2,}", (t or "").lower()) if w not in retrieval.STOP_WORDS)
    docs = {i: c for i, c in docs.items() if c}
    n, mean_length = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    raw = {w: math.log(n - m + 0.5) - math.log(m + 0.5) for w, m in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    want = {}
    for q, text in asked:
        for i, c in docs.items():
            score = sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean_length)) for w in text.split() if c[w])
            if round(score, 6) > 0:
                want[q, i] = round(score, 6)
    tables = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.query_id, r.doc_id): round(r.score, 6) for r in retrieval.bm25(*tables, 10).collect()}
    assert got == want
    assert {r.token: r.df for r in retrieval.document_frequency(tables[1], "doc_id", "text").collect()} == dict(df)
    assert not retrieval.bm25(tables[0], tables[1].limit(0), 10).collect() and not retrieval.sparse(tables[0], tables[1].limit(0), 10).collect()
