import hashlib
import re

import numpy as np
from lodestone.llm import pii
from lodestone.llm.common import documents
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text or "") if ok(k, m[0])]
    said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return *[sum(s[0] == k for s in spans) for k in pii.KINDS], hashlib.sha256(said.encode()).hexdigest(), spans


TRICKY = [
    "a@b.c_d@e.f x@y.z.w. @a.b a@b a.b@c-d.e-f",
    "é\U0001f600 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3 999.1.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1111 5500000000000004  12345678901234567890 4111 1111 1111 1112",
    "+1 (234) 555-1234, +44.20.7946.0958) +1 2 +12345678901234567 ++49 30 1234567-",
    "joe (at) example (dot) com and 020 7946 0958 or 10 . 0 . 0 . 1",
    "1 " * 20000,
    "7" * 30000,
    "a" * 50000,
    "a." * 20000 + "@",
    "+1 " + "(" * 20000,
    "x@y.zz " * 1500,
]


def test_base_matches_brute_force(spark, sf, odd_documents):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for docs in (tricky, odd_documents, documents(spark, sf)):
        got = {}
        for r in pii.digest(pii.find(docs)).collect():
            *want, spans = brute({x.doc_id: x.text for x in docs.collect()}[r.doc_id]) if docs is tricky else (None, None)
            got.setdefault(r.doc_id, []).append((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256))
            if docs is tricky:
                assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r.spans.split(",")) | {""}
        want = {}
        for r in docs.collect():
            want.setdefault(r.doc_id, []).append(brute(r.text)[:5])
        assert got == want
        assert pii.find(docs.limit(0)).count() == 0


def test_trees_learn_and_the_column_agrees(spark):
    rnd = np.random.default_rng(1)
    codes = rnd.choice(pii.PATTERNS, 400, replace=False)
    x = pii.features_of(codes)
    truth = (x[:, 1] == 4) & (x[:, 3] == 0) | (x[:, 5] == 1)
    n = rnd.integers(1, 50, 400).astype(float)
    prior, trees = pii.fit_trees(x, np.where(truth, n, 0), np.where(truth, 0, n), trees=60)
    model = pii.Model(prior, trees, 1.0, 0.0, [0.5] * 4)
    p = model.probability(x)
    assert ((p > 0.5) == truth).mean() > 0.95
    df = spark.createDataFrame([(int(c),) for c in codes], "code int").select("code", model.column(F.col("code")).alias("p"))
    got = {r.code: r.p for r in df.collect()}
    assert all(abs(got[int(c)] - q) < 1e-9 for c, q in zip(codes, p, strict=True))


def test_redaction(spark):
    rows = [(1, "mail a@b.co or +1 (234) 555-1234 é", "x"), (2, None, "y"), (3, "clean", "z"), (4, "+4111111111111111 x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL] or [PHONE] é", 2: None, 3: "clean", 4: "+[CARD] x"}
