"""Loose candidates are learnt from a check of their own normal form, and added."""

from lodestone.llm import pii
from pyspark.sql import functions as F

GOOD = {"phone": "020 7946 0958", "email": "joe (at) example (dot) com", "ip": "10 . 0 . 0 . 1"}
BAD = "host 999 . 1 . 1 . 300 x"


def docs(spark):
    rows = [f"{word} {GOOD[kind]} now" for word, kind in (("call", "phone"), ("write", "email"), ("host", "ip"))]
    return spark.createDataFrame([(i, rows[i % 3]) for i in range(150)], "doc_id long, text string")


def test_written_out_forms_are_added(spark):
    found = {r.doc_id: r.spans for r in pii.find(docs(spark)).collect()}
    for i, kind in enumerate(GOOD):
        at = len(("call ", "write ", "host ")[i])
        spans = [(pii.KINDS[s.kind], s.start, s.end) for s in found[i]]
        assert spans == [(kind, at, at + len(GOOD[kind]))]
        assert not found[i][0].base


def test_redacts_them(spark):
    got = {r.doc_id: r.text for r in pii.redact(docs(spark)).collect()}
    assert [got[i] for i in range(3)] == ["call [PHONE] now", "write [EMAIL] now", "host [IP] now"]


def test_normal_form_decides(spark):
    rows = [(1, BAD), (2, "(017) 555-7713"), (3, "4111.1111.1111.1112"), (4, "4111/1111/1111/1111"), (5, "10[.]0[.]0[.]1"), (6, "12-3456-789")]
    c = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(pii.candidates(F.col("text"))).alias("c"))
    ok = {}
    for r in c.where("NOT c.base").collect():
        ok.setdefault((r.doc_id, pii.KINDS[r.c.kind]), []).append(r.c.ok)
    assert ok[1, "ip"] == [False] and ok[5, "ip"] == [True]
    assert ok[2, "phone"] == [True] and ok[6, "phone"] == [True]
    assert ok[3, "card"] == [False] and ok[4, "card"] == [True]
    assert not {"digits", "size"} & set(pii.FEATURES)
