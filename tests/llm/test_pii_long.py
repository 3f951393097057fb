"""Texts full of candidates, planted written-out data, and names that could clash."""

import random
import time

import pytest
from lodestone.llm import pii

from tests.llm.test_pii import brute


@pytest.mark.parametrize("unit", ["10.0.0.1 ", "+1 (234) 555-1234 é\U0001f600 ", "a@b.co x (at) y (dot) zz "])
def test_a_long_text_full_of_candidates(spark, unit):
    text = unit * (400_000 // len(unit))
    df = spark.createDataFrame([(1, text), (2, unit)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone, got[1].base_sha256) == brute(text)[:5]
    masked = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert masked[1] == masked[2] * (400_000 // len(unit))
    assert time.time() - began < 60


def planted(n=600):
    """Texts with personal data in forms that the fixed patterns miss, and with likenesses that are none."""
    rnd = random.Random(5)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    out, truth = [], {}
    for i in range(n):
        kind = i % 6
        real = [f"{rnd.choice(['call', 'phone', 'fax'])} 0{num(2)} {num(4)} {num(4)} now", f"write to joe{num(2)} (at) example{num(1)} (dot) com please", f"host 10 . {rnd.randrange(250)} . 0 . {rnd.randrange(250)} up"]
        other = [f"release 1 . 2 . {rnd.randrange(300, 900)} . {rnd.randrange(300, 900)} of the", f"table 12 of 30 and {num(2)} more", f"look (at) noon or {num(1)} a.m. then"]
        text = (real + other)[kind]
        out.append((i, f"the first words {text} and so on"))
        truth[i] = kind < 3
    return out, truth


def test_spans_beyond_the_base_are_found_with_precision(spark):
    rows, truth = planted()
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(s.base for spans in got.values() for s in spans)
    found = {i: bool(spans) for i, spans in got.items()}
    hits = [i for i, f in found.items() if f]
    assert sum(truth[i] for i in hits) / len(hits) >= pii.PRECISION
    assert sum(truth[i] for i in hits) / sum(truth.values()) > 0.9


def test_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "mail a@b.co", 5, "u", 7)], "doc_id long, text string, _cands int, _spans string, c0 int")
    got = pii.redact(df)
    assert got.columns == df.columns and tuple(got.first()) == (1, "mail [EMAIL]", 5, "u", 7)
