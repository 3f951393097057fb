"""Conflicts in whole texts, against brute force."""

import itertools
import re

from lodestone.operators import conflicts
from lodestone.plans import analysis_queries, catalog

PLANTED = {0: "You must not enable this; it is deprecated. ", 1: "You must always use the recommended way. ", 2: "Never do that, disable it instead. "}
FAR = "plain words " * 400


def said(text):
    return sum(w in text.lower() for w in conflicts.INDICATORS)


def holds(text, phrase):
    low = text.lower()
    if phrase in ("must", "should"):
        low = re.sub(rf"\b{phrase}\s+not\b", " ", low)
    return re.search(rf"\b{phrase}\b", low) is not None


def brute(rows):
    out = {}
    for x, y in itertools.combinations(sorted(rows, key=lambda r: r["doc_id"]), 2):
        ex, ey = ({e.lower().strip() for e in r["entities"]} for r in (x, y))
        if not ex & ey or min(len(x["text"]), len(y["text"])) < 10 or x["text"] == y["text"]:
            continue
        shared, n = len(ex & ey) / len(ex | ey), said(x["text"]) + said(y["text"])
        text = min(1.0, shared * n / 10) if shared > 0.3 and n else 0.0
        h = lambda r, p: holds(r["text"], p)
        opposites = ",".join(str(k) for k, (p, q) in enumerate(conflicts.OPPOSITES) if (h(x, p) and h(y, q)) or (h(x, q) and h(y, p)))
        if text or opposites:
            out[x["doc_id"], y["doc_id"]] = (round(text, 6), opposites)
    return out


def found(df):
    return {(r.a, r.b): (r.text_confidence, r.opposites) for r in df.collect() if r.text_confidence or r.opposites}


def test_phrases_far_into_a_text_count(spark):
    texts = ["You must enable it. ", FAR + "it must not be so; disable it, avoid it", FAR + FAR + "you should always allow that", FAR + "should not, never; deny it"]
    rows = [(k, t, ["Entity 1", "Org 1"], "git", "en", 0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities array<string>, source_type string, project_id string, created_day long")
    want = brute([r.asDict() for r in df.collect()])
    assert want[0, 1][1] == "0,2" and want[2, 3][1] == "1,3,6"
    assert found(conflicts.detect(df)) == want


def test_queries_read_whole_texts(spark, sf):
    rows = [r.asDict() for r in analysis_queries.results(spark, sf).select("doc_id", "text", "entities").collect()]
    for r in rows:
        r["text"] = PLANTED.get(r["doc_id"] % 5, "") + r["text"]
    assert max(len(r["text"]) for r in rows) > 1000
    assert found(catalog.QUERIES["conflict_detect_whole"](spark, sf)) == brute(rows)
    at = {r["doc_id"]: r["text"].lower().find("enable") for r in rows}
    want = {r["doc_id"]: r["text"][max(0, at[r["doc_id"]] - 40) :][:86] if at[r["doc_id"]] >= 0 else None for r in rows}
    assert {r.doc_id: r.snippet for r in catalog.QUERIES["conflict_snippets_whole"](spark, sf).collect()} == want


def test_snippets_past_the_first_characters(spark, tmp_path):
    text = FAR + "now enable it " + FAR
    docs = spark.createDataFrame([(3, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["conflict_snippets_whole"](spark, str(tmp_path)).first().snippet
    at = text.index("enable")
    assert got == text[at - 40 : at + 46]
