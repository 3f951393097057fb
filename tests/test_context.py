"""Lookup steps, relaxation and behaviour by hand."""

import pytest
from lodestone.operators import behaviour, lookup


def test_lookup_steps_in_order(spark):
    docs = spark.createDataFrame([(3, "d-3", "git", "API v1.2 Guide"), (1, "d-1", "jira", "API v1.2 Guide"), (2, "d 2", None, "C++ notes"), (4, None, "git", None), (5, "x\\Ey", "git", "Ünïcode Äpfel")], "doc_id long, document_id string, source_type string, source_title string")
    asks = {
        "d-3": (3, 1), "API v1.2 Guide": (1, 1), "git:API v1.2 Guide": (3, 1), "unknown:C++ notes": (2, 1), " d-1\n": (1, 2), "JIRA api V1.2-guide": (1, 3), "D_3": (3, 3), "v1.2 guide": (1, 4), "1.2": None, "c++": None, "c++ notes": (2, 3),
        "v1": (1, 4), "v": None, "äpfel": (5, 4), "other:C++ notes": (2, 5), "other: C++ notes": None, "none": None, "": None, None: None, "+++": None, "git:": (4, 1), "x\\ey": (5, 3),
    }
    ids = spark.createDataFrame([(i,) for i in [*asks, "d-3"]], "id string")
    got = {r.id: (r.doc_id, r.step) for r in lookup.find(ids, docs).collect()}
    # Boundary rules see "c++ " of "c++ notes": a sign before a space is no boundary of words, the space is a separator.
    want = {i: a for i, a in asks.items() if a} | {"c++": (2, 4)}
    assert got == want
    assert lookup.find(ids.limit(0), docs).count() == 0 and lookup.find(ids, docs.limit(0)).count() == 0


def test_only_unanswered_queries_are_relaxed(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta alpha"), (3, "the alpha of beta"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Alpha beta"), (2, "the alpha, beta and gamma delta epsilon"), (3, "alpha beta zeta eta"), (4, "nothing here"), (5, None), (6, "the of"), (7, "the phase of")], "query_id long, text string")
    got = sorted(map(tuple, lookup.targets(queries, docs).collect()))
    assert got == [(1, 0, 2), (2, 1, 1), (3, 2, 2), (6, 0, 3)]


def test_sessions_and_weights(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "a"), (2, "2024-01-01 00:30:00", 7, "b"), (3, "2024-01-01 01:00:01", 7, "a"), (4, "2024-01-01 00:10:00", 8, "a"), (5, "2024-01-01 00:10:00", 8, "c")]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, intent string").selectExpr("event_id", "CAST(ts AS TIMESTAMP) ts", "user_id", "intent")
    s = behaviour.sessions(e)
    assert {r.event_id: r.session for r in s.collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {(r.from_intent, r.to_intent): (r.n, r.share) for r in behaviour.transitions(s).collect()} == {("a", "b"): (1, 0.5), ("a", "c"): (1, 0.5)}
    assert {r.event_id: r.previous for r in behaviour.before(s).collect()} == {1: [], 2: ["a"], 3: [], 4: [], 5: ["a"]}
    scores = spark.createDataFrame([(1, i, 1.0) for i in ("procedural", "technical_lookup", "troubleshooting", "exploratory")] + [(2, "procedural", 0.5), (3, "procedural", 0.5)], "query_id long, intent string, score double")
    contexts = spark.createDataFrame([(1, ["informational", "procedural", "procedural"], "technical", "engineer", "high"), (2, None, None, None, None)], "query_id long, previous array<string>, domain string, role string, urgency string")
    got = {(r.query_id, r.intent): r.score for r in behaviour.weighted(scores, contexts).collect()}
    fits = {"technical": 1.0, "learning": 1.0, "problem": 2 / 3}
    assert got[1, "procedural"] == pytest.approx(1.3 * 1.3 * 1.2 * 1.2 * 1.1 * 1.2, abs=1e-6) and fits
    assert got[1, "technical_lookup"] == pytest.approx(1.2 * 1.3 * 1.2 * 1.3 * 1.2, abs=1e-6)
    assert got[1, "troubleshooting"] == pytest.approx(1.2 * 1.2 * 1.4, abs=1e-6) and got[1, "exploratory"] == pytest.approx(1.3, abs=1e-6)
    assert got[2, "procedural"] == got[3, "procedural"] == 0.5
