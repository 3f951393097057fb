import importlib.util

import __spark_entry__ as entry


def test_names_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_stands_without_the_training_data_part(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("lodestone.llm", "corpus_pipeline") else found(name, *a))
    assert not any(k.startswith("op") or k == "pipeline" for k in entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"] and out.count() > 0
