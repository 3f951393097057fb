"""The decorator that registers a query with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir)``; ``sql`` is None where SQL cannot say it and a test holds it instead."""

    def add(f: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = re.sub(r"\b([a-z]\w*) -> ", r"lambda \1: ", sql)
        return f

    return add
