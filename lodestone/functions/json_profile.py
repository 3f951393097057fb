"""Profile of JSON values of any depth: depth, elements, complexity and a histogram of types (Arrow batches)."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE = "depth int, elements long, complexity double, types map<string,int>"
#: What a value adds to a complexity, and what part of its members' complexity counts.
OBJECT_PART, ARRAY_PART, SCALAR = 0.5, 0.3, 0.1


def profile_of(value) -> tuple[int, int, float, dict[str, int]]:
    """Without recursion, so that no depth of nesting ends it: what weight a member has is known on the way down."""
    deepest = elements = 0
    complexity, types = 0.0, Counter()
    todo = [(value, 0, 1.0)]
    while todo:
        v, depth, weight = todo.pop()
        deepest, elements = max(deepest, depth), elements + 1
        types["number" if isinstance(v, int | float) and not isinstance(v, bool) else {"dict": "object", "list": "array", "str": "string", "bool": "boolean", "NoneType": "null"}[type(v).__name__]] += 1
        if isinstance(v, dict | list):
            complexity += weight
            members, part = (v.values(), OBJECT_PART) if isinstance(v, dict) else (v, ARRAY_PART)
            todo += [(m, depth + 1, weight * part) for m in members]
        else:
            complexity += weight * SCALAR
    return deepest, elements, complexity, dict(types)


def profile(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, depth, elements, complexity, types); nulls where the text is null or no JSON."""

    @F.pandas_udf(PROFILE)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append(profile_of(json.loads(t)) if t is not None else (None,) * 4)
            except (ValueError, RecursionError):
                rows.append((None,) * 4)
        out = pd.DataFrame(rows, columns=["depth", "elements", "complexity", "types"])
        return out.astype({"depth": "Int32", "elements": "Int64", "complexity": "Float64"})

    return df.select(key, of(text).alias("p")).select(key, "p.*")
