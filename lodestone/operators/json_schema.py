"""Schema of JSON values of any nesting, as a table of paths.

A value adds, for each of its paths, what it says there: its type, whether it is filled, how long an array is, how complete an
object. All of these merge by sums, minima and maxima, so tasks combine what they read before anything is
shuffled, Spark combines the rest by (path, type), and neither the order nor the number of merges matters. The root, which
every value has, is one small row of each task.

A path is the keys from the root, each after a slash, ``*`` for the items of an array; in a key, ``~``, ``/`` and ``*`` read
``~0``, ``~1`` and ``~2``. A property is required where every object that could hold it has it, neither null nor an empty string.

Defined results: texts that are null or no JSON say nothing (``invalid`` counts the latter); an empty object is complete to 0;
an array without items is homogeneous; of a repeated key the last counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of types.
TYPES = {"dict": "object", "list": "array", "str": "str", "int": "int", "float": "float", "bool": "bool", "NoneType": "NoneType"}
#: Paths that a task holds before it sends them.
HELD = 50_000

_SUMS = ("n", "filled", "complete", "mixed")
_FIELDS = "path string, parent string, type string, n long, filled long, complete double, mixed long, shortest long, longest long"


def escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1").replace("*", "~2")


def facts(value) -> Iterator[tuple[str, str | None, str, int, float, int, int | None]]:
    """(path, parent, type, filled, completeness, mixed, length) of a value and all below it, without recursion."""
    todo = [("", None, value)]
    while todo:
        path, parent, v = todo.pop()
        kind, filled = TYPES[type(v).__name__], int(v is not None and v != "")
        if isinstance(v, dict):
            yield path, parent, kind, filled, (sum(m is not None and m != "" for m in v.values()) / len(v) if v else 0.0), 0, None
            todo += [(f"{path}/{escaped(k)}", path, m) for k, m in v.items()]
        elif isinstance(v, list):
            yield path, parent, kind, filled, 0.0, int(len({type(m).__name__ for m in v}) > 1), len(v)
            todo += [(f"{path}/*", path, m) for m in v]
        else:
            yield path, parent, kind, filled, 0.0, 0, None


def _part(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}

    def send() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in held.items()]
        held.clear()
        names = ["key", "path", "parent", "type", "n", "filled", "complete", "mixed", "shortest", "longest"]
        kinds = [key_type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    key_type = None
    for batch in batches:
        key_type = batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text is None:
                continue
            try:
                found = list(facts(json.loads(text)))
            except (ValueError, RecursionError):  # no JSON, or nested too deep for the parser
                found = [("", None, "invalid", 0, 0.0, 0, None)]
            for path, parent, kind, filled, complete, mixed, length in found:
                s = held.setdefault((key, path, parent, kind), [0, 0, 0.0, 0, None, None])
                s[0] += 1
                s[1] += filled
                s[2] += complete
                s[3] += mixed
                if length is not None:
                    s[4], s[5] = (length, length) if s[4] is None else (min(s[4], length), max(s[5], length))
            if len(held) >= HELD:
                yield send()
    if held:
        yield send()


def states(df: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """What all values (of each ``key``, if given) say, by path and type; states of parts of a table merge by ``merged``."""
    rows = df.select((F.col(key) if key else F.lit(0)).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return merged(rows.mapInArrow(lambda b: _part(b, kind), f"key {kind}, {_FIELDS}"))


def merged(states: DataFrame) -> DataFrame:
    """One state of many, in any order."""
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return states.groupBy("key", "path", "parent", "type").agg(*sums, F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))


def schema(states: DataFrame) -> DataFrame:
    """(key, path, type, n, filled, parents, required, completeness, homogeneous, min_length, max_length), a row for each path and type.

    ``parents`` counts the objects that could hold the property (null for the root and for items); ``required`` is told for a path,
    so it agrees on all its types.
    """
    objects = states.where("type = 'object'").select("key", F.col("path").alias("parent"), F.col("n").alias("parents"))
    whole = states.groupBy("key", "path").agg(F.sum("filled").alias("all_filled"))
    all_ = states.join(whole, ["key", "path"]).join(objects, ["key", "parent"], "left")
    item = F.col("path").endswith("/*") | (F.col("path") == "")
    object_, array = F.col("type") == "object", F.col("type") == "array"
    return all_.select(
        "key", "path", "type", "n", "filled", F.when(~item, F.col("parents")).alias("parents"), F.when(~item, F.col("all_filled") == F.col("parents")).alias("required"),
        F.when(object_, F.round(F.col("complete") / F.col("n"), 6)).alias("completeness"), F.when(array, F.col("mixed") == 0).alias("homogeneous"),
        F.col("shortest").alias("min_length"), F.col("longest").alias("max_length"),
    )
