"""Slices of the batches that Spark hands to Python: what a few rows become is sent on before more are made."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows whose results are held at once.
SLICE = 128


def slices(batches: Iterator, rows: int = SLICE) -> Iterator[tuple[pd.Series, ...]]:
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        for at in range(0, len(columns[0]), rows):
            yield tuple(c.iloc[at : at + rows] for c in columns)
