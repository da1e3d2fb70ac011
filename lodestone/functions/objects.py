"""JSON objects as their writers meant them: keys have an order, and of a repeated key the last value counts.

VARIANT keeps neither, so payloads are read here in Arrow batches and handed on as JSON without repeats, or as rows in their order.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: str | None) -> tuple[Any, bool]:
    """(value, True), or (None, False) if it is no JSON. NaN and infinities, which some writers use, are null."""
    try:
        return json.loads(text, parse_constant=lambda _: None), True
    except (TypeError, ValueError, RecursionError):
        return None, False


def unique_keys(payload: Column) -> Column:
    """The payload with the last value of each repeated key; null if it is no JSON."""

    @F.pandas_udf("string")
    def write(texts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(value) if good else None for value, good in map(parsed, texts)], dtype=object)

    return write(payload)


CELLS = "array<struct<place:int,raw_target:string,raw_facet:string,ids:array<string>>>"


def covered_cells(payload: Column) -> Column:
    """The lists in payload.covered[target][facet], in the order of the keys; a repeated key stays where it was first and has its last value."""

    def cells(text: str | None) -> list[dict]:
        value, _ = parsed(text)
        covered = value.get("covered") if isinstance(value, dict) else None
        pairs = [(t, f, ids) for t, facets in (covered if isinstance(covered, dict) else {}).items() if isinstance(facets, dict) for f, ids in facets.items() if isinstance(ids, list)]
        return [{"place": i, "raw_target": t, "raw_facet": f, "ids": [x for x in ids if isinstance(x, str)]} for i, (t, f, ids) in enumerate(pairs)]

    @F.pandas_udf(CELLS)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(cells)

    return read(payload)
