"""A total order of nested payloads: text that is the same for equal payloads, however their keys are arranged."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def projected(value: object) -> object:
    """A JSON value with kinds told apart: objects as their sorted pairs, arrays in their order, floats from integers."""
    if isinstance(value, float):
        return {"$float": repr(value)}
    if isinstance(value, dict):
        return {"$dict": sorted(([k, projected(v)] for k, v in value.items()), key=_written)}
    if isinstance(value, list):
        return {"$sequence": [projected(v) for v in value]}
    return value


def _written(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def ordered_text(payload: str | None) -> str | None:
    """The text that payloads are ordered by; one that is no JSON orders as the text it is, none as none."""
    if payload is None:
        return None
    try:
        return _written(projected(json.loads(payload)))
    except (ValueError, RecursionError):
        return _written(payload)


@pandas_udf(StringType())
def payload_key(payloads: pd.Series) -> pd.Series:
    """ordered_text of a column. Spark can sort an object's keys but prints 1 and 1.0 alike, so the text is made in
    Arrow batches; callers send only the payloads that have to be told apart."""
    return payloads.map(ordered_text, na_action="ignore")
