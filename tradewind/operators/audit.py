"""Append-only audit rows: scrubbed details, truncated dead letters, a hash chain that shows tampering."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parts of key names whose values are not stored.
SENSITIVE = ("password", "token", "secret", "authorization", "api_key", "apikey", "credential")
REDACTED = "[redacted]"


def scrub(detail: Column) -> Column:
    """A flat map with the values of sensitive keys replaced; keys stay."""
    return F.transform_values(detail, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), REDACTED).otherwise(v))


def scrub_json(text: Column) -> Column:
    """JSON text with every string, number or literal under a sensitive key replaced, at any depth."""
    key = "|".join(SENSITIVE)
    return F.regexp_replace(text, rf'(?i)("[^"]*(?:{key})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false)', rf'$1"{REDACTED}"')


@F.pandas_udf(StringType())
def scrub_detail(text: pd.Series) -> pd.Series:
    """JSON with every value under a sensitive key replaced, whatever it is, at any depth; other text and null as they are."""

    def clean(value):
        if isinstance(value, dict):
            return {k: REDACTED if any(w in k.lower() for w in SENSITIVE) else clean(v) for k, v in value.items()}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(x: str | None) -> str | None:
        try:
            return x if x is None else json.dumps(clean(json.loads(x)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return x

    return text.map(one)


def dead_letters(failures: DataFrame, error_chars: int = 4000, payload_chars: int = 20_000) -> DataFrame:
    return failures.withColumns({"error": F.substring("error", 1, error_chars), "payload": F.substring(scrub_json(F.col("payload")), 1, payload_chars)})


def chained(rows: DataFrame, stream: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows with row_hash and, within a stream, the hash of the row before: a changed or missing row breaks the next link."""
    own = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    w = Window.partitionBy(stream).orderBy(*order)
    return rows.withColumn("row_hash", own).withColumn("previous_hash", F.coalesce(F.lag("row_hash").over(w), F.lit("")))


def broken_links(rows: DataFrame, stream: str, order: list[str], columns: list[str]) -> DataFrame:
    """The rows of a stored chain whose content or predecessor is not the one recorded."""
    again = chained(rows.drop("row_hash", "previous_hash"), stream, order, columns).select(stream, *order, F.col("row_hash").alias("_h"), F.col("previous_hash").alias("_p"))
    joined = rows.join(again, [stream, *order])
    return joined.where((F.col("row_hash") != F.col("_h")) | (F.col("previous_hash") != F.col("_p"))).select(rows.columns)
