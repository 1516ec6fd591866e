"""Quality rules: gradient-boosted trees over document statistics, beside two fixed base rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tradewind.llm import gbt
from tradewind.llm.shared import crc_remainder, map_batches, text_bytes
from tradewind.llm.textstats import BASE, FEATURES, statistics

#: Labelled rows that a fit takes at most, chosen by a hash of their ids; a fit on more changes little.
SAMPLE = 4_000
#: More of these may only lower a document's score.
FALLING = ("symbol_share", "mark_share", "pipe_share", "dup_line_share", "repeat_word_share")
MIN_WORDS, REPEAT_PERCENT = 50, 50
KEEP = 0.5


def labelled_features(docs: DataFrame, labels: DataFrame, held_out: int, schema: str, features: Callable[[bytes], tuple], modulus: int = 4, rows: int = SAMPLE) -> pd.DataFrame:
    """quality and features of at most `rows` labelled documents whose id is not held out; the same ones on any cluster.

    The ids are chosen first, from the label table alone, where conflicting labels of an id count as the highest and
    null ones not at all. Features are made on the executors, so that no text reaches the driver, however long; null
    texts are empty, and of rows that share an id the least features stand for it.
    """
    known = labels.where("quality is not null and doc_id is not null").where(crc_remainder("doc_id", modulus) != held_out)
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    names = [x.split()[0] for x in schema.split(", ")]
    whole = StructType.fromDDL(f"doc_id long, quality int, {schema}")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(zip(*(features(t) for t in text_bytes(batch))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(c, k) for c, k in zip(found, kinds))], names=["doc_id", "quality", *names])

    kinds = [to_arrow_type(f.dataType) for f in whole.fields[2:]]
    marked = map_batches(got, ["doc_id", "text", "quality"], whole, step)
    return marked.groupBy("doc_id").agg(F.min(F.struct("quality", *names)).alias("m")).select("doc_id", "m.*").toPandas().sort_values("doc_id", ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> gbt.Trees | None:
    """Trees for quality 1; None without labels of both kinds (then only the base rules judge)."""
    got = labelled_features(docs, labels, 2, "dense array<double>", lambda t: (statistics(t)[1],), rows=rows)
    quality = got["quality"].to_numpy(float)
    if len(set(quality.tolist())) < 2:
        return None
    return gbt.fit(np.array(got["dense"].tolist()), quality, monotone={FEATURES.index(f): -1 for f in FALLING})


def judge(docs: DataFrame, trees: gbt.Trees | None) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for every row of docs, over whole texts.

    Base: under 50 words, or over half of the words in repeated three-word windows, fails. A null text has no words
    and fails. Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t)[:2] for t in text_bytes(batch)]
        base = np.array([b for b, _ in found], np.int64)
        score = np.ones(len(found)) if sent.value is None else sent.value.probability(np.array([f for _, f in found]))
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
        columns = [batch.column("doc_id"), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= KEEP))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], schema, step)
