"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import crc_remainder, map_batches, texts

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled rows of a language that a fit takes at most, chosen by a hash of their ids.
SAMPLE = 2_000
UNKNOWN = "und"


def gram_buckets(several: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every character n-gram of all texts, where each text's begin): the rows of a sparse count matrix.

    Texts are lower-cased and begin and end with a space, so none has no n-gram.
    """
    parts = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32) for t in several]
    grams, sizes = [], []
    for p in parts:
        own = []
        h = np.zeros(len(p), np.uint32)
        for n in ORDERS:
            h = (h[: len(p) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + p[n - 1 :] + np.uint32(n)
            own.append(((h * np.uint32(0x9E3779B1)) >> np.uint32(18)) & np.uint32(buckets - 1))
        sizes.append(sum(map(len, own)))
        grams += own
    return np.concatenate(grams) if grams else np.zeros(0, np.uint32), np.cumsum([0, *sizes])


@dataclass
class NaiveBayes:
    languages: list[str]
    log_probability: np.ndarray  # (bucket, language)
    prior: np.ndarray

    def predict(self, several: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and scores; a score is the posterior at the mean evidence of 30 n-grams, so that length does not saturate it."""
        grams, heads = gram_buckets(several)
        sums = np.add.reduceat(self.log_probability[grams], heads[:-1], axis=0).astype(float)
        size = np.diff(heads)[:, None]
        best = (sums + self.prior).argmax(1)
        mild = sums * (30 / np.maximum(size, 30)) + self.prior
        e = np.exp(mild - mild.max(1, keepdims=True))
        chance = e / e.sum(1, keepdims=True)
        return [self.languages[b] for b in best], chance[np.arange(len(best)), best]


def fit(docs: DataFrame, rows: int = SAMPLE) -> NaiveBayes | None:
    """Counts by language and bucket, made on the executors from at most `rows` documents a language whose

    crc32(doc_id) mod 5 is not 0; None without any. The driver gets one row a language and bucket."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null and doc_id is not null").where(crc_remainder("doc_id", 5) != 0)
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    # A row is taken if its hash lies under its language's share, so a sample's size is about `rows`, never a sort.
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, rows / n))))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch)):
            out[lang] = out.get(lang, 0) + np.bincount(gram_buckets([text])[0], minlength=BUCKETS)
        found = [(lang, np.flatnonzero(c), c) for lang, c in out.items()]
        return pa.RecordBatch.from_arrays([pa.array([lang for lang, at, _ in found for _ in at], pa.string()), pa.array(np.concatenate([at for _, at, _ in found]), pa.int64()), pa.array(np.concatenate([c[at] for _, at, c in found]), pa.int64())], names=["lang", "bucket", "n"])

    counts = map_batches(chosen, ["text", "lang"], "lang string, bucket long, n long", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"])) or sorted(sizes)
    table = np.full((BUCKETS, len(languages)), 0.1)
    place = {lang: k for k, lang in enumerate(languages)}
    table[counts["bucket"].to_numpy(np.int64), counts["lang"].map(place).to_numpy(np.int64)] += counts["n"].to_numpy(float)
    seen = np.array([sizes[x] for x in languages], float)
    return NaiveBayes(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(seen / seen.sum()))


def identify(docs: DataFrame, model: NaiveBayes | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, over whole texts.

    A null text, or one without a letter, is `und` with score 0, as is every text without a model. Repeated rows are
    predicted alike; an empty table gives an empty result; only text decides.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        several = texts(batch)
        lang, chance = [UNKNOWN] * len(several), np.zeros(len(several))
        if sent.value is not None:
            some = [i for i, t in enumerate(several) if any(map(str.isalpha, t))]
            group, size = [], 0
            for k, i in enumerate(some):
                group.append(i)
                size += len(several[i])
                if size > 1_000_000 or k == len(some) - 1:
                    found, sure = sent.value.predict([several[j] for j in group])
                    chance[group] = sure
                    for j, x in zip(group, found):
                        lang[j] = x
                    group, size = [], 0
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(chance)], names=["doc_id", "lang_pred", "score"])

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, lang_pred string, score double", step)
    return out.select("doc_id", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
