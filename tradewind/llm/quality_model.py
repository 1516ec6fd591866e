"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.quality_rules import SAMPLE, labelled_features
from tradewind.llm.shared import crc_remainder, map_batches, text_bytes
from tradewind.llm.textstats import FEATURES, statistics

WORD_BUCKETS = 1 << 15
RANK = 6
PREDICT = 0.7


def features(text: bytes, buckets: int = WORD_BUCKETS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(word buckets, their weights of unit length, statistics): a sparse row and a dense one."""
    _, dense, words = statistics(text)
    found, count = np.unique(np.fromiter(map(crc32, words), np.int64, len(words)) % buckets, return_counts=True)
    weight = np.sqrt(count)
    return found, weight / max(float(np.sqrt((weight**2).sum())), 1.0), dense


@dataclass
class Machine:
    """score = w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2): pairwise interactions of rank f in linear time."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, several: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Indices and values; the statistics follow the word buckets, standardised and bounded."""
        first = len(self.w) - len(self.mean)
        return [self.row(*features(text, first)) for text in several]

    def row(self, found: np.ndarray, weight: np.ndarray, dense: list[float]) -> tuple[np.ndarray, np.ndarray]:
        dense_at = np.arange(len(self.w) - len(self.mean), len(self.w))
        return np.concatenate([found, dense_at]), np.concatenate([weight, np.clip((np.array(dense) - self.mean) / self.scale, -4, 4)])

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        heads = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        vx = self.v[at] * x[:, None]
        pairs = np.add.reduceat(vx, heads, axis=0) ** 2 - np.add.reduceat(vx**2, heads, axis=0)
        return self.w0 + np.add.reduceat(self.w[at] * x, heads) + 0.5 * pairs.sum(1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, epochs: int = 12, seed: int = 3) -> Machine | None:
    """A machine for quality 1, by Adagrad on at most `rows` labelled documents whose crc32(doc_id) mod 4 is not 2.

    None without labels of both kinds. Only texts and qualities are used.
    """
    got = labelled_features(docs, labels, 2, "found array<bigint>, weight array<double>, dense array<double>", features, rows=rows)
    quality = got["quality"].to_numpy(float)
    if len(set(quality.tolist())) < 2:
        return None
    dense = np.array(got["dense"].tolist())
    r = np.random.default_rng(seed)
    size = WORD_BUCKETS + len(FEATURES)
    machine = Machine(0.0, np.zeros(size), r.standard_normal((size, RANK)) * 0.02, dense.mean(0), dense.std(0) + 0.05 * np.abs(dense.mean(0)) + 0.01)
    data = [machine.row(np.asarray(f, np.int64), np.asarray(w, float), d) for f, w, d in zip(got["found"], got["weight"], got["dense"])]
    seen_w, seen_v, seen_0 = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    even = np.where(quality == 1, 0.5 / max(quality.mean(), 1e-3), 0.5 / max(1 - quality.mean(), 1e-3))
    for _ in range(epochs):
        order = r.permutation(len(data))
        for part in np.array_split(order, max(1, len(order) // 32)):
            chosen = [data[i] for i in part]
            at, x = np.concatenate([c[0] for c in chosen]), np.concatenate([c[1] for c in chosen])
            row = np.repeat(np.arange(len(part)), [len(c[0]) for c in chosen])
            error = (1 / (1 + np.exp(-np.clip(machine.logits(chosen), -30, 30))) - quality[part]) * even[part] / len(part)
            vx = machine.v[at] * x[:, None]
            sums = np.zeros((len(part), RANK))
            np.add.at(sums, row, vx)
            used, back = np.unique(at, return_inverse=True)
            g_w, g_v = np.bincount(back, error[row] * x, len(used)), np.zeros((len(used), RANK))
            np.add.at(g_v, back, (error[row] * x)[:, None] * (sums[row] - vx))
            g_w += 1e-5 * machine.w[used]
            g_v += 1e-4 * machine.v[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            seen_0 += error.sum() ** 2
            machine.w[used] -= 0.1 * g_w / np.sqrt(seen_w[used])
            machine.v[used] -= 0.03 * g_v / np.sqrt(seen_v[used])
            machine.w0 -= 0.1 * error.sum() / np.sqrt(seen_0)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 up) for every row of docs, over whole texts.

    A null text is scored as an empty one. Without a machine every score is 1. Repeated rows score alike; an empty
    table gives an empty result; no column but doc_id and text is read, and doc_id only names the row.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        several, scores = text_bytes(batch), []
        for at in range(0, len(several), 256):
            part = several[at : at + 256]
            scores.append(np.ones(len(part)) if sent.value is None else 1 / (1 + np.exp(-np.clip(sent.value.logits(sent.value.rows(part)), -30, 30))))
        found = np.concatenate(scores)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= PREDICT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, score double, predicted int", step)
    return out.select("doc_id", (F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """The documents predicted 1, with their columns; a document is judged by its text, so rows that share an id may part."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if sent.value is None:
            return batch
        several, kept = text_bytes(batch), []
        for at in range(0, len(several), 256):
            logits = sent.value.logits(sent.value.rows(several[at : at + 256]))
            kept.append(1 / (1 + np.exp(-np.clip(logits, -30, 30))) >= PREDICT)
        return batch.filter(pa.array(np.concatenate(kept)))

    return map_batches(docs, docs.columns, docs.schema, step)
