"""Periodic runs against brute force: every stretch of every period, on random, periodic and Fibonacci sequences."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import runs
from tradewind.llm.queries import QUERIES


def brute(w, least=6, times=4):
    n, out, seen = len(w), [], set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q and (i, j + q) not in seen:  # a lesser period of the same stretch came first
                seen.add((i, j + q))
                if j + q - i >= max(least, times * q):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(r, n):
    kind = r.randrange(5)
    if kind < 2:
        return [r.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        return ([r.randrange(2) for _ in range(r.randrange(1, 8))] * n)[:n]
    if kind == 3:
        out = []
        while len(out) < n:
            out += [r.randrange(3) for _ in range(r.randrange(1, 6))] * r.randrange(1, 7)
        return out
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (4, 3)])
def test_all_runs(least, times):
    r = random.Random(least)
    for _ in range(150):
        texts = [np.array(sequence(r, r.randrange(70)), np.int64) for _ in range(r.randrange(1, 12))]
        found = [[] for _ in texts]
        for k, *run in zip(*(x.tolist() for x in runs.runs(texts, least, times))):
            found[k].append(tuple(run))
        assert found == [brute(t.tolist(), least, times) for t in texts]


def test_tree():
    r = random.Random(1)
    texts = [np.array(sequence(r, 50)[:50], np.int64) for _ in range(6)]
    tree = runs.SuffixTree(texts)
    for k, t in enumerate(texts):
        own, at = t.tolist(), int(tree.first[k])
        starts, ends = tree.blocks()
        mine = (tree.owner[starts] == k).nonzero()[0]
        assert starts[mine].tolist() == [at, *ends[mine][:-1].tolist()] and ends[mine][-1] == at + len(own)
        for a, b in zip(starts[mine] - at, ends[mine] - at):
            longest = max((next((m for m in range(len(own) - a) if own[a + m] != own[p + m]), len(own) - a) for p in range(a)), default=0)
            assert b - a == max(1, longest)
        i, j = np.array([r.randrange(50) for _ in range(99)]), np.array([r.randrange(50) for _ in range(99)])
        i, j = i[i != j], j[i != j]
        for x, y, n, m in zip(i, j, tree.ahead(at + i, at + j), tree.behind(at + i, at + j)):
            assert n == next((k for k in range(50 - max(x, y)) if own[x + k] != own[y + k]), 50 - max(x, y))
            assert m == next((k for k in range(min(x, y)) if own[x - 1 - k] != own[y - 1 - k]), min(x, y))
    lo, hi = tree.below(tree.first, np.full(6, 3))
    whole = [(k, p) for k, t in enumerate(texts) for p in range(len(t) - 2)]
    for k, t in enumerate(texts):
        same = {int(tree.first[k]) + p for c, p in whole if c == k and texts[c][p : p + 3].tolist() == t[:3].tolist()}
        assert set(tree.order[lo[k] : hi[k]].tolist()) == same


def test_long_sequences():
    assert [x.tolist() for x in runs.runs([np.zeros(60_000, np.int64)])] == [[0], [0], [60_000], [1]]
    assert [x.tolist() for x in runs.runs([np.tile(np.arange(9000), 5)])] == [[0], [0], [45_000], [9000]]
    assert all(len(x) == 0 for x in runs.runs([np.arange(30_000), np.zeros(0, np.int64)])) and all(len(x) == 0 for x in runs.runs([]))


def test_recurring():
    r = random.Random(4)
    for _ in range(300):
        texts = [np.array(sequence(r, n) if (n := r.randrange(14)) else [], np.int64) for _ in range(r.randrange(5))]
        if r.random() < 0.3:
            texts = [np.arange(len(t)) for t in texts]
        found = np.concatenate([np.zeros(0, np.int64), *texts])
        starts = np.cumsum([0, *map(len, texts)])
        for width in (1, 3, 5):
            grams = [[tuple(t[i : i + width]) for i in range(len(t) - width + 1)] for t in texts]
            assert runs.recurring(found, starts, width).tolist() == [len(set(g)) < len(g) for g in grams]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found, dropped = brute(w), set()
    for s, n, q in found:
        dropped |= set(range(s + q, s + n))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query(spark, sf):
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    rows = QUERIES["op11_runs"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and any(r.n_runs for r in rows)
    for r in rows:
        if len(texts[r.doc_id] or "") < 12_000:
            assert tuple(r) == expected(r.doc_id, texts[r.doc_id])


def test_odd_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "a " * 6), (4, "a " * 6), (5, "a " * 5), (None, "b c " * 4 + "d"), (6, "no-break\xa0space " * 6), (7, "x\x1cy " * 3000 + "end"), (8, "ab a" * 7), (9, "A a " * 3 + "A a")]
    rows += [(i, " ".join(map(str, range(k * k * 20)))) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "length": F.lit("x"), "n_runs": F.lit(2)})
    assert sorted(map(tuple, runs.periodic_runs(docs).collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert runs.periodic_runs(docs.where("false")).collect() == []
