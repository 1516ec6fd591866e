"""Near-duplicate groups against every pair of shingle sets, the join's guarantee, and odd rows."""

import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import minhash
from tradewind.llm.queries import QUERIES


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """doc_id, n_shingles, component_id for rows of distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 85 * max(len(sets[a]), len(sets[b])) <= 100 * min(len(sets[a]), len(sets[b])):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((i, len(sets[i]), find(i), i == find(i)) for i in sets)


def listed(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def edited(r, words, changes):
    words = list(words)
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**9)}"
    return words


def test_query(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = expected(rows)
    assert listed(QUERIES["op13_minhash"](spark, sf)) == want and any(not r[3] for r in want)


def test_keys_meet_at_one_error_a_chunk():
    r = np.random.default_rng(1)
    signs = r.integers(0, 256, (1, minhash.SYMBOLS)).astype(np.uint8)
    for errors in (0, 1, 5, minhash.RADIUS, 40):
        other = np.repeat(signs, 200, 0)
        for row in other:
            at = r.choice(minhash.SYMBOLS, errors, replace=False)
            row[at] ^= r.integers(1, 256, errors).astype(np.uint8)
        shared = minhash.chunk_keys(other) == minhash.chunk_keys(signs)
        few = ((other != signs).reshape(-1, minhash.CHUNKS, minhash.CHUNK).sum(2) <= 1).any(1)
        assert (shared.any(1) == few).all() and (errors > minhash.RADIUS or few.all())
        first = minhash._first_shared(np.repeat(signs, 200, 0), other)
        assert (first == np.where(shared.any(1) & (errors <= minhash.RADIUS), shared.argmax(1), minhash.SYMBOLS)).all()
    assert len(np.unique(minhash.chunk_keys(r.integers(0, 256, (500, minhash.SYMBOLS)).astype(np.uint8)))) == 500 * minhash.SYMBOLS


def test_signature_distance_at_the_threshold():
    r = random.Random(2)
    apart, bits = [], []
    for _ in range(300):
        n = r.randrange(40, 400)
        own = [r.getrandbits(64) for _ in range(n)]
        both = -(-85 * 2 * n // 185)  # the least intersection of two sets of n that links
        other = own[:both] + [r.getrandbits(64) for _ in range(n - both)]
        fine = [minhash.fine_signature(np.array(sorted(x), np.uint64)) for x in (own, other)]
        bits.append(int(np.bitwise_count(fine[0] ^ fine[1]).sum()))
        apart.append(int((minhash.signature(np.array(sorted(own), np.uint64)) != minhash.signature(np.array(sorted(other), np.uint64))).sum()))
    assert max(apart) <= minhash.RADIUS and 13 < np.mean(apart) < 18
    assert max(bits) <= minhash.FINE_RADIUS and 145 < np.mean(bits) < 160


def test_one_origin_many_copies(spark, monkeypatch):
    """Copies of an origin, alike it or not, chains of copies of copies, and members of one key in several tiles."""
    monkeypatch.setattr(minhash, "TILE", 7)
    monkeypatch.setattr(minhash, "SENT", 0)
    r = random.Random(5)
    origin = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(1000, " ".join(origin))]
    rows += [(i, " ".join(edited(r, origin, 1 + i % 9))) for i in range(120)]
    for i in range(120, 180):
        rows.append((i, " ".join(edited(r, rows[r.randrange(len(rows))][1].split(), 1 + i % 4))))
    want = expected(rows)
    assert 3 < len({x[2] for x in want}) < 150
    assert listed(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == want


def test_edges_of_the_threshold(spark):
    word = [f"v{i}" for i in range(200)]
    rows = []
    for k, n in enumerate(range(4, 60)):  # n + 4 words have n shingles; one more word at the end makes n / (n + 1)
        rows += [(10 * k, " ".join(f"{k}x{w}" for w in word[: n + 4])), (10 * k + 1, " ".join(f"{k}x{w}" for w in word[: n + 4]) + " end")]
    want = expected(rows)
    assert [x[2] for x in want if x[0] in (10, 11, 20, 21)] == [10, 11, 20, 20]
    assert listed(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo "), (6, "one\x1ctwo"), (7, long), (8, long + " end"), (7, "other text of the same id here"), (7, "other text of the same id here"), (None, long), (None, "alone without any id at all"), (9, "É é"), (10, "é é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"own": F.lit(1), "node": F.lit("x"), "kept": F.lit(0), "signature": F.lit(2)})
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 29996, 7, True), (8, 29997, 7, False), (7, 3, 7, True), (7, 3, 7, True), (None, 29996, 7, False), (None, 2, None, True), (9, 1, 9, True), (10, 1, 10, True)]
    assert found == sorted(want, key=str)
    assert minhash.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("text, n", [("a b c d e", 1), ("a b c d e f", 2), ("a b c d", 1), ("a a a a a a a", 1), ("", 0)])
def test_shingle_counts(text, n):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["before this", text, None])], names=["text"])
    assert [len(s) for s in minhash.sets_of_batch(batch)] == [1, n, 0]
