"""Spelling variants against brute force over every pair of words, and odd tables."""

import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tradewind.llm import spelling
from tradewind.llm.queries import QUERIES

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected(words):
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    forms, rows = {}, []
    for w, n in words.items():
        found = [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by.get(size, []) if near(w, x)]
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        rows.append((w, n, len(found)))
    out = []
    for w, n, k in rows:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, k, words[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def listed(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_query(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = expected(counted(rows))
    assert listed(QUERIES["op12_spelling"](spark, sf)) == want
    assert sum(r[1] is not None for r in want) >= 10 and max(r[4] for r in want) > 1


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "key": F.lit(2)})


def test_letters_ties_chains_and_repeats(spark):
    common, some, rare = "abcdefgh ", "abcdefgx ", "abcdefgxy "
    texts = [
        (1, common * 500 + some * 40 + rare * 3), (2, "aaaaaaaa " * 3 + "aaaaaaa " * 30 + "aaaaaaaaa " * 2), (3, "ÀÉ×÷ÿàé " * 20 + "ÀÉ×÷ÿàê " * 2 + "àé×÷ÿàé " * 2),
        (4, "tiesone tiestwo " * 2 + "zzzzzzz bzzzzzz azzzzzz " * 20 + "czzzzzz " * 2), (4, "Tiesone"), (4, None), (5, ""), (6, "中" * 9 + " once1234567 shortİabcdefgh \U0001f642abcdefgh"), (None, "abcdefgh abcdefgx without"), (None, "without"), (7, "verylongword" * 2000 + " " + "verylongword" * 2000),
    ]
    want = expected(counted(texts))
    assert listed(spelling.variants(table(spark, texts))) == want
    by = {r[0]: r for r in want}
    assert by["abcdefgxy"][1:3] == ("abcdefgx", "abcdefgh") and by["czzzzzz"][1] == "azzzzzz"


def test_random_words(spark):
    import random

    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(7, 10))) for _ in range(700)}
    counts = {w: r.choice([2, 3, 5, 30, 300, 4000]) for w in words}
    found = spelling.nearest(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    want = {w: (k, f) for w, f, _, n, k, _ in expected(counts)}
    assert {r.word: (r.n_near, r.best.word if r.best and -r.best.less >= 10 * r.n else None) for r in found} == want


def test_empty(spark):
    assert spelling.variants(table(spark, [])).collect() == [] and spelling.variants(table(spark, [(1, None), (2, "few words")])).columns == COLUMNS
