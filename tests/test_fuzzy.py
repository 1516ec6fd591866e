"""Fuzzy names against the edit distance of every pair."""

import random

from tradewind.operators import fuzzy


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_near_name_is_missed(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcé ") for _ in range(n)).strip() or "a"
    left = [word(r.randrange(1, 14)) for _ in range(150)]
    right = [word(r.randrange(1, 14)) for _ in range(100)]
    for name in left[:80]:
        changed = list(name)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(changed) + 1)
            changed[at : at + r.randrange(2)] = r.choice(["", "x", "ab"])
        right.append("".join(changed) or "b")
    want = {(a, b, edits(a, b)) for a in left for b in right if a != b and 4 * edits(a, b) <= max(len(a), len(b))}
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    assert len(want) > 50 and {tuple(x) for x in fuzzy.near_names(frame(left), frame(right)).collect()} == want


def test_long_and_short_names(spark):
    """Names up to 40 characters with as many edits as the ratio allows, or one more, at any place."""
    r = random.Random(9)
    left, right = [], []
    for n in list(range(1, 41)) * 4:
        name = "".join(r.choice("abcdeé f") for _ in range(n)).strip() or "a"
        changed = list(name)
        for _ in range(r.randrange(1, n // 4 + 2)):
            at = r.randrange(len(changed) + 1)
            changed[at : at + r.randrange(2)] = r.choice(["", "x", "yz"])
        left.append(name)
        right.append("".join(changed) or "b")
    want = {(a, b, edits(a, b)) for a in left for b in right if a != b and 4 * edits(a, b) <= max(len(a), len(b))}
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    assert len(want) > 90 and {tuple(x) for x in fuzzy.near_names(frame(left), frame(right)).collect()} == want


def test_few_pairs_meet(spark):
    """Of names of usual letters, one pair in some hundreds is compared; by rare pairs of letters it was one in nine."""
    r = random.Random(2)
    names = lambda n: [("".join(r.choice("eeeeaaatttoniirrsshldcum") for _ in range(r.randrange(5, 24))),) for _ in range(n)]
    left, right = (spark.createDataFrame(names(600), "name string") for _ in range(2))
    assert fuzzy.met(left, right).select("a", "b").distinct().count() < 600 * 600 / 100


def test_resolver(spark):
    companies = spark.createDataFrame([(1, "Siemens AG"), (2, "siemens ag"), (3, "Bosch GmbH"), (4, "Bosch GmbX"), (5, None), (6, "  ")], "company_id long, name string")
    asked = spark.createDataFrame([(1, " SIEMENS AG "), (2, "Siemens A"), (3, "Bosch Gmbh Y"), (4, "Toyota"), (5, None), (6, ""), (7, "Bosch GmbZ"), (7, "Bosch GmbZ")], "request_id long, name string")
    got = sorted((r.request_id, r.company_id, r.confidence) for r in fuzzy.resolve_names(asked, companies).collect() if r.company_id)
    assert got == [(1, 1, 1.0), (2, 1, 0.9), (3, 3, 0.833333), (7, 3, 0.9), (7, 3, 0.9)]
    assert fuzzy.resolve_names(asked, companies).count() == 8 and fuzzy.resolve_names(asked.where("false"), companies).count() == 0
