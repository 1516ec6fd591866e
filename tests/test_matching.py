"""Names in texts against one pattern a name and text, and names of any shape."""

import random
import re

import pyarrow as pa
import pytest

from tradewind.operators import matching
from tradewind.plans import matching as plans


def plain(texts, names):
    out = {}
    for i, t in texts:
        for k, name in names:
            low = (name or "").strip().lower()
            if len(low) >= 3 and re.search(r"[0-9a-z]|[^\x00-\x7f]", low):
                n = sum(1 for m in range(len(t or "")) if re.compile(r"(?<![0-9a-z])" + re.escape(low) + r"(?![0-9a-z])").match((t or "").lower(), m))
                if n:
                    out[i, k] = out.get((i, k), 0) + n
    return out


def found(spark, texts, names):
    rows = matching.names_in_texts(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name_id long, name string")).collect()
    return {(r.id, r.name_id): r.n for r in rows}


TEXTS = [
    (1, "Siemens AG and SIEMENS  AG, siemens-ag; Siemens AGs; xSiemens AG; Siemens AG"), (2, "cabbage ABB abb. 3M-long 3m ABB"), (3, "Inc. buys Acme Co., Ltd. of inc.com (Bosch) x(Bosch) ((Bosch))"),
    (4, "中国石油 and 中国石油化工 Ørsted øRSTED xØrsted éØrsted Société Générale SA"), (5, "the long name of one two three four five six seven goes on; one two three four five six sevens"), (6, None), (7, ""), (8, "..Net .net a.net net"), (9, "aa aa aa aa"), (10, "new york new york bank"), (11, "end with name Bosch"), (12, "line\nSiemens\nAG"),
]
NAMES = [
    (1, "Siemens AG"), (2, " siemens "), (3, "ABB"), (4, "3M"), (5, "3M-long"), (6, "Inc."), (7, "Acme Co., Ltd."), (8, "(Bosch)"), (9, "Bosch"), (10, "中国石油"), (11, "Ørsted"), (12, "Société Générale"), (13, "one two three four five six seven"), (14, "one two three four"), (15, ".net"), (16, None), (17, ""),
    (18, "..."), (19, "aa aa"), (20, "new york new york"), (21, "York New"), (22, "one two three four five"), (23, "Siemens\nAG"), (1, "Siemens-AG"), (24, "n +c"), (25, "the long name of one two three four five six seven goes on; one two"),
]


@pytest.mark.parametrize("sent", [0, 200_000])
def test_names_of_any_shape(spark, monkeypatch, sent):
    monkeypatch.setattr(matching, "SENT", sent)
    want = plain(TEXTS, NAMES)
    assert found(spark, TEXTS, NAMES) == want
    assert want[1, 1] == 3 and (3, 6) in want and want[3, 8] == 2 and want[9, 19] == 3 and (5, 13) in want and (4, 11) in want
    assert found(spark, TEXTS, []) == {} and found(spark, [], NAMES) == {}


def test_random_names(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abA1é.-( ") for _ in range(r.randrange(1, 5)))
    texts = [(i, " ".join(word() for _ in range(r.randrange(40)))) for i in range(60)]
    names = [(i, r.choice([" ", "", "-"]).join(word() for _ in range(r.randrange(1, 7)))) for i in range(120)]
    for i in range(60):  # and names cut out of the texts
        t = texts[r.randrange(60)][1]
        a = r.randrange(len(t) + 1)
        names.append((200 + i, t[a : a + r.randrange(3, 25)]))
    want = plain(texts, names)
    assert len(want) > 60 and found(spark, texts, names) == want


def test_bits_keep_what_can_meet(spark):
    """Of places and stretches, those that a name has stay, and hardly any other goes to the shuffle."""
    known = spark.range(5000).selectExpr("concat('k', id) as key")
    rows = spark.range(50_000).selectExpr("id", "concat('k', id) as key")
    left = [r.id for r in matching._likely(rows, "key", known).collect()]
    assert set(range(5000)) <= set(left) and len(left) == len(set(left)) < 5100
    assert matching._likely(rows, "key", known.where("false")).count() == 0


def test_stretches_of_large_tables_are_shuffled_once_a_text(spark, monkeypatch):
    """What the shortest names find stays in its task; the rest is a row a text and stretch, however often it stands there."""
    shuffled, likely = [], matching._likely

    def counted(rows, column, known):
        shuffled.append(rows.count())
        return likely(rows, column, known)

    monkeypatch.setattr(matching, "SENT", 1)
    monkeypatch.setattr(matching, "_likely", counted)
    texts = [(i, "the bank of the river, " * 300 + str(i)) for i in range(20)]
    names = [(1, "the"), (2, "bank of"), (3, "River, The"), (4, "no such name"), (5, "bank robber")]
    got = found(spark, texts, names)
    assert got == {(i, k): n for i in range(20) for k, n in ((1, 600), (2, 300), (3, 299))}
    assert sum(shuffled) <= 20 * 3


def test_texts_of_one_id_are_texts_of_their_own(spark):
    """As in the SQL of the query, where each row of the documents is joined with the names."""
    texts, names = spark.createDataFrame([(1, "ab abc"), (1, "abc"), (2, "")], "id long, text string"), spark.createDataFrame([(7, "abc")], "name_id long, name string")
    assert [tuple(r) for r in matching.names_in_texts(texts, names).collect()] == [(1, 7, 1), (1, 7, 1)]


def bits_of(spark, names):
    keyed = matching.keyed_names(spark.createDataFrame(names, "name_id long, name string"))
    lows = [r.low for r in keyed.collect()]
    signs = {(len(re.match(r"[\x00-/:-`{-\x7f]*", x)[0]), len(re.search(r"[\x00-/:-`{-\x7f]*\Z", x)[0])) for x in lows}
    return matching._bits(keyed, sorted(signs), max(len(x.encode()) for x in lows)), set(lows)


@pytest.mark.parametrize("window", [1, 5, 64])
def test_windows_of_long_texts(spark, monkeypatch, window):
    """A text is looked at in pieces; what stands at their borders is found once, and texts don't run into each other."""
    names = [*NAMES, (30, "\U0001f600 ab"), (31, "é"), (32, "x y"), (33, "\U0001f600é.")]
    known, lows = bits_of(spark, names)
    texts = [t or "" for _, t in TEXTS] + ["x", "y", "", "x y", "\U0001f601 ab \U0001f600 ab", "aé.\U0001f600é. 1\U0001f600é.", "new", "york new york new york " * 9]
    want = {}
    for i, _, n in ((i, k, n) for (i, k), n in plain(list(enumerate(texts)), list(enumerate(sorted(lows)))).items()):
        want[i, sorted(lows)[_]] = n
    column = pa.array(["skipped", *(t.lower() for t in texts)], pa.string())[1:]
    monkeypatch.setattr(matching, "WINDOW", window)
    got = {(i, low.decode()): n for i, held in matching._counted(column, known) for low, n in held.items() if low.decode() in lows}
    assert got == want


def test_names_with_line_ends_and_beyond_the_basic_plane(spark, tmp_path):
    """Names equal but for what SQL trims are one, under the least id; characters of two UTF-16 units are told apart."""
    texts = [(0, "Foobar\r\nx"), (6, "Foobar\ny"), (12, "Quux\nfoobar \U0001f600 zed"), (13, "\U0001f600 zed\nquux"), (19, "\U0001f601 zed\nquux"), (25, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    got = sorted((r.id, r.name_id) for r in plans.names_in_documents(spark, str(tmp_path)).collect())
    assert got == [(0, "doc-0"), (6, "doc-0"), (12, "doc-0"), (12, "doc-12"), (12, "doc-13"), (13, "doc-12"), (13, "doc-13"), (19, "doc-12"), (19, "doc-19")]
