"""Stages of the pipeline on nulls, repeats, clashing columns, very long texts and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm import packing, pii, quality_model
from tradewind.llm.shared import written

LONG = "word " * 60_000
ROWS = [(1, None), (2, ""), (3, "jo.b@mail.example.com"), (3, "jo.b@mail.example.com"), (None, "call +1 (212) 555-0187 now"), (4, LONG + "jo@x.example.com"), (5, "card 4111 1111 1111 1111 ip 10.0.0.1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"spans": F.lit("x"), "base": F.lit(1), "piece": F.lit(2), "score": F.lit(0.5), "a.b": F.lit("dot"), "ids": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    good = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60 + i)), "en", "s", 0) for i in range(60)]
    bad = [(100 + i, "### $$$ " * (5 + i), "en", "s", 0) for i in range(60)]
    spark.createDataFrame(good + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "some words that no text of these holds at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_redact(docs):
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(0, "call [PHONE] now", 16), (1, None, None), (2, "", 0), (3, "[EMAIL]", 7), (3, "[EMAIL]", 7), (4, LONG + "[EMAIL]", len(LONG) + 7), (5, "card [CARD] ip [IP]", 19)]
    assert got == sorted(want, key=str)
    assert all(r["a.b"] == "dot" and r.spans == "x" and r.base == 1 for r in out.collect())
    assert pii.redact(docs.where("false")).collect() == [] and pii.redact(docs.drop("n_chars")).count() == len(ROWS)


def test_overlapping_spans():
    assert pii.redact_text("abcdefgh", [(1, 0, 4), (2, 1, 6), (7, 3, 8)]) == "a[EMAIL]g[PHONE]"
    assert pii.redact_text("abc", []) == "abc" and pii.redact_text("abc", [(0, 2, 3)]) == "[CARD]"


def test_keep_good(spark, docs, labelled):
    table = lambda n: spark.read.parquet(f"{labelled}/{n}.parquet")
    machine = quality_model.fit(table("documents"), table("labels"))
    kept = quality_model.keep_good(docs, machine)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert set(left) <= {i for i, _ in ROWS} and left.count(3) in (0, 2)  # repeated rows share their fate
    assert quality_model.keep_good(docs.where("false"), machine).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, docs, labelled, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, labelled)
    if k < 4:
        assert set(out.columns) == set(docs.columns)
        assert written(out, name).count() <= len(ROWS)  # as the next stage reads it
    else:
        found = out.collect()
        assert {r.doc_id for r in found} == {i for i, _ in ROWS} and sum(r.doc_id == 3 for r in found) == 2
        assert max(r.piece for r in found if r.doc_id == 4) >= 1
    assert stage(spark, docs.where("false"), labelled).count() == 0


def test_sequences_hold_whole_pieces(spark, docs):
    found = packing.pack(packing.token_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")).collect()
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
