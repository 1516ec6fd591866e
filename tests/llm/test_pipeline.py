"""The pipeline's stages on a small corpus: what goes, what stays, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tradewind.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        text = prose(r, r.randrange(50, 200))
        if i % 7 == 1:
            text += f" mail x{i}@host{i}.example.org"
        if i % 5 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(i % 5 != 0), 0))
    items = [(k, prose(r, 30)) for k in range(5)]
    rows += [(400, rows[1][1]), (401, rows[2][1]), (402, prose(r, 60) + " " + items[3][1]), (403, prose(r, 90) + " mail a.b@c.example.org"), (404, None), (404, None), (None, prose(r, 80)), (405, "")]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).withColumn("score", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {name: {x.doc_id for x in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["quality"] & set(range(0, 300, 5)) == set() and set(range(300)) - set(range(0, 300, 5)) <= ids["quality"]
    assert {400, 401} & ids["near_duplicates"] == set() and {1, 2, None} <= ids["near_duplicates"]
    assert 402 in ids["near_duplicates"] and ids["near_duplicates"] - ids["decontamination"] == {402}
    text = {x.doc_id: x.text for x in seen["personal_data"].collect()}
    assert text[403].endswith("mail [EMAIL]") and ids["personal_data"] == ids["decontamination"] == ids["packing"]


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for f in QUERIES.values():
        assert f(spark, str(tmp_path)).count() == 0


def test_warc_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    rows = QUERIES["op7_warc"](spark, sf)
    found = con.execute(ORACLE_SQL["op7_warc"])
    at = [[c[0] for c in found.description].index(c) for c in rows.columns]
    assert sorted(map(str, (tuple(r) for r in rows.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in found.fetchall())


def test_pipeline_drops_contaminated_texts_without_an_id(spark, tmp_path):
    r = random.Random(3)
    leak, clean = (" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)) for _ in range(2))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, f"start {leak} end"), (None, clean), (None, None), (1, leak), (2, clean)], "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted((str(x.doc_id), str(x.text)) for x in left.collect()) == sorted([("None", clean), ("None", "None"), ("2", clean)])
