"""Where Spark's functions and SQL's differ by a hair: halves that are rounded, letters at a word's edge."""

from datetime import datetime, timedelta

import duckdb

from tradewind.plans import ORACLE_SQL, QUERIES


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over tables of a few rows."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())


def test_seconds_to_wait_are_rounded(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(3 * k + i, k, "error", at + timedelta(seconds=60 * i, microseconds=m if i == 2 else 0)) for k, m in enumerate((0, 499_999, 500_000, 500_001, 999_999)) for i in range(3)]
    got, want = both(spark, tmp_path, "failure_throttle", events=(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz"))
    assert got == want and [x[3] for x in got if x[3]] == [7080, 7080, 7080, 7079, 7079]


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def orders(*prices):
    return [(k, 1, "O", p, datetime(1998, 7, 30 - k % 20), "1-URGENT") for k, p in enumerate(prices, 1)], ORDERS


def test_halves_of_a_thousandth_in_a_feed_that_is_read(spark, tmp_path):
    got, want = both(spark, tmp_path, "feed_read", orders=orders(80507.0, 80507.5, 80508.0, 1000.5))
    assert got == want


def test_names_end_before_letters_beyond_ascii(spark, tmp_path):
    texts = ["Kraft Coût de la vie", "Muster\vWerk AG", "ÉAcme Group", "Acme Corp. x", "Acme Corp.x", "Café SA", "Foo  Bar\tLtd.é"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts, 24)]
    got, want = both(spark, tmp_path, "supplier_extraction", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert got == want and got[0][1].endswith("Kraft Co")


HALVES = (950.0, 900.0, 80507.0, 80507.5, 80508.0, 1508.5, 510.5)


def test_halves_of_a_thousandth_in_topped_up_feeds(spark, tmp_path):
    more = {"customer": ([(1, 0, "BUILDING")], "c_custkey long, c_nationkey int, c_mktsegment string"), "nation": ([(0, "X", 0)], "n_nationkey int, n_name string, n_regionkey int"), "region": ([(0, "Y")], "r_regionkey int, r_name string")}
    got, want = both(spark, tmp_path, "feed_topped_up", orders=orders(*HALVES), **more)
    assert got == want and len(got) >= 7


def test_halves_of_a_thousandth_in_pages(spark, tmp_path):
    got, want = both(spark, tmp_path, "paging_totals", orders=orders(*HALVES))
    assert got == want and len(got) == 4
