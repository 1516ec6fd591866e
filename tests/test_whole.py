"""Queries read all of their input: whole texts, every customer, order and supplier."""

import random

from tradewind.operators import enrich, personal
from tradewind.plans import QUERIES


def test_every_customer_has_preferences(spark, sf):
    kinds = {r.kind: r.users for r in QUERIES["preference_kinds"](spark, sf).collect()}
    assert sum(kinds.values()) == spark.read.parquet(f"{sf}/customer.parquet").count() and kinds["all"] > 0


def test_feeds_by_profile(spark):
    """Two users of one profile get one list of 50, a user without interests gets all kinds, an exclusion holds."""
    a = [(i, i, ["automotive"] if i % 2 else ["chips"], ["toyota"] if i % 10 == 1 else [], [], []) for i in range(200)]
    arts = spark.createDataFrame(a, "id long, processed_at long, categories array<string>, suppliers array<string>, regions array<string>, signals array<string>")
    u = [(1, ["automotive"], [], [], [], ["toyota"]), (2, ["automotive"], [], [], [], ["toyota"]), (3, [], [], [], [], [])]
    users = spark.createDataFrame(u, "user_id long, wanted_categories array<string>, wanted_suppliers array<string>, wanted_regions array<string>, wanted_signals array<string>, excluded_suppliers array<string>")
    got = {}
    for r in personal.feeds(arts, users).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.id)
    assert got[1] == got[2] == [i for i in range(199, 0, -2) if i % 10 != 1][:50]
    assert got[3] == list(range(199, 149, -1))


def test_texts_past_two_thousand_characters(spark, tmp_path):
    text = "Quiet first line\nQuiet second line\n" + "filler words here and " * 200 + "a port strike in Poland by Nexans"
    spark.createDataFrame([(24, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "<p>" + "word " * 1000 + "end</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("signal_classifier", "region_extraction", "bounded_phrases", "search", "token_estimates", "deterministic_analysis", "risk_events_detected", "page_plain_text")}
    assert {r.signal_type for r in got["signal_classifier"]} and [r.regions for r in got["region_extraction"]] != [""]
    assert [r.id for r in got["bounded_phrases"]] == [r.id for r in got["search"]] == [24]
    assert got["token_estimates"][0].tokens > 400 + len(text) // 4
    assert got["deterministic_analysis"][0].n_suppliers >= 1 and "strike" in {r.risk_type for r in got["risk_events_detected"]}
    assert got["page_plain_text"][0].text.endswith("word end")


def test_every_designation_is_screened_and_every_event_kept(spark, sf):
    screened = {r.designation_id for r in QUERIES["designation_screening"](spark, sf).collect()}
    assert screened == {r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    kept = sorted(r.event_key for r in QUERIES["risk_upsert"](spark, sf).collect())
    assert kept == sorted(r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect())


def test_watchlists_hold_the_entries_of_all_orders(spark, sf):
    want = {(r.o_custkey, r.o_orderkey % 100 + 1) for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    assert sum(r.members for r in QUERIES["watchlist_sizes"](spark, sf).collect()) == len(want)


def test_reservation_by_brute_force_without_gathering(spark):
    """Against the fold, ties and repeated rows too; the plan gathers no run into an array."""
    r = random.Random(5)
    rows = [(f"r{r.randrange(30)}", r.randrange(40), r.choice((400, 900, 1500, 2500, 4000, 7000))) for _ in range(900)]
    want = set()
    for run in {x[0] for x in rows}:
        calls = used = 0
        for _, place, tokens in sorted(x for x in rows if x[0] == run):
            if calls < 5 and used + tokens <= 6000:
                calls, used = calls + 1, used + tokens
                want.add((run, place))
    got = enrich.reserve(spark.createDataFrame(rows, "run string, place long, tokens long"), "run", "place", "tokens")
    assert "collect_list" not in got._jdf.queryExecution().toString()
    found = got.collect()
    assert len(found) == len(rows) and {(x.run, x.place) for x in found if x.reserved} == want
    assert all(x.reserved == ((x.run, x.place) in want) for x in found)
