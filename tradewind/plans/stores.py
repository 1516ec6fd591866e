"""Queries over stored tables as they are after a batch of changes, and over articles joined across stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions import language as L
from tradewind.functions import signals as S
from tradewind.functions import text as T
from tradewind.functions import url as U
from tradewind.operators import audit, dedup, enrich, personal, quality, stores, supply
from tradewind.plans import articles as A
from tradewind.plans import relations as R
from tradewind.plans.articles import q
from tradewind.plans.registry import query
from tradewind.session import table, written
from tradewind.sources.adapters import MENTIONS, PROCESSED, RAW_ARTICLES, SUPPLIERS, mentions, processed, raw_articles, suppliers, thousandths

JAN15 = "TIMESTAMP '2024-01-15 00:00:00'"
NOW_SQL = R.NOW_SQL

# ---- feeds as stored rows ----

FEED = """feed AS (SELECT o_custkey AS user_id, o_orderkey AS processed_article_id, round(o_totalprice % 1000 / 1000, 3) AS rank_score, o_orderdate AS surfaced_at, o_orderstatus = 'F' AS is_read, o_orderkey % 13 = 0 AS is_hidden FROM orders)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored feed rows, one an order: its buyer, its article, and the day it surfaced."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), k.alias("processed_article_id"), thousandths(F.col("o_totalprice") % 1000 / 1000).alias("rank_score"), F.col("o_orderdate").alias("surfaced_at"), (F.col("o_orderstatus") == "F").alias("is_read"), (k % 13 == 0).alias("is_hidden"))


_feed_join = "feed f JOIN processed p ON p.id = f.processed_article_id"


@query(FEED, PROCESSED, RAW_ARTICLES, sql=f"SELECT f.user_id, p.id, r.title, f.rank_score FROM {_feed_join} JOIN raw_articles r ON r.id = p.raw_article_id WHERE NOT f.is_hidden")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed(spark, sf_dir).select("id", "raw_article_id")
    r = raw_articles(spark, sf_dir).select(F.col("id").alias("raw_article_id"), "title")
    shown = feed(spark, sf_dir).where("not is_hidden").select("user_id", F.col("processed_article_id").alias("id"), "rank_score")
    return shown.join(p, "id").join(r, "raw_article_id").select("user_id", "id", "title", "rank_score")


@query(FEED, sql="SELECT user_id, processed_article_id AS id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, surfaced_at DESC, processed_article_id) AS place FROM feed WHERE NOT is_hidden AND NOT is_read QUALIFY place BETWEEN 3 AND 6")
def paging_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places three to six of each user's unread feed, with the total that all pages hold."""
    w = Window.partitionBy("user_id")
    rows = feed(spark, sf_dir).where("not is_hidden and not is_read")
    placed = rows.select("user_id", F.col("processed_article_id").alias("id"), F.count("*").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("rank_score"), F.desc("surfaced_at"), "processed_article_id")).cast("long").alias("place"))
    return placed.where("place between 3 and 6")


@query(FEED, sql="SELECT user_id, processed_article_id, is_read OR processed_article_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS is_read FROM feed")
def marked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows after their articles with a returned line have been opened."""
    opened = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("processed_article_id"))
    return stores.marked(feed(spark, sf_dir), opened, ["processed_article_id"], "is_read").select("user_id", "processed_article_id", "is_read")


@query(FEED, PROCESSED, sql="SELECT user_id, string_agg('- ' || normalized_title || ' [' || coalesce(priority_signal, 'no tags') || ']: ' || substr(summary, 1, 200), chr(10) ORDER BY r) AS digest FROM (SELECT f.user_id, p.*, row_number() OVER (PARTITION BY f.user_id ORDER BY f.surfaced_at DESC, p.id) AS r FROM feed f JOIN processed p ON p.id = f.processed_article_id WHERE NOT f.is_hidden) WHERE r <= 6 GROUP BY 1")
def feed_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six latest articles of each user's feed, as the chat's prompt lists them."""
    f = feed(spark, sf_dir).where("not is_hidden").select("user_id", F.col("processed_article_id").alias("id"), "surfaced_at")
    w = Window.partitionBy("user_id").orderBy(F.desc("surfaced_at"), "id")
    top = f.join(processed(spark, sf_dir), "id").withColumn("r", F.row_number().over(w)).where("r <= 6")
    line = F.concat(F.lit("- "), "normalized_title", F.lit(" ["), F.coalesce("priority_signal", F.lit("no tags")), F.lit("]: "), F.substring("summary", 1, 200))
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("digest"))


_focus_sql = "concat_ws('; ', CASE WHEN want_supplier IS NOT NULL THEN 'Suppliers: ' || want_supplier END, CASE WHEN want_region IS NOT NULL THEN 'Regions: ' || want_region END, CASE WHEN want_category IS NOT NULL THEN 'Categories: ' || want_category END)"


@query(PROCESSED, R.USERS, sql=f"SELECT user_id, CASE WHEN {_focus_sql} <> '' THEN 'The user follows — ' || {_focus_sql} || '.' ELSE '' END AS focus FROM users")
def prompt_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the chat's prompt that names what a user follows."""
    return R.feed_tables(spark, sf_dir)[1].select("user_id", personal.focus_line().alias("focus"))


# ---- feed generation with what is there, the fallback and the top-up ----

_score_sql = """CASE WHEN want_category IS NULL THEN CAST(0.5 AS DOUBLE) WHEN category = want_category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.3 AS DOUBLE)
    + CASE WHEN supplier IS NULL OR want_supplier IS NULL THEN CASE WHEN coalesce(supplier = no_supplier, false) THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END WHEN supplier = want_supplier THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.3 AS DOUBLE)
    + CASE WHEN want_region IS NULL THEN CAST(0.5 AS DOUBLE) WHEN region = want_region THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE)"""
GENERATED = f"""fresh AS (SELECT user_id, id, processed_at, {_score_sql} AS rank_score
  FROM users JOIN arts ON CASE WHEN {R._focus} THEN coalesce(category = want_category, false) OR coalesce(supplier = want_supplier, false) WHEN want_region IS NOT NULL THEN coalesce(region = want_region, false) ELSE true END
  WHERE NOT coalesce(supplier = no_supplier, false) AND (user_id, id) NOT IN (SELECT (user_id, processed_article_id) FROM feed)),
baseline AS (SELECT user_id, id, processed_at, CAST(0.5 AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.3 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS rank_score
  FROM users JOIN arts ON NOT coalesce(supplier = no_supplier, false) WHERE user_id NOT IN (SELECT user_id FROM fresh WHERE rank_score >= 0.3) AND (user_id, id) NOT IN (SELECT (user_id, processed_article_id) FROM feed)),
generated AS (SELECT user_id, id, rank_score, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, processed_at DESC, id) AS rank FROM (SELECT * FROM fresh WHERE rank_score >= 0.3 UNION ALL SELECT * FROM baseline) QUALIFY rank <= 50)"""


@query(PROCESSED, R.USERS, FEED, GENERATED, sql="SELECT user_id, id, round(rank_score, 6) AS rank_score, rank FROM generated")
def feed_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows to append to every customer's feed: none it has, the baseline where nothing matches."""
    arts, users = R.feed_tables(spark, sf_dir)
    return R.shown_feed(personal.generate(arts, users, feed(spark, sf_dir).select("user_id", F.col("processed_article_id").alias("id"))))


@query(PROCESSED, R.USERS, FEED, GENERATED, "had AS (SELECT user_id, processed_article_id AS id, rank_score, 0 AS turn, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, surfaced_at DESC, processed_article_id) AS r FROM feed WHERE NOT is_hidden)", sql="SELECT user_id, id, turn, row_number() OVER (PARTITION BY user_id ORDER BY turn, r) AS place FROM (SELECT user_id, id, turn, r FROM had WHERE r <= 20 UNION ALL SELECT user_id, id, 1, rank FROM generated) QUALIFY place <= 20")
def feed_topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of each feed, from new matches where the stored ones are fewer."""
    arts, users = R.feed_tables(spark, sf_dir)
    stored = feed(spark, sf_dir)
    new = personal.generate(arts, users, stored.select("user_id", F.col("processed_article_id").alias("id")))
    return personal.topped_up(stored.where("not is_hidden").select("user_id", F.col("processed_article_id").alias("id"), "rank_score", "surfaced_at"), new, 20).select("user_id", "id", "turn", "place")


# ---- articles ----

_hay = "lower(concat_ws(' ', nullif(p.normalized_title, ''), nullif(p.summary, ''), nullif(r.title, ''), nullif(r.description, ''), nullif(r.content_snippet, '')))"
_hits = " OR ".join(f"coalesce({c} ILIKE '%port strike%', false)" for c in ("p.normalized_title", "p.summary", "r.title", "r.description", "r.content_snippet"))


@query(PROCESSED, RAW_ARTICLES, f"latest AS (SELECT p.id, p.processed_at, r.title, {_hay} AS hay FROM processed p JOIN raw_articles r ON r.id = p.raw_article_id WHERE p.processed_at >= TIMESTAMP '1995-01-01 00:00:00' AND ({_hits}) ORDER BY p.processed_at DESC, p.id LIMIT 60)", sql="SELECT id, least(CASE WHEN contains(hay, 'port strike') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END + least(CAST(0.3 AS DOUBLE), CAST(0.1 AS DOUBLE) * (CAST(contains(hay, 'port') AS INT) + CAST(contains(hay, 'strike') AS INT))) + CASE WHEN contains(lower(title), 'port strike') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, CAST(1.0 AS DOUBLE)) AS relevance FROM latest ORDER BY relevance DESC, processed_at DESC, id LIMIT 20")
def search_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed articles joined to their raw ones, searched in five columns."""
    return stores.search_processed(processed(spark, sf_dir), raw_articles(spark, sf_dir), "port strike", F.expr("timestamp_ntz'1995-01-01 00:00:00'"), 20).select("id", "relevance")


@query(PROCESSED, sql="SELECT id, raw_article_id FROM (SELECT *, row_number() OVER (PARTITION BY raw_article_id ORDER BY id) AS r FROM processed WHERE id % 2 = 1) WHERE r = 1 AND raw_article_id NOT IN (SELECT raw_article_id FROM processed WHERE id % 2 = 0)")
def processed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd articles appended to a table of the even ones, one a raw article."""
    p = processed(spark, sf_dir).select("id", "raw_article_id")
    return dedup.insert_if_absent(p.where("id % 2 = 1"), p.where("id % 2 = 0"), "raw_article_id", ["id"]).select("id", "raw_article_id")


_registry = [(11, "p-11", "Siemens AG", True), (12, "p-12", "Robert Bosch", True), (13, "p-13", "ACME", True), (14, "p-14", "Toyota Inc.", True), (15, "p-15", "Nexans SA", False)]


def _known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(suppliers, aliases) of a small registry: one name held whole, one under its short form, one inactive, one unknown."""
    s = spark.createDataFrame(_registry, "id long, public_id string, canonical_name string, is_active boolean")
    return s, supply.register(s, ascii_only=True)


@query(PROCESSED, sql="SELECT id AS processed_article_id, supplier AS surface_form, CASE supplier WHEN 'Siemens AG' THEN 11 WHEN 'Toyota' THEN 14 END AS supplier_id, CASE WHEN supplier IN ('Siemens AG', 'Toyota') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS confidence FROM processed WHERE supplier IS NOT NULL AND id % 4 <> 0")
def mention_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of every article's suppliers, named twice each, less those of every fourth that are recorded already."""
    p = processed(spark, sf_dir)
    named = p.select("id", F.array_compact(F.array("supplier", F.upper("supplier"))).alias("detected_suppliers"))
    recorded = p.where("id % 4 = 0").select(F.col("id").alias("processed_article_id"), F.col("supplier").alias("surface_form"))
    s, aliases = _known(spark)
    return supply.record_mentions(named, recorded, aliases, s, ascii_only=True)


@query(RAW_ARTICLES, sql="SELECT id, published_at FROM raw_articles ORDER BY published_at DESC, id DESC LIMIT 50")
def recent_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_articles(spark, sf_dir).select("id", "published_at").orderBy(F.desc("published_at"), F.desc("id")).limit(50)


@query(RAW_ARTICLES, *A.LANGUAGES, f"d AS (SELECT *, {A._domain} AS domain, {A._fail} AS failures FROM l)", sql=f"SELECT id FROM d WHERE domain NOT IN ({', '.join(map(q, D.BLOCKED_DOMAINS))}) AND len(failures) = 0 AND language_reason IS NULL ORDER BY published_at, id LIMIT 100")
def accepted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred articles that the normaliser accepts, past those it rejects."""
    done = quality.normalise(raw_articles(spark, sf_dir), A.as_of()).where("reject_reason is null")
    return done.orderBy("published_at", "id").limit(100).select("id")


_url_hash = f"sha256({A._domain} || regexp_extract(lower(article_url), '^[a-z]+://[^/?#]*([^?#]*)', 1))"
_title_hash = "sha256(trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')))"
_old_hash = "sha256(title || '|' || source_name || '|' || strftime(published_at, '%Y-%m-%dT%H:%M:%S'))"


@query(RAW_ARTICLES, f"h AS (SELECT id, source_name, published_at, {_url_hash} AS u, {_title_hash} AS t, {_old_hash} AS i FROM raw_articles)", "stored AS (SELECT source_name, published_at - INTERVAL 30 HOUR AS published_at, CASE id % 9 WHEN 0 THEN u WHEN 3 THEN t ELSE i END AS h FROM h WHERE id % 3 = 0)", sql="SELECT id, CASE WHEN u IN (SELECT h FROM stored) THEN 1 WHEN EXISTS (SELECT 1 FROM stored s WHERE s.h = h.t AND s.source_name = h.source_name AND s.published_at BETWEEN h.published_at - INTERVAL 48 HOUR AND h.published_at) THEN 2 WHEN i IN (SELECT h FROM stored) THEN 3 END AS level FROM h")
def duplicate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article against a table that holds a third of them under one of the three hashes."""
    iso = U.iso_time(F.col("published_at"))
    h = raw_articles(spark, sf_dir).select("id", "source_name", "published_at", U.url_hash(F.col("article_url")).alias("url_hash"), U.title_hash(F.col("title")).alias("title_hash"), F.sha2(F.concat("title", F.lit("|"), "source_name", F.lit("|"), iso), 256).alias("ingest_hash"))
    stored = h.where("id % 3 = 0").select("source_name", (F.col("published_at") - F.expr("interval 30 hours")).alias("published_at"), F.when(F.col("id") % 9 == 0, F.col("url_hash")).when(F.col("id") % 9 == 3, F.col("title_hash")).otherwise(F.col("ingest_hash")).alias("ingest_hash"))
    return stores.duplicate_level(h, stored)


@query(PROCESSED, MENTIONS, sql=f"SELECT coalesce(s.survivor_id, m.processed_article_id) AS processed_article_id, count(*) AS n FROM mentions m LEFT JOIN (SELECT id, first_value(id) OVER (PARTITION BY raw_article_id ORDER BY {R._dup_order}) AS survivor_id FROM processed) s ON s.id = m.processed_article_id GROUP BY 1")
def duplicate_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions by article after those of duplicate articles have moved to the one that stays."""
    moved = stores.repointed(mentions(spark, sf_dir), R.duplicate_survivors(spark, sf_dir), "processed_article_id")
    return moved.groupBy("processed_article_id").agg(F.count("*").alias("n"))


@query(PROCESSED, sql=f"SELECT id, raw_article_id FROM (SELECT id, raw_article_id, first_value(id) OVER (PARTITION BY raw_article_id ORDER BY {R._dup_order}) AS survivor_id FROM processed) WHERE id = survivor_id")
def duplicates_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.survivors_only(R.duplicate_survivors(spark, sf_dir)).select("id", "raw_article_id")


@query(PROCESSED, sql=f"SELECT id, array_to_string({A._ordered_distinct('found')}, '|') AS suppliers FROM (SELECT id, list_filter(list_concat([supplier], {A._known.replace('(title', '(normalized_title')}, {A._named.replace('(title', '(normalized_title')}), lambda x: x IS NOT NULL) AS found FROM processed)")
def response_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored suppliers and, after them, those that the title names."""
    p = processed(spark, sf_dir)
    return p.select("id", F.array_join(T.union_distinct(F.array_compact(F.array("supplier")), S.suppliers(F.col("normalized_title"))), "|").alias("suppliers"))


@query(PROCESSED, sql="SELECT id, coalesce(length(trim(supplier)) >= 3 AND regexp_matches(lower(normalized_title), '(^|[^0-9a-z])' || regexp_escape(lower(trim(supplier))) || '([^0-9a-z]|$)'), false) AS own, length(trim(substr(region, 1, 3))) >= 3 AND regexp_matches(lower(normalized_title), '(^|[^0-9a-z])' || regexp_escape(lower(trim(substr(region, 1, 3)))) || '([^0-9a-z]|$)') AS part FROM processed")
def supplier_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a title names the article's supplier as a whole word, and whether it so names the head of its region."""
    p, text = processed(spark, sf_dir), F.col("normalized_title")
    return p.select("id", T.names(text, F.col("supplier")).alias("own"), T.names(text, F.substring("region", 1, 3)).alias("part"))


@query(RAW_ARTICLES, *A.LANGUAGES, sql="SELECT id, language_reason AS reason FROM l")
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title is not in the language they state."""
    a = raw_articles(spark, sf_dir)
    some = (F.coalesce("description", F.lit("")) != "") | (F.coalesce("content_snippet", F.lit("")) != "")
    return a.select("id", L.gate(F.col("language"), F.col("title"), some).alias("reason"))


# ---- signals ----


@query(RAW_ARTICLES, A.SIGNALS, sql="SELECT sha256(CAST(id AS VARCHAR) || '|' || signal_type) AS signal_key, id, signal_type, severity FROM signals")
def signal_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals to store of each article, under a key that a second run meets again."""
    found = A.classified(spark, sf_dir)
    return found.select(F.sha2(F.concat_ws("|", F.col("id").cast("string"), "signal_type"), 256).alias("signal_key"), "id", "signal_type", "severity")


@query(RAW_ARTICLES, A.SIGNALS, sql="SELECT id, signal_type, severity, count(*) OVER () AS total FROM signals WHERE severity IN ('high', 'critical') ORDER BY id, signal_type LIMIT 20 OFFSET 10")
def signal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of strong signals, with how many there are."""
    strong = written(A.classified(spark, sf_dir).where(F.col("severity").isin("high", "critical")).select("id", "signal_type", "severity"), "signals")
    return strong.orderBy("id", "signal_type").offset(10).limit(20).withColumn("total", F.lit(strong.count()).cast("long"))


@query(sql="SELECT l_orderkey AS signal_id, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_linestatus = 'O') AS acknowledged_by, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) FILTER (l_linestatus = 'F') AS note FROM lineitem GROUP BY 1")
def signal_acknowledgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each of two names in an append-only log."""
    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("signal_id"), F.when(F.col("l_linestatus") == "O", "acknowledged_by").otherwise("note").alias("name"), F.col("l_returnflag").alias("value"), "l_linenumber", "l_partkey", "l_suppkey")
    return stores.latest_values(log, "signal_id", "name", "value", ["l_linenumber", "l_partkey", "l_suppkey"], ("acknowledged_by", "note"))


# ---- lifecycle ----


@query(R.LIFE, "o AS (SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 'w1' WHEN event_id % 7 = 3 THEN NULL ELSE 'w2' END AS owner, CASE WHEN event_id % 2 = 0 THEN 'completed' ELSE 'enrichment_retry' END AS status, CASE WHEN event_id % 2 = 1 THEN 120 END AS retry, event_id % 5 <> 4 AS asked FROM events)", "j AS (SELECT life.*, o.*, coalesce(asked AND (owner IS NULL OR owner = life.o), false) AS done FROM life JOIN o USING (event_id))", sql=f"SELECT event_id, CASE WHEN done THEN status ELSE s END AS enrichment_status, CASE WHEN done THEN {JAN15} + to_minutes(retry) ELSE n END AS enrichment_next_attempt_at, CASE WHEN done THEN NULL ELSE j.o END AS enrichment_lease_owner, CASE WHEN done AND retry IS NOT NULL THEN attempt + 1 ELSE attempt END AS enrichment_attempt_count FROM j")
def raw_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles after workers report: only the holder of a lease may, or no one in particular."""
    rows = R.life(spark, sf_dir).withColumnRenamed("attempt", "enrichment_attempt_count")
    k = F.col("event_id")
    out = table(spark, sf_dir, "events").where("event_id % 5 <> 4").select("event_id", F.when(k % 7 < 3, "w1").when(k % 7 > 3, "w2").alias("owner"), F.when(k % 2 == 0, "completed").otherwise("enrichment_retry").alias("status"), F.when(k % 2 == 1, 120).alias("retry_minutes"))
    return stores.transition(rows, out, "event_id", F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("event_id", "enrichment_status", "enrichment_next_attempt_at", "enrichment_lease_owner", "enrichment_attempt_count")


@query(sql="SELECT c_custkey AS user_id, coalesce(l.language, 'en') AS language FROM customer LEFT JOIN (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'de' WHEN 'O' THEN 'fr' ELSE 'en' END, (o_orderdate, o_orderkey)) AS language FROM orders GROUP BY 1) l ON l.o_custkey = c_custkey")
def language_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's language after the last of their changes; feeds are not touched."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("en").alias("language"))
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "de").when(F.col("o_orderstatus") == "O", "fr").otherwise("en").alias("language"), "o_orderdate", "o_orderkey")
    return stores.updated(users, log, "user_id", "language", ["o_orderdate", "o_orderkey"])


@query(sql="SELECT date_trunc('hour', ts) - to_hours(hour(ts) % 6) AS run_key, event_type AS failure_code, count(*) AS n, min(ts) + INTERVAL 30 MINUTE AS next_poll_at FROM events WHERE event_type IN ('error', 'click') GROUP BY ALL")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of each run by code, and when the first of them is polled again."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click"))
    return e.groupBy(F.window("ts", "6 hours")["start"].alias("run_key"), F.col("event_type").alias("failure_code")).agg(F.count("*").alias("n"), (F.min("ts") + F.expr("interval 30 minutes")).alias("next_poll_at"))


@query(sql="SELECT started_at, failed, n, CAST(failed AS DOUBLE) / greatest(n, 1) > 0.05 AS firing FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS started_at, count(*) FILTER (event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY 1)")
def error_ratio_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of five minutes in which over a twentieth of the events failed."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes")["start"].alias("started_at")).agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("n"))
    return e.withColumn("firing", F.col("failed").cast("double") / F.greatest("n", F.lit(1)) > 0.05)


_bounds = (10.0, 50.0, 100.0)


@query(sql="SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (VALUES (CAST(10 AS DOUBLE)), (CAST(50 AS DOUBLE)), (CAST(100 AS DOUBLE)), (CAST('inf' AS DOUBLE))) b(le) GROUP BY ALL")
def cumulative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram as metrics report it: events up to each bound, one pass over the events."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate((*_bounds, float("inf")))))
    return counts.select("event_type", F.inline(F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate((*_bounds, float("inf")))))))


# ---- suppliers, watchlists, rules ----


@query(SUPPLIERS, R.ALIASES, "asked AS (SELECT id AS request_id, id AS supplier_id, CASE id % 4 WHEN 0 THEN canonical_name WHEN 1 THEN 'Supplier#' || lpad(CAST(id + 1 AS VARCHAR), 9, '0') WHEN 2 THEN 'New name ' || CAST(id % 10 AS VARCHAR) ELSE ' - ' END AS name FROM suppliers)", f"k AS (SELECT *, {R._norm('name')} AS alias FROM asked)", "h AS (SELECT k.*, a.supplier_id AS held, first_value(k.supplier_id) OVER (PARTITION BY k.alias ORDER BY request_id) AS first_asked, row_number() OVER (PARTITION BY k.alias ORDER BY request_id) AS r FROM k LEFT JOIN aliases a ON a.alias = k.alias)", sql="SELECT request_id, alias, CASE WHEN alias = '' THEN 'empty' WHEN held IS NULL AND r = 1 THEN 'added' WHEN coalesce(held, first_asked) = supplier_id THEN 'own' ELSE 'conflict' END AS outcome FROM h")
def alias_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier asks for its own name, its neighbour's, a new one or none."""
    s, k = suppliers(spark, sf_dir), F.col("id")
    name = F.when(k % 4 == 0, F.col("canonical_name")).when(k % 4 == 1, F.concat(F.lit("Supplier#"), F.lpad((k + 1).cast("string"), 9, "0"))).when(k % 4 == 2, F.concat(F.lit("New name "), (k % 10).cast("string"))).otherwise(" - ")
    asked = s.select(k.alias("request_id"), k.alias("supplier_id"), name.alias("name"))
    return supply.claims_of_aliases(asked, supply.register(s, ascii_only=True), ascii_only=True).select("request_id", "alias", "outcome")


_seed = ", ".join(f"({q(n)}, {q(n) not in (q('Siemens'), q('Toyota'), q('Nexans'))})" for n in D.KNOWN_SUPPLIERS)


@query(sql=f"SELECT * FROM (VALUES {_seed}) t(name, created)")
def supplier_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The starting catalogue against a registry that knows three of its names already."""
    names = spark.createDataFrame([(n, k) for k, n in enumerate(sorted(D.KNOWN_SUPPLIERS))], "name string, place int")
    return supply.seeded(names, _known(spark)[1], ascii_only=True)


@query(SUPPLIERS, R.ALIASES, "m AS (SELECT id AS drop_id, CASE WHEN id % 10 = 4 THEN id - 2 ELSE id - 1 END AS keep_id FROM suppliers WHERE id % 10 IN (3, 4, 5))", "c AS (SELECT drop_id, CASE WHEN drop_id % 10 = 5 THEN drop_id - 3 ELSE keep_id END AS keep_id FROM m)", sql="SELECT s.id AS supplier_id, s.is_active AND c.drop_id IS NULL AS is_active, count(a.alias) AS aliases FROM suppliers s LEFT JOIN c ON c.drop_id = s.id LEFT JOIN (SELECT coalesce(c.keep_id, supplier_id) AS supplier_id, alias FROM aliases LEFT JOIN c ON c.drop_id = supplier_id) a ON a.supplier_id = s.id GROUP BY ALL")
def supplier_merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers after merges, one of them a chain: the loser inactive, its aliases the keeper's."""
    s = suppliers(spark, sf_dir)
    k = F.col("id")
    merges = s.where("id % 10 in (3, 4, 5)").select(k.alias("drop_id"), F.when(k % 10 == 4, k - 2).otherwise(k - 1).alias("keep_id"))
    left, aliases, _ = supply.merge_suppliers(s, supply.register(s, ascii_only=True), mentions(spark, sf_dir), merges)
    counted = aliases.groupBy("supplier_id").agg(F.count("*").alias("n"))
    return left.join(counted, F.col("id") == F.col("supplier_id"), "left").select(F.col("id").alias("supplier_id"), "is_active", F.coalesce("n", F.lit(0).cast("long")).alias("aliases"))


@query(MENTIONS, sql="SELECT surface_form, CASE WHEN surface_form IN ('unknown 7', 'unknown 8') THEN 11 END AS supplier_id, surface_form IN ('unknown 7', 'unknown 8') AS changed, count(*) AS n FROM mentions WHERE supplier_id IS NULL GROUP BY ALL")
def mention_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved mentions after one supplier has taken two of their spellings as aliases, and one inactive a third."""
    s, aliases = _known(spark)
    more = spark.createDataFrame([(11, "unknown 7"), (11, "unknown 8"), (15, "unknown 9")], "supplier_id long, alias string")
    open_ones = mentions(spark, sf_dir).where("supplier_id is null")
    return supply.re_resolved(open_ones, aliases.select("supplier_id", "alias").unionByName(more), s, ascii_only=True).groupBy("surface_form", "supplier_id", "changed").agg(F.count("*").alias("n"))


@query(MENTIONS, sql="SELECT CAST(floor(processed_article_id / 1000) AS BIGINT) AS batch, count(*) AS mentions, count(DISTINCT processed_article_id) AS articles FROM mentions GROUP BY 1")
def mentions_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).groupBy(F.floor(F.col("processed_article_id") / 1000).cast("long").alias("batch")).agg(F.count("*").alias("mentions"), F.count_distinct("processed_article_id").alias("articles"))


@query(SUPPLIERS, sql="SELECT count(*) AS screened, count(*) FILTER (is_active) AS hits, 3 * count(*) - 2 * count(*) FILTER (is_active) + count(*) FILTER (is_active AND canonical_name LIKE '% Group') AS unmatched FROM suppliers")
def screening_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designations screened, suppliers hit and names left over; two of three spellings are an active supplier's, one
    where its name has no legal form."""
    found = R.screened(spark, sf_dir)
    return found.agg(F.count("*").alias("screened"), F.sum(F.size("hits")).alias("hits"), F.sum(F.size("unmatched")).alias("unmatched"))


@query(R.WATCH.split(",\nwatched AS")[0], sql="SELECT watchlist_id, count(*) AS members FROM (SELECT watchlist_id, supplier_id FROM entries UNION SELECT o_custkey, o_orderkey % 97 + 1 FROM orders EXCEPT SELECT o_custkey, o_orderkey % 89 + 1 FROM orders) GROUP BY 1")
def watchlist_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlists after additions, some of them there already, and removals."""
    _, entries, _ = R.watch_tables(spark, sf_dir)
    pick = lambda n: table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("watchlist_id"), (F.col("o_orderkey") % n + 1).alias("supplier_id"))
    return stores.membership(entries, pick(97), pick(89)).groupBy("watchlist_id").agg(F.count("*").alias("members"))


_severities = ("low", "medium", "high", "critical")
_rule_name = "CASE WHEN p_partkey % 50 = 0 THEN ' .. ' ELSE ' ' || upper(p_name) || '! ' END"


@query("r AS (SELECT p_partkey AS request_id, p_size AS organization_id, trim(regexp_replace(lower(" + _rule_name + "), '[^a-z0-9]+', ' ', 'g')) AS normalized_name, CASE p_partkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' WHEN 4 THEN 'High' END AS sev, p_partkey % 2 AS odd FROM part)", "s AS (SELECT *, normalized_name <> '' AND coalesce(sev IN ('low', 'medium', 'high', 'critical'), false) AS fit FROM r)", "t AS (SELECT *, row_number() OVER (PARTITION BY organization_id, normalized_name, fit ORDER BY request_id) AS k FROM s)", sql="SELECT request_id, normalized_name, CASE odd WHEN 1 THEN 'strike|tariff' ELSE '' END AS risk_types, CASE WHEN normalized_name = '' THEN 'no name' WHEN NOT fit THEN 'no severity' WHEN k > 1 OR (organization_id, normalized_name) IN (SELECT (organization_id, normalized_name) FROM r WHERE request_id % 20 = 7) AND request_id % 20 <> 7 THEN 'duplicate' ELSE 'created' END AS outcome FROM t WHERE request_id % 20 <> 7")
def alert_rule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule asked for by each part; a twentieth of them are the rules there are."""
    k = F.col("p_partkey")
    name = F.when(k % 50 == 0, " .. ").otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("! ")))
    severity = F.when(k % 6 == 0, "low").when(k % 6 == 1, "medium").when(k % 6 == 2, "high").when(k % 6 == 3, "critical").when(k % 6 == 4, "High")
    types = F.when(k % 2 == 1, F.array(F.lit("tariff"), F.lit("strike"), F.lit("tariff")))
    asked = table(spark, sf_dir, "part").select(k.alias("request_id"), F.col("p_size").alias("organization_id"), name.alias("name"), severity.alias("min_severity"), types.alias("risk_types"))
    there = stores.rule_outcomes(asked.where("request_id % 20 = 7"), asked.limit(0).select("organization_id", F.lit("").alias("normalized_name")), _severities, ascii_only=True).select("organization_id", "normalized_name")
    done = stores.rule_outcomes(asked.where("request_id % 20 <> 7"), there, _severities, ascii_only=True)
    return done.select("request_id", "normalized_name", F.array_join("risk_types", "|").alias("risk_types"), "outcome")


@query(sql="SELECT p_partkey AS id, array_to_string(list_filter([x, y], lambda v: v IS NOT NULL), '|') AS tokens FROM (SELECT p_partkey, nullif(lower(trim(p_name)), '') AS x, CASE WHEN lower(trim(p_brand)) <> lower(trim(p_name)) THEN nullif(lower(trim(p_brand)), '') END AS y FROM part)")
def preference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A preference list as stored: stripped, lower case, each value once, blanks dropped."""
    given = F.array(F.upper("p_name"), F.lit("  "), F.concat(F.lit(" "), "p_name"), "p_brand", F.lit(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(personal.tokens(given), "|").alias("tokens"))


# ---- caches, recorded model output, audit ----


@query(sql="SELECT p_partkey AS id, sha256('[\"cost-v1\",\"tax-2\",\"en\",\"' || lower(p_name) || '\",\"' || lower(p_type) || '\",\"' || lower(p_brand) || '\"]') AS fingerprint FROM part")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of parts as articles, white space and capitals strewn in."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(" EN").alias("language"), F.concat(F.lit("  "), F.upper("p_name")).alias("title"), F.replace("p_type", F.lit(" "), F.lit(" \t ")).alias("description"), F.concat("p_brand", F.lit("\n")).alias("content_snippet"))
    return p.select("id", enrich.content_fingerprint("cost-v1", "tax-2").alias("fingerprint"))


_puts = "puts AS (SELECT CAST(o_orderkey % 500 AS VARCHAR) AS fp, 'v' || CAST(o_orderkey % 2 AS VARCHAR) AS pv, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS w FROM orders WHERE o_orderkey % 5 <> 4 GROUP BY ALL)"
_gets = "gets AS (SELECT CAST(event_id % 600 AS VARCHAR) AS fp, 'v' || CAST(event_id % 3 AS VARCHAR) AS pv, count(*) AS n FROM events GROUP BY ALL)"


@query(_puts, _gets, sql="SELECT fp AS content_fingerprint, pv AS policy_version, CASE WHEN w % 11 = 0 THEN '{\"summary\": 1' ELSE '{\"summary\":\"s' || CAST(w AS VARCHAR) || '\",\"category\":\"general\"}' END AS payload, CASE WHEN w % 11 = 0 THEN 0 ELSE coalesce(n, 0) END AS hit_count FROM puts LEFT JOIN gets USING (fp, pv)")
def enrichment_cache_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries after writes and a batch of reads: the last write stays, another version or a corrupt payload is a miss."""
    k = F.col("o_orderkey")
    payload = F.when(k % 11 == 0, '{"summary": 1').otherwise(F.concat(F.lit('{"summary":"s'), k.cast("string"), F.lit('","category":"general"}')))
    puts = table(spark, sf_dir, "orders").select((k % 500).cast("string").alias("content_fingerprint"), F.concat(F.lit("v"), (k % 2).cast("string")).alias("policy_version"), F.lit("t").alias("taxonomy_version"), payload.alias("payload"), F.when(k % 5 == 4, "guess").when(k % 2 == 0, "llm").otherwise("deterministic").alias("original_method"), "o_orderdate", "o_orderkey")
    none = spark.createDataFrame([], "content_fingerprint string, policy_version string, taxonomy_version string, payload string, original_method string, hit_count long")
    entries = stores.cache_put(none, puts, ["o_orderdate", "o_orderkey"])
    e = F.col("event_id")
    reads = table(spark, sf_dir, "events").select((e % 600).cast("string").alias("content_fingerprint"), F.concat(F.lit("v"), (e % 3).cast("string")).alias("policy_version"), F.lit("t").alias("taxonomy_version"))
    return stores.count_hits(entries, stores.cache_get(reads, entries)).select("content_fingerprint", "policy_version", "payload", "hit_count")


#: Recorded answers of a model by kind, and what must be read from each: (answer, summary, category, tags, suppliers), or nulls.
ANSWERS = (
    ('Sure: {"summary": "Steel tariffs rise again", "category": "Chips", "signal_tags": ["tariff", "nonsense"], "detected_suppliers": [" Bosch ", "Bosch", 3, ""]} Done.', "Steel tariffs rise again", "electronics", "tariff", "Bosch"),
    ('{"summary": "An ordinary summary", "category": "weather"}', "An ordinary summary", "general", "", ""),
    ('{"summary": "short", "category": "logistics"}', None, None, None, None),
    ("no json here", None, None, None, None),
    ('{"summary": "Broken at the end", "category": "logistics"', None, None, None, None),
    ('{"summary": "Tags are no list at all", "category": "logistics", "signal_tags": "strike"}', None, None, None, None),
    ('{"summary": "Suppliers are no list", "category": 7, "detected_suppliers": "Bosch"}', "Suppliers are no list", "general", "", ""),
)
_shown = lambda v: "NULL" if v is None else q(v)
_answers = ", ".join(f"({k}, {', '.join(map(_shown, a[1:]))})" for k, a in enumerate(ANSWERS))


@query(f"answers(kind, summary, category, tags, suppliers) AS (VALUES {_answers})", PROCESSED, sql="SELECT id, a.summary, category, tags, CASE WHEN a.summary IS NULL THEN NULL ELSE concat_ws('|', nullif(suppliers, ''), CASE WHEN supplier <> coalesce(suppliers, '') THEN supplier END) END AS suppliers FROM processed JOIN answers a ON kind = id % 7")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded answer for each article, read, checked, and joined with what the rules found; null where it is unusable."""
    answers = spark.createDataFrame([(k, a[0]) for k, a in enumerate(ANSWERS)], "kind long, answer string")
    p = processed(spark, sf_dir).select("id", "supplier", (F.col("id") % len(ANSWERS)).alias("kind"))
    read = p.join(F.broadcast(answers), "kind").withColumn("m", enrich.parsed_answer(F.col("answer")))
    merged = T.union_distinct(F.col("m.detected_suppliers"), F.array_compact(F.array("supplier")))
    return read.select("id", "m.summary", "m.category", F.array_join("m.signal_tags", "|").alias("tags"), F.when(F.col("m").isNotNull(), F.array_join(merged, "|")).alias("suppliers"))


@query(sql="SELECT lang, count(*) AS n, count(*) FILTER (cached) AS hits, CAST(ceil(count(*) FILTER (NOT cached) / 8.0) AS BIGINT) AS batches FROM (SELECT coalesce(lang, 'en') AS lang, sha256(coalesce(lang, 'en') || '|' || coalesce(text, '')) IN (SELECT sha256(coalesce(lang, 'en') || '|' || coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0) AS cached FROM documents) GROUP BY 1")
def translation_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by language against a cache that holds those of the even ones: hits, and batches of eight for the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("en")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = d.select("doc_id", "lang", enrich.translation_key(F.col("lang"), F.col("text")).alias("key"))
    cached = keyed.where("doc_id % 2 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    missed = F.count_if(F.col("hit").isNull())
    return keyed.join(cached, "key", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("hit").isNotNull()).alias("hits"), F.ceil(missed / 8).cast("long").alias("batches"))


@query(sql="""SELECT event_id, '{"user":{"apiKey":"[redacted]","name":"' || CAST(user_id AS VARCHAR) || '"},"steps":[{"Token_list":"[redacted]","kind":"' || event_type || '"}],"ok":true}' AS detail FROM events""")
def audit_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested details with whatever stands under a sensitive key replaced, objects and lists too."""
    detail = F.concat(F.lit('{"user": {"apiKey": {"a": [1, 2]}, "name": "'), F.col("user_id").cast("string"), F.lit('"}, "steps": [{"Token_list": [1, {"x": 2}], "kind": "'), "event_type", F.lit('"}], "ok": true}'))
    return table(spark, sf_dir, "events").select("event_id", audit.scrub_detail(detail).alias("detail"))


@query(sql="SELECT user_id, event_id FROM (SELECT user_id, event_id, event_id % 100 = 7 AS bad, coalesce(lag(event_id % 100 = 7) OVER (PARTITION BY user_id ORDER BY event_id), false) AS after FROM events) WHERE bad OR after")
def audit_chain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored chain of which every hundredth row was altered: these rows and the ones after them no longer fit."""
    columns = ["event_id", "event_type", "user_id"]
    stored = audit.chained(table(spark, sf_dir, "events").select(*columns), "user_id", ["event_id"], columns)
    altered = stored.withColumn("event_type", F.when(F.col("event_id") % 100 == 7, "altered").otherwise(F.col("event_type")))
    return audit.broken_links(altered, "user_id", ["event_id"], columns).select("user_id", "event_id")


@query(sql="SELECT user_id AS source_id, status, count(*) AS n FROM (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' ELSE 'pending' END AS status FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) GROUP BY ALL")
def claim_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest run of each source that may be claimed."""
    e = table(spark, sf_dir, "events").where("event_type <> 'purchase'").groupBy(F.col("user_id").alias("source_id")).agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return e.groupBy("source_id", F.when(F.col("first.ts") < F.expr("timestamp_ntz'2024-01-15 00:00:00'"), "expired").otherwise("pending").alias("status")).agg(F.count("*").alias("n"))

