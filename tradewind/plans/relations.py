"""Queries over processed articles, suppliers, risk events, feeds, chats and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.operators import alerts, dedup, lifecycle, personal, risk, supply
from tradewind.plans.articles import category_sql, q
from tradewind.plans.registry import query
from tradewind.session import table
from tradewind.sources.adapters import FX_TICKS, MENTIONS, PROCESSED, RAW_ARTICLES, RISK_EVENTS, SUPPLIERS, fx_ticks, mentions, processed, raw_articles, risk_events, suppliers

NOW_SQL = "TIMESTAMP '1998-08-01 00:00:00'"



def now() -> Column:
    return F.expr("timestamp_ntz'1998-08-01 00:00:00'")


# ---- suppliers ----

_norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_strip = "CASE s_form WHEN 'Group' THEN n WHEN 'Company Co' THEN trim(regexp_replace(n, ' company co$', '')) WHEN 'Co., Ltd.' THEN trim(regexp_replace(n, ' co ltd$', '')) WHEN 'S.p.A.' THEN trim(regexp_replace(n, ' s p a$', '')) ELSE trim(regexp_replace(n, ' (gmbh|ag|inc)$', '')) END"
ALIASES = f"""named AS (SELECT id, {_norm('canonical_name')} AS n, CASE WHEN canonical_name LIKE '% Group' THEN 'Group' WHEN canonical_name LIKE '% Company Co' THEN 'Company Co' WHEN canonical_name LIKE '% Ltd.' THEN 'Co., Ltd.' WHEN canonical_name LIKE '% S.p.A.' THEN 'S.p.A.' ELSE '' END AS s_form FROM suppliers),
forms AS (SELECT id AS supplier_id, n AS alias, 'canonical' AS source FROM named UNION ALL SELECT id, {_strip}, 'derived' FROM named WHERE {_strip} <> n),
aliases AS (SELECT supplier_id, alias, source FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY source, supplier_id) AS r FROM forms) WHERE r = 1)"""


@query(SUPPLIERS, ALIASES, sql="SELECT supplier_id, alias, source FROM aliases")
def supplier_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.register(suppliers(spark, sf_dir), ascii_only=True)


@query(SUPPLIERS, ALIASES, MENTIONS, f"keyed AS (SELECT *, {_norm(chr(39) + 'Supplier#' + chr(39) + ' || lpad(CAST(supplier_id AS VARCHAR), 9, ' + chr(39) + '0' + chr(39) + ')')} AS k FROM mentions)", sql="SELECT count(*) AS mentions, count(s.id) AS resolved, count(*) - count(s.id) AS unresolved FROM keyed m LEFT JOIN aliases a ON a.alias = m.k LEFT JOIN suppliers s ON s.id = a.supplier_id AND s.is_active")
def mention_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's supplier resolved by the spelling that its name has without its legal form."""
    s = suppliers(spark, sf_dir)
    m = mentions(spark, sf_dir).withColumn("surface_form", F.concat(F.lit("Supplier#"), F.lpad(F.col("supplier_id").cast("string"), 9, "0"))).select("processed_article_id", "surface_form")
    found = supply.resolve(m, supply.register(s, ascii_only=True), s, ascii_only=True)
    return found.agg(F.count("*").alias("mentions"), F.count("supplier_id").alias("resolved"), (F.count("*") - F.count("supplier_id")).alias("unresolved"))


@query(MENTIONS, sql="SELECT count(supplier_id) AS resolved, count(*) - count(supplier_id) AS unresolved, round(CAST(count(supplier_id) AS DOUBLE) / count(*), 6) AS coverage FROM mentions")
def mention_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.coverage(mentions(spark, sf_dir))


@query(MENTIONS, sql="SELECT surface_form, count(*) AS n FROM mentions WHERE supplier_id IS NULL GROUP BY 1 ORDER BY n DESC, surface_form LIMIT 20")
def unresolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir).where("supplier_id is null")
    return m.groupBy("surface_form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "surface_form").limit(20)


@query(MENTIONS, SUPPLIERS, sql="SELECT processed_article_id, array_to_string(list_sort(list_distinct(list(public_id))), '|') AS supplier_ids FROM mentions m JOIN suppliers s ON s.id = m.supplier_id AND s.is_active GROUP BY 1")
def article_supplier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = supply.supplier_ids_of(mentions(spark, sf_dir), suppliers(spark, sf_dir))
    return found.withColumn("supplier_ids", F.array_join("supplier_ids", "|"))


@query(MENTIONS, sql="SELECT CASE WHEN supplier_id % 10 = 3 THEN supplier_id - 1 ELSE supplier_id END AS supplier_id, count(*) AS n FROM mentions GROUP BY 1")
def supplier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose id ends in 3 merged into their neighbour."""
    drop = suppliers(spark, sf_dir).where("id % 10 = 3").select(F.col("id").alias("drop_id"), (F.col("id") - 1).alias("keep_id"))
    return supply.merge(mentions(spark, sf_dir), drop).groupBy("supplier_id").agg(F.count("*").alias("n"))


@query(SUPPLIERS, sql="SELECT id, public_id, canonical_name, country, is_active FROM suppliers WHERE canonical_name ILIKE '%ag%' ORDER BY canonical_name, id LIMIT 20 OFFSET 5")
def supplier_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).where(F.col("canonical_name").ilike("%ag%")).orderBy("canonical_name", "id").offset(5).limit(20)


@query(SUPPLIERS, ALIASES, sql="SELECT s.id, s.canonical_name FROM suppliers s WHERE s.id IN (SELECT supplier_id FROM aliases WHERE alias LIKE '%0 co%')")
def supplier_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    hit = supply.register(s, ascii_only=True).where(F.col("alias").like("%0 co%")).select(F.col("supplier_id").alias("id"))
    return s.join(hit, "id", "left_semi").select("id", "canonical_name")


@query(SUPPLIERS, ALIASES, f"d AS (SELECT id, ['Supplier#' || lpad(CAST(id AS VARCHAR), 9, '0'), 'Nobody ' || CAST(id AS VARCHAR), canonical_name] AS names FROM suppliers)", f"n AS (SELECT id AS designation_id, unnest(names) AS surface_form, generate_subscripts(names, 1) AS place FROM d)", f"r AS (SELECT n.*, s.id AS supplier_id, s.public_id, row_number() OVER (PARTITION BY designation_id, s.id ORDER BY place) AS rk FROM n LEFT JOIN aliases a ON a.alias = {_norm('surface_form')} LEFT JOIN suppliers s ON s.id = a.supplier_id AND s.is_active)", sql="SELECT designation_id, coalesce(string_agg(public_id || '=' || surface_form, '|' ORDER BY place) FILTER (supplier_id IS NOT NULL AND rk = 1), '') AS hits, coalesce(string_agg(surface_form, '|' ORDER BY place) FILTER (supplier_id IS NULL), '') AS unmatched FROM r GROUP BY 1")
def designation_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a designation under three spellings."""
    found = screened(spark, sf_dir)
    return found.select("designation_id", F.array_join(F.transform("hits", lambda h: F.concat(h["public_id"], F.lit("="), h["matched_name"])), "|").alias("hits"), F.array_join("unmatched", "|").alias("unmatched"))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    names = F.array(F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")), F.concat(F.lit("Nobody "), F.col("id").cast("string")), F.col("canonical_name"))
    return supply.screen(s.select("id", names.alias("names")), supply.register(s, ascii_only=True), s, ascii_only=True)


@query(PROCESSED, MENTIONS, sql="SELECT count(*) AS unscreened FROM processed WHERE id NOT IN (SELECT DISTINCT processed_article_id FROM mentions WHERE supplier_id IS NULL)")
def unscreened_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = mentions(spark, sf_dir).where("supplier_id is null").select(F.col("processed_article_id").alias("id"))
    return processed(spark, sf_dir).join(seen, "id", "left_anti").agg(F.count("*").alias("unscreened"))


# ---- watchlists and alerts ----

WATCH = """watchlists AS (SELECT c_custkey AS watchlist_id, c_nationkey AS organization_id, c_name AS name FROM customer),
entries AS (SELECT DISTINCT o_custkey AS watchlist_id, o_orderkey % 100 + 1 AS supplier_id FROM orders),
watched AS (SELECT DISTINCT organization_id, public_id FROM entries JOIN watchlists USING (watchlist_id) JOIN suppliers s ON s.id = supplier_id AND s.is_active),
rules AS (SELECT n_nationkey AS rule_id, n_nationkey AS organization_id, n_nationkey % 5 <> 4 AS is_enabled, CASE n_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS min_severity, CASE WHEN n_nationkey % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['tariff', 'sanctions'] END AS risk_types FROM nation)"""


def watch_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(watchlists, entries, rules); entries come from all orders."""
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("watchlist_id"), F.col("c_nationkey").alias("organization_id"), F.col("c_name").alias("name"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("watchlist_id"), (F.col("o_orderkey") % 100 + 1).alias("supplier_id")).distinct()
    k = F.col("n_nationkey")
    rules = table(spark, sf_dir, "nation").select(k.alias("rule_id"), k.alias("organization_id"), (k % 5 != 4).alias("is_enabled"), F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("critical").alias("min_severity"), F.when(k % 3 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("tariff"), F.lit("sanctions"))).alias("risk_types"))
    return lists, entries, rules


@query(SUPPLIERS, WATCH, sql="SELECT organization_id, count(*) AS n FROM watched GROUP BY 1")
def watched_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, entries, _ = watch_tables(spark, sf_dir)
    return alerts.watched(entries, lists, suppliers(spark, sf_dir)).groupBy("organization_id").agg(F.count("*").alias("n"))


@query(SUPPLIERS, WATCH, sql="SELECT w.watchlist_id, w.name, count(e.supplier_id) AS members FROM watchlists w LEFT JOIN entries e USING (watchlist_id) GROUP BY ALL")
def watchlist_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, entries, _ = watch_tables(spark, sf_dir)
    return lists.join(entries, "watchlist_id", "left").groupBy("watchlist_id", "name").agg(F.count("supplier_id").alias("members"))


@query(SUPPLIERS, WATCH, sql="SELECT watchlist_id, s.canonical_name, row_number() OVER (PARTITION BY watchlist_id ORDER BY s.canonical_name, s.id) AS place FROM entries JOIN suppliers s ON s.id = supplier_id")
def watchlist_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entries, _ = watch_tables(spark, sf_dir)
    joined = entries.join(suppliers(spark, sf_dir), F.col("supplier_id") == F.col("id"))
    return joined.select("watchlist_id", "canonical_name", F.row_number().over(Window.partitionBy("watchlist_id").orderBy("canonical_name", "id")).cast("long").alias("place"))


@query(SUPPLIERS, RISK_EVENTS, WATCH, f"one AS (SELECT id AS event_id, risk_type, severity, unnest(list_distinct(affected_supplier_ids)) AS public_id FROM risk_events)", sql="""
SELECT rule_id, event_id, string_agg(DISTINCT public_id, '|' ORDER BY public_id) AS suppliers FROM one JOIN watched USING (public_id) JOIN rules r USING (organization_id)
WHERE r.is_enabled AND (len(r.risk_types) = 0 OR list_contains(r.risk_types, one.risk_type))
  AND list_position(['low', 'medium', 'high', 'critical'], one.severity) >= list_position(['low', 'medium', 'high', 'critical'], r.min_severity)
GROUP BY ALL""")
def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists, entries, rules = watch_tables(spark, sf_dir)
    found = alerts.evaluate(risk_events(spark, sf_dir), rules, alerts.watched(entries, lists, suppliers(spark, sf_dir)))
    return found.withColumn("suppliers", F.array_join("suppliers", "|"))


# ---- risk events ----


@query(RISK_EVENTS, sql=f"""SELECT id, rank_score FROM (SELECT id, published_at, CASE WHEN s > 1.0 THEN CAST(1.0 AS DOUBLE) ELSE s END AS rank_score FROM (
  SELECT id, published_at, confidence + CASE WHEN list_has_any(list_transform(affected_suppliers, lambda x: lower(x)), ['siemens ag', 'toyota']) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
   + CASE WHEN list_has_any(list_transform(affected_locations, lambda x: lower(x)), ['germany']) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
   + CASE WHEN list_has_any(list_transform(affected_categories, lambda x: lower(x)), ['automotive', 'logistics']) THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END
   + CASE WHEN risk_type IN ('tariff') THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS s
  FROM risk_events WHERE published_at >= {NOW_SQL} - INTERVAL 14 DAY)) ORDER BY rank_score DESC, published_at DESC, id DESC LIMIT 25 OFFSET 5""")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = risk_events(spark, sf_dir).where(F.col("published_at") >= now() - F.expr("interval 14 days"))
    score = risk.rank_score(["siemens ag", "toyota"], ["germany"], ["automotive", "logistics"], ["tariff"])
    return recent.withColumn("rank_score", score).orderBy(F.desc("rank_score"), F.desc("published_at"), F.desc("id")).offset(5).limit(25).select("id", "rank_score")


@query(RISK_EVENTS, sql="SELECT risk_type, severity, status, count(*) AS n FROM risk_events WHERE severity IN ('critical', 'high') AND list_has_any(list_transform(affected_locations, lambda x: lower(x)), ['middle east', 'suez']) GROUP BY ALL")
def risk_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.exists("affected_locations", lambda x: F.lower(x).isin("middle east", "suez"))
    return risk_events(spark, sf_dir).where(F.col("severity").isin("critical", "high") & hit).groupBy("risk_type", "severity", "status").agg(F.count("*").alias("n"))


@query(RISK_EVENTS, sql="""SELECT coalesce(n.id, o.id) AS event_key, CASE WHEN n.id IS NOT NULL THEN n.confidence ELSE o.confidence END AS confidence, coalesce(o.status, n.status) AS status
FROM (SELECT id, confidence, status FROM risk_events WHERE id % 3 <> 0) o FULL OUTER JOIN (SELECT id, round(confidence / 2, 4) AS confidence, 'new' AS status FROM risk_events WHERE id % 2 = 0 OR id % 3 = 0) n ON n.id = o.id""")
def risk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are only held, held and detected anew, or only new; each is of one kind."""
    return upserted(spark, sf_dir, "id % 2 = 0 or id % 3 = 0")


def upserted(spark: SparkSession, sf_dir: str, fresh: str) -> DataFrame:
    e = risk_events(spark, sf_dir)
    old = e.where("id % 3 <> 0").select(F.col("id").alias("event_key"), "confidence", "status")
    new = e.where(fresh).select(F.col("id").alias("event_key"), F.round(F.col("confidence") / 2, 4).alias("confidence"), F.lit("new").alias("status"))
    return risk.upsert(old, new, kept=("status",))


@query(RISK_EVENTS, sql="SELECT coalesce(p.status, e.status) AS status, count(*) AS n FROM risk_events e LEFT JOIN (SELECT o_orderkey AS id, arg_max(st, (line_no, l_partkey, l_suppkey)) AS status FROM (SELECT l_orderkey AS o_orderkey, CASE l_linestatus WHEN 'F' THEN 'reviewed' ELSE 'dismissed' END AS st, l_linenumber AS line_no, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1) p USING (id) GROUP BY 1")
def risk_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each event after its log of patches, the last of which counts."""
    log = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    last = log.groupBy(F.col("l_orderkey").alias("id")).agg(F.max_by(F.when(F.col("l_linestatus") == "F", "reviewed").otherwise("dismissed"), F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("patched"))
    return risk_events(spark, sf_dir).join(last, "id", "left").groupBy(F.coalesce("patched", "status").alias("status")).agg(F.count("*").alias("n"))


# ---- search, feed, processed articles ----


@query(RAW_ARTICLES, f"hit AS (SELECT id, title, description, content_snippet, published_at, lower(concat_ws(' ', title, nullif(description, ''), nullif(content_snippet, ''))) AS hay FROM raw_articles WHERE (title ILIKE '%port strike%' OR description ILIKE '%port strike%' OR content_snippet ILIKE '%port strike%') AND published_at >= TIMESTAMP '2024-01-03 00:00:00')", "top AS (SELECT * FROM hit ORDER BY published_at DESC, id LIMIT 60)", sql="SELECT id, least(CASE WHEN contains(hay, 'port strike') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END + least(CAST(0.3 AS DOUBLE), CAST(0.1 AS DOUBLE) * (CAST(contains(hay, 'port') AS INT) + CAST(contains(hay, 'strike') AS INT))) + CASE WHEN contains(lower(title), 'port strike') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, CAST(1.0 AS DOUBLE)) AS relevance FROM top ORDER BY relevance DESC, published_at DESC, id LIMIT 20")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 of the latest 60 matches; a null column drops out of the test."""
    return search_articles(raw_articles(spark, sf_dir), "port strike", F.expr("timestamp_ntz'2024-01-03 00:00:00'"), 20).select("id", "relevance")


def search_articles(articles: DataFrame, text: str, since, limit: int) -> DataFrame:
    match = F.lit(False)
    for c in ("title", "description", "content_snippet"):
        match = match | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    hay = F.lower(F.concat_ws(" ", "title", F.nullif("description", F.lit("")), F.nullif("content_snippet", F.lit(""))))
    latest = articles.where(match & (F.col("published_at") >= since)).orderBy(F.desc("published_at"), "id").limit(3 * limit).withColumn("_hay", hay)
    low = text.strip().lower()
    terms = sum((F.contains("_hay", F.lit(t)).cast("int") for t in low.split()[1:]), F.contains("_hay", F.lit(low.split()[0])).cast("int"))
    score = F.when(F.contains("_hay", F.lit(low)), 0.5).otherwise(0.0) + F.least(F.lit(0.3), F.lit(0.1) * terms) + F.when(F.contains(F.lower("title"), F.lit(low)), 0.2).otherwise(0.0)
    return latest.withColumn("relevance", F.least(score, F.lit(1.0))).drop("_hay").orderBy(F.desc("relevance"), F.desc("published_at"), "id").limit(limit)


_dup_order = "CASE WHEN processing_status = 'completed' THEN 1 ELSE 0 END DESC, (CASE WHEN supplier IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN risk_event_checked_at IS NOT NULL THEN 1 ELSE 0 END) DESC, processed_at DESC, id DESC"


@query(PROCESSED, sql=f"SELECT id, raw_article_id, first_value(id) OVER (PARTITION BY raw_article_id ORDER BY {_dup_order}) AS survivor_id FROM processed")
def duplicate_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = F.when(F.col("supplier").isNotNull(), 1).otherwise(0) + F.when(F.col("risk_event_checked_at").isNotNull(), 1).otherwise(0)
    order = [F.when(F.col("processing_status") == "completed", 1).otherwise(0).desc(), rich.desc(), F.desc("processed_at"), F.desc("id")]
    return dedup.survivors(processed(spark, sf_dir), "raw_article_id", order).select("id", "raw_article_id", "survivor_id")


@query(PROCESSED, sql="SELECT raw_article_id, count(*) AS n FROM processed GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed(spark, sf_dir).groupBy("raw_article_id").agg(F.count("*").alias("n")).where("n > 1")


USERS = f"""users AS (SELECT c_custkey AS user_id, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'automotive' WHEN 'BUILDING' THEN 'construction' END AS want_category,
    CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN lower(r_name) ELSE 'germany' END AS want_region, CASE WHEN c_custkey % 5 = 0 THEN 'bosch' END AS want_supplier, CASE WHEN c_custkey % 6 = 0 THEN 'toyota' END AS no_supplier
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
arts AS (SELECT id, processed_at, {category_sql('top_level_category')} AS category, lower(supplier) AS supplier,
    CASE lower(region) {' '.join(f'WHEN {q(a)} THEN {q(c.lower())}' for a, c in D.REGION_ALIASES.items())} ELSE lower(region) END AS region
  FROM processed WHERE processed_at >= {NOW_SQL} - INTERVAL 7 DAY AND processed_at <= {NOW_SQL})"""


def feed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(articles of the last week, every customer as a user) with their token arrays."""
    some = lambda c: F.array_compact(F.array(c))
    a = processed(spark, sf_dir).where((F.col("processed_at") >= now() - F.expr("interval 7 days")) & (F.col("processed_at") <= now()))
    none = F.expr("cast(array() as array<string>)")
    arts = a.select("id", "processed_at", personal.category_tokens(some("top_level_category")).alias("categories"), personal.tokens(some("supplier")).alias("suppliers"), personal.region_tokens(some("region")).alias("regions"), none.alias("signals"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    category = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "automotive").when(F.col("c_mktsegment") == "BUILDING", "construction")
    users = c.select(k.alias("user_id"), some(category).alias("wanted_categories"), some(F.when(k % 5 == 0, "bosch")).alias("wanted_suppliers"), some(F.when(k % 4 == 1, F.lower("r_name")).when(k % 4 > 1, "germany")).alias("wanted_regions"), none.alias("wanted_signals"), some(F.when(k % 6 == 0, "toyota")).alias("excluded_suppliers"))
    return arts, users


_focus = "(want_category IS NOT NULL OR want_supplier IS NOT NULL)"


@query(PROCESSED, USERS, f"""scored AS (SELECT user_id, id, processed_at,
    CASE WHEN want_category IS NULL THEN CAST(0.5 AS DOUBLE) WHEN category = want_category THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.3 AS DOUBLE)
    + CASE WHEN supplier IS NULL OR want_supplier IS NULL THEN CAST(0.5 AS DOUBLE) WHEN supplier = want_supplier THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.3 AS DOUBLE)
    + CASE WHEN want_region IS NULL THEN CAST(0.5 AS DOUBLE) WHEN region = want_region THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS rank_score
  FROM users JOIN arts ON CASE WHEN {_focus} THEN coalesce(category = want_category, false) OR coalesce(supplier = want_supplier, false) WHEN want_region IS NOT NULL THEN coalesce(region = want_region, false) ELSE true END
  WHERE NOT coalesce(supplier = no_supplier, false))""", sql="SELECT user_id, id, round(rank_score, 6) AS rank_score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, processed_at DESC, id) AS r FROM scored WHERE rank_score >= 0.3) WHERE r <= 50")
def personal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 of every customer, those without any interest too."""
    return shown_feed(personal.feeds(*feed_tables(spark, sf_dir)))


def shown_feed(f: DataFrame) -> DataFrame:
    return f.select("user_id", "id", F.round("rank_score", 6).alias("rank_score"), F.col("rank").cast("long").alias("rank"))




@query(PROCESSED, USERS, sql=f"SELECT CASE WHEN {_focus} THEN 'focus' WHEN want_region IS NOT NULL THEN 'region' ELSE 'all' END AS kind, count(DISTINCT user_id) AS users FROM users GROUP BY 1")
def preference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds_of(feed_tables(spark, sf_dir)[1])


def kinds_of(users: DataFrame) -> DataFrame:
    focus = (F.size("wanted_categories") > 0) | (F.size("wanted_suppliers") > 0)
    return users.groupBy(F.when(focus, "focus").when(F.size("wanted_regions") > 0, "region").otherwise("all").alias("kind")).agg(F.count_distinct("user_id").alias("users"))


@query(PROCESSED, sql="SELECT user_key, id, rank FROM (SELECT user_key, id, row_number() OVER (PARTITION BY user_key ORDER BY confidence DESC, processed_at DESC, id) AS rank FROM processed) WHERE rank <= 6")
def feed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_key").orderBy(F.desc("confidence"), F.desc("processed_at"), "id")
    return processed(spark, sf_dir).select("user_key", "id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 6")


@query(PROCESSED, RAW_ARTICLES, sql="SELECT p.id, r.title, p.processed_at FROM processed p JOIN raw_articles r ON r.id = p.raw_article_id WHERE p.risk_event_checked_at IS NULL ORDER BY p.processed_at, p.id LIMIT 500")
def risk_scan_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed(spark, sf_dir).where("risk_event_checked_at is null").select(F.col("id").alias("pid"), "raw_article_id", "processed_at")
    return p.join(raw_articles(spark, sf_dir), F.col("raw_article_id") == F.col("id")).orderBy("processed_at", "pid").limit(500).select(F.col("pid").alias("id"), "title", "processed_at")


@query(PROCESSED, RAW_ARTICLES, sql="SELECT count(*) AS n, min(id) AS first_id FROM raw_articles r WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.raw_article_id = r.id)")
def unprocessed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = processed(spark, sf_dir).select(F.col("raw_article_id").alias("id"))
    return raw_articles(spark, sf_dir).join(done, "id", "left_anti").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


# ---- retention, lifecycle, operations ----


@query(RISK_EVENTS, PROCESSED, sql=f"SELECT 'risk_events' AS dataset, count(*) FILTER (published_at < {NOW_SQL} - INTERVAL 14 DAY) AS deleted, count(*) FILTER (NOT published_at < {NOW_SQL} - INTERVAL 14 DAY) AS kept FROM risk_events UNION ALL SELECT 'processed', count(*) FILTER (processed_at < {NOW_SQL} - INTERVAL 30 DAY), count(*) FILTER (NOT processed_at < {NOW_SQL} - INTERVAL 30 DAY) FROM processed")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    def counts(df: DataFrame, at: str, name: str) -> DataFrame:
        gone = lifecycle.expired(df, at, now(), D.RETENTION_DAYS[name])
        return df.agg(F.lit(name).alias("dataset"), F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))

    return counts(risk_events(spark, sf_dir), "published_at", "risk_events").unionByName(counts(processed(spark, sf_dir), "processed_at", "processed"))


LIFE = """life AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'normalization_retry' WHEN 2 THEN 'completed' WHEN 3 THEN 'deferred' WHEN 4 THEN 'skipped' ELSE 'processing' END AS s,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS n, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS l, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'w' || CAST(event_id % 3 AS VARCHAR) END AS o, event_id % 9 + 1 AS attempt FROM events)"""


def life(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    status = F.when(k % 6 == 1, "normalization_retry").when(k % 6 == 2, "completed").when(k % 6 == 3, "deferred").when(k % 6 == 4, "skipped").when(k % 6 == 5, "processing")
    return table(spark, sf_dir, "events").select("event_id", status.alias("enrichment_status"), F.when(k % 4 != 0, ts).alias("enrichment_next_attempt_at"), F.when(k % 3 != 0, ts).alias("enrichment_lease_expires_at"), F.when(k % 5 != 0, F.concat(F.lit("w"), (k % 3).cast("string"))).alias("enrichment_lease_owner"), (k % 9 + 1).alias("attempt"))


JAN15 = "TIMESTAMP '2024-01-15 00:00:00'"


@query(LIFE, sql=f"""SELECT coalesce((s IS NULL OR s IN ('normalization_retry', 'enrichment_retry', 'deferred', 'processing')) AND (n IS NULL OR n <= {JAN15}) AND (l IS NULL OR l <= {JAN15}), false) AS claimable,
  coalesce(s IN ('completed', 'skipped', 'quality_rejected') OR n > {JAN15} OR (l > {JAN15} AND o <> 'w1'), false) AS unavailable, count(*) AS n FROM life GROUP BY ALL""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    false = F.lit(False)
    a = life(spark, sf_dir).select(F.coalesce(lifecycle.claimable(at), false).alias("claimable"), F.coalesce(lifecycle.unavailable(at, F.lit("w1")), false).alias("unavailable"))
    return a.groupBy("claimable", "unavailable").agg(F.count("*").alias("n"))


@query(LIFE, sql="SELECT attempt, CAST(least(360, 15 * pow(2, attempt - 1)) AS INT) AS minutes, count(*) AS n FROM life GROUP BY ALL")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life(spark, sf_dir).select("attempt", lifecycle.retry_minutes(F.col("attempt")).alias("minutes")).groupBy("attempt", "minutes").agg(F.count("*").alias("n"))


@query(sql="SELECT date_trunc('hour', ts) - to_hours(hour(ts) % 6) AS run_key, count(*) AS fetched, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS bytes, count(DISTINCT user_id) AS sources FROM events GROUP BY 1")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by six-hour run."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "6 hours")["start"].alias("run_key")).agg(F.count("*").alias("fetched"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("bytes"), F.count_distinct("user_id").alias("sources"))


@query(sql="SELECT event_id, user_id, n, CASE WHEN n >= 3 THEN greatest(1, 7200 - CAST(epoch(ts) - epoch(oldest) AS BIGINT)) END AS wait_s FROM (SELECT event_id, user_id, ts, count(*) OVER w AS n, min(ts) OVER w AS oldest FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7199999999 microseconds' PRECEDING AND CURRENT ROW))")
def failure_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the last two hours at each failure, and the seconds to wait from the third on."""
    return lifecycle.throttled(table(spark, sf_dir, "events").where("event_type = 'error'")).select("event_id", "user_id", "n", "wait_s")


@query(sql="""WITH RECURSIVE e AS (SELECT user_id AS source_id, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT source_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS failures, CAST(NULL AS TIMESTAMP) AS last_at FROM (SELECT DISTINCT source_id FROM e)
  UNION ALL SELECT e.source_id, e.k,
    CASE WHEN NOT ok THEN failures + 1 WHEN failures < 5 OR e.ts >= last_at + INTERVAL 30 MINUTE THEN 0 ELSE failures END, CASE WHEN NOT ok THEN e.ts ELSE last_at END
  FROM f JOIN e ON e.source_id = f.source_id AND e.k = f.k + 1)
SELECT source_id, arg_max(failures, k) AS failures, CASE WHEN arg_max(failures, k) >= 5 THEN arg_max(last_at, k) END AS opened_at FROM f GROUP BY 1""")
def circuit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return lifecycle.circuit_fold(e)


@query(sql="SELECT user_id AS tenant, CAST(ts AS DATE) AS spend_date, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls, greatest(0, 500 - CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT)) AS remaining FROM events GROUP BY ALL")
def spend_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("tenant"), F.to_date("ts").alias("spend_date")).agg(F.sum(F.floor("value").cast("long")).alias("tokens"), F.count("*").alias("calls"))
    return e.withColumn("remaining", F.greatest(F.lit(0).cast("long"), 500 - F.col("tokens")))


@query(sql="SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 300 AS over_cap FROM events")
def spend_overage(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.sum(F.floor("value").cast("long")).over(w) > 300).alias("over_cap"))


@query(sql="SELECT day, event_type, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day), 6) AS share FROM (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL)")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day by type and their share of the day, as the error-ratio alert reads them."""
    n = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("day")), 6))


@query(sql="SELECT user_id, max(ts) AS last_seen, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR > max(ts) AS stale FROM events WHERE event_type = 'purchase' GROUP BY 1")
def stage_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max("ts")
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(last.alias("last_seen"), (F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 6 hours") > last).alias("stale"))


@query(sql="SELECT width_bucket, count(*) AS n FROM (SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE 1000000 END AS width_bucket FROM events) GROUP BY 1")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.when(v <= 10, 10).when(v <= 50, 50).when(v <= 100, 100).otherwise(1000000).alias("width_bucket")).agg(F.count("*").alias("n"))


@query(sql="SELECT DISTINCT id FROM (SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer UNION SELECT user_id FROM events UNION SELECT conv_id FROM conversations UNION SELECT l_suppkey FROM lineitem)")
def user_id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id")) for t, c in (("orders", "o_custkey"), ("customer", "c_custkey"), ("events", "user_id"), ("conversations", "conv_id"), ("lineitem", "l_suppkey"))]
    out = ids[0]
    for x in ids[1:]:
        out = out.unionByName(x)
    return out.distinct()


# ---- currencies and chat ----


@query(FX_TICKS, "daily AS (SELECT currency, CAST(seen_at AS DATE) AS day, arg_max(rate, (seen_at, event_id)) AS rate FROM fx_ticks GROUP BY ALL)", "r AS (SELECT currency, arg_max(rate, day) AS latest_rate, min(rate) AS range_low, max(rate) AS range_high FROM daily GROUP BY 1)", "p AS (SELECT *, CASE WHEN range_high = range_low THEN CAST(0.5 AS DOUBLE) ELSE greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), (latest_rate - range_low) / (range_high - range_low))) END AS range_position FROM r)", sql="SELECT currency, latest_rate, range_low, range_high, round(range_position, 6) AS range_position, CASE WHEN range_position >= 0.8 THEN 'EUR is near its 30-day high vs ' || currency || '; euro-denominated buyers may have stronger purchasing power for suppliers priced in this currency.' WHEN range_position <= 0.2 THEN 'EUR is near its 30-day low vs ' || currency || '; consider extra review before timing large purchases priced in this currency.' ELSE 'EUR is mid-range vs ' || currency || ' over 30 days; currency timing is not sending a strong procurement signal.' END AS procurement_signal FROM p")
def fx_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = fx_ticks(spark, sf_dir).groupBy("currency", F.to_date("seen_at").alias("day")).agg(F.max_by("rate", F.struct("seen_at", "event_id")).alias("rate"))
    return fx_signals(daily, 30)


def fx_signals(daily: DataFrame, days: int) -> DataFrame:
    """Range, position in it and advice by currency, from one rate a day."""
    r = daily.groupBy("currency").agg(F.max_by("rate", "day").alias("latest_rate"), F.min("rate").alias("range_low"), F.max("rate").alias("range_high"))
    flat = F.col("range_high") == F.col("range_low")
    position = F.when(flat, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("latest_rate") - F.col("range_low"), F.col("range_high") - F.col("range_low")))))
    r = r.withColumn("_p", position)
    say = lambda form: F.format_string(form.replace("{d}", str(days)), "currency")
    advice = F.when(F.col("_p") >= 0.8, say("EUR is near its {d}-day high vs %s; euro-denominated buyers may have stronger purchasing power for suppliers priced in this currency.")).when(F.col("_p") <= 0.2, say("EUR is near its {d}-day low vs %s; consider extra review before timing large purchases priced in this currency.")).otherwise(say("EUR is mid-range vs %s over {d} days; currency timing is not sending a strong procurement signal."))
    return r.select("currency", "latest_rate", "range_low", "range_high", F.round("_p", 6).alias("range_position"), advice.alias("procurement_signal"))


@query(sql="SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, substr(arg_min(text, turn), 1, 200) AS title, count(*) FILTER (role = 'user') AS from_user FROM conversations GROUP BY 1")
def chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(F.min_by("text", "turn"), 1, 200).alias("title"), F.count_if(F.col("role") == "user").alias("from_user"))


@query(PROCESSED, sql="SELECT user_key, string_agg('- ' || normalized_title || ' [' || priority_signal || ']: ' || substr(summary, 1, 200), chr(10) ORDER BY processed_at DESC, id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY processed_at DESC, id) AS r FROM processed) WHERE r <= 6 GROUP BY 1")
def chat_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_key").orderBy(F.desc("processed_at"), "id")
    top = processed(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 6")
    line = F.concat(F.lit("- "), "normalized_title", F.lit(" ["), "priority_signal", F.lit("]: "), F.substring("summary", 1, 200))
    return top.groupBy("user_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda x: x["line"]), "\n").alias("digest"))


# ---- source registry ----

_terms = ", ".join(f"({i}, {q(g)}, {q(t)})" for i, (g, t) in enumerate((g, t) for g, ts in D.QUERY_GROUPS.items() for t in ts))


@query(f"terms(place, query_group, term) AS (VALUES {_terms})", sql="SELECT 'newsapi' AS provider, query_group, term FROM terms WHERE place < 5 UNION ALL SELECT p, query_group, term FROM terms, (VALUES ('gdelt'), ('rss')) v(p)")
def provider_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search terms by provider: the first five for the metered one, all for the rest."""
    rows = [(i, g, t) for i, (g, t) in enumerate((g, t) for g, ts in D.QUERY_GROUPS.items() for t in ts)]
    terms = spark.createDataFrame(rows, "place int, query_group string, term string")
    most = F.when(F.col("provider") == "newsapi", 5).otherwise(1000)
    return terms.withColumn("provider", F.explode(F.array(*map(F.lit, ("newsapi", "gdelt", "rss"))))).where(F.col("place") < most).select("provider", "query_group", "term")


