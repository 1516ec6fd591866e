"""The engine's tables as views of the generic test tables, each with the same definition in SQL for the oracle.

Every function takes (spark, sf_dir) and reads whole tables; the text beside it defines the same rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import spread, table

#: Phrases that give the invented prose something to find: one or more for each rule, and some that must not match.
PHRASES = (
    "Siemens AG files insolvency papers in Germany", "Rival takeover of Nexans agreed with banks", "New tariff on steel from China announced", "EU embargo hits Iran oil trade",
    "Port strike halts cargo in the Netherlands", "Labor dispute at Bosch factory in Poland", "Supply shortage of memory chips deepens", "Recall of brake parts by Toyota widens",
    "New regulation on packaging waste in France", "Hostilities in the red sea raise freight cost", "Missile attack disrupts shipping near Yemen", "Ransomware hits Acme Logistics GmbH servers",
    "Exchange rate swings worry buyers in Japan", "Critical minerals demand rises in Canada", "Shipping delay at the Suez canal persists", "Work stoppage at plant in Mexico",
    "Quality issue found in solar battery line", "Customs duty increase for cars from Korea", "Energy price relief for US industry", "Gesetz und Verordnung treten in Kraft",
    "Global Motors Corp. expands capacity in India", "Factory shutdown after earthquake in Taiwan", "Walkout ends after two days", "Merger talks between Apple and rivals stall",
    "Quiet day on the markets", "Strikethrough typography is back", "The warden likes gardens", "Ideal weather for crops",
    "Trade war fears ease in Brussels", "Chapter 11 case closes", "Transport disruption in Spain", "Commodity price index is flat",
)


def phrase_sql() -> str:
    return " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))


def thousandths(c: Column) -> Column:
    """A double to three places as SQL's round does it: scaled, rounded to a whole number, scaled back. Spark's round goes by
    the shortest decimal instead, which makes other numbers of some halves."""
    return F.round(c * 1000) / 1000


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw articles: a phrase and the text's first line as title, its second line as description, the whole text as content."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    n = len(PHRASES)
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % n).cast("int") + 1)
    line = lambda k: F.coalesce(F.try_element_at(F.split("text", "\n"), F.lit(k)), F.lit(""))
    return docs.select(
        F.col("doc_id").alias("id"),
        F.concat(phrase, F.lit(" "), line(1)).alias("title"),
        F.nullif(line(2), F.lit("")).alias("description"),
        F.coalesce("text", F.lit("")).alias("content_snippet"),
        F.concat(F.lit("https://"), F.when(F.col("doc_id") % 41 == 0, "www.content-farm.com").when(F.col("doc_id") % 7 == 0, "www.reuters.com").otherwise(F.concat("source", F.lit(".example.com"))), F.lit("/a/"), (F.col("doc_id") % 500).cast("string"), F.lit("?utm_source=x&id="), (F.col("doc_id") % 300).cast("string")).alias("article_url"),
        F.element_at(F.array(F.lit("rss"), F.lit("gdelt"), F.lit("eu_sanctions")), (F.col("doc_id") % 3).cast("int") + 1).alias("provider"),
        F.concat(F.lit("p"), (F.col("doc_id") % 400).cast("string")).alias("provider_article_id"),
        F.element_at(F.array(F.lit("logistics_disruption"), F.lit("tariff_changes"), F.lit("other"), F.lit("regional")), (F.col("doc_id") % 4).cast("int") + 1).alias("query_group"),
        F.col("source").alias("source_name"),
        F.element_at(F.array(F.lit("official"), F.lit("established_media"), F.lit("industry"), F.lit("blog")), (F.col("doc_id") % 4).cast("int") + 1).alias("source_class"),
        F.coalesce("lang", F.lit("en")).alias("language"),
        F.timestamp_add("HOUR", (F.col("doc_id") * 37 % 720).cast("int"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("published_at"),
    )


RAW_ARTICLES = f"""raw_articles AS (
  SELECT doc_id AS id,
    (CASE doc_id % {len(PHRASES)} {phrase_sql()} END) || ' ' || coalesce(string_split(text, chr(10))[1], '') AS title,
    nullif(coalesce(string_split(text, chr(10))[2], ''), '') AS description,
    coalesce(text, '') AS content_snippet,
    'https://' || CASE WHEN doc_id % 41 = 0 THEN 'www.content-farm.com' WHEN doc_id % 7 = 0 THEN 'www.reuters.com' ELSE source || '.example.com' END
      || '/a/' || CAST(doc_id % 500 AS VARCHAR) || '?utm_source=x&id=' || CAST(doc_id % 300 AS VARCHAR) AS article_url,
    CASE doc_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'gdelt' ELSE 'eu_sanctions' END AS provider,
    'p' || CAST(doc_id % 400 AS VARCHAR) AS provider_article_id,
    CASE doc_id % 4 WHEN 0 THEN 'logistics_disruption' WHEN 1 THEN 'tariff_changes' WHEN 2 THEN 'other' ELSE 'regional' END AS query_group,
    source AS source_name,
    CASE doc_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'established_media' WHEN 2 THEN 'industry' ELSE 'blog' END AS source_class,
    coalesce(lang, 'en') AS language,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id * 37 % 720 AS BIGINT)) AS published_at
  FROM documents)"""


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed articles, one an order; every seventh order's article stands for another's raw article too."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)
    return o.select(
        key.alias("id"),
        F.when(key % 7 == 0, key - 1).otherwise(key).alias("raw_article_id"),
        pick(CATEGORY_PICK, key).alias("top_level_category"),
        pick(SIGNAL_PICK, key).alias("priority_signal"),
        pick(REGION_PICK, key).alias("region"),
        F.when(key % 3 > 0, pick(SUPPLIER_PICK, key)).alias("supplier"),
        F.concat(pick(SIGNAL_PICK, key), F.lit(" news from "), pick(REGION_PICK, key), F.lit(" for "), pick(SUPPLIER_PICK, key), F.lit(" no "), key.cast("string")).alias("normalized_title"),
        F.concat(F.lit("Summary "), F.lower("o_orderpriority")).alias("summary"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("processing_status"),
        thousandths(F.col("o_totalprice") % 1000 / 1000).alias("confidence"),
        F.col("o_orderdate").alias("processed_at"),
        F.when(key % 5 > 0, F.col("o_orderdate")).alias("risk_event_checked_at"),
        F.col("o_custkey").alias("user_key"),
    )


CATEGORY_PICK = ("automotive", "Construction", "raw materials", "chips", "logistics", "general", "household goods")
SIGNAL_PICK = ("tariff", "port strike", "m&a", "recall", "expansion", "insolvency", "weather", "red sea", "embargo")
REGION_PICK = ("Germany", "us", "Middle East", "Hormuz", "Asia", "Europe", "Atlantis", "suez")
SUPPLIER_PICK = ("Siemens AG", "Bosch", "Acme GmbH", "Toyota", "Nexans SA")


def _pick(values: tuple[str, ...], by: str = "o_orderkey") -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


PROCESSED = f"""processed AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS raw_article_id,
    {_pick(CATEGORY_PICK)} AS top_level_category, {_pick(SIGNAL_PICK)} AS priority_signal, {_pick(REGION_PICK)} AS region,
    CASE WHEN o_orderkey % 3 > 0 THEN {_pick(SUPPLIER_PICK)} END AS supplier,
    {_pick(SIGNAL_PICK)} || ' news from ' || {_pick(REGION_PICK)} || ' for ' || {_pick(SUPPLIER_PICK)} || ' no ' || CAST(o_orderkey AS VARCHAR) AS normalized_title,
    'Summary ' || lower(o_orderpriority) AS summary,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS processing_status,
    round(o_totalprice % 1000 / 1000, 3) AS confidence, o_orderdate AS processed_at,
    CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS risk_event_checked_at, o_custkey AS user_key
  FROM orders)"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    form = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("s_suppkey") % len(FORMS)).cast("int") + 1)
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("public_id"), F.concat("s_name", F.lit(" "), form).alias("canonical_name"), F.col("n_name").alias("country"), (F.col("s_acctbal") > 0).alias("is_active"))


FORMS = ("GmbH", "AG", "S.p.A.", "Co., Ltd.", "Group", "Inc.", "Company Co")
SUPPLIERS = f"""suppliers AS (
  SELECT s_suppkey AS id, 'sup-' || CAST(s_suppkey AS VARCHAR) AS public_id, s_name || ' ' || {_pick(FORMS, 's_suppkey')} AS canonical_name, n_name AS country, s_acctbal > 0 AS is_active
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier mentions, one a line item; the seventh line of an order names nobody known."""
    li = table(spark, sf_dir, "lineitem")
    known = F.col("l_linenumber") != 7
    return li.select(F.col("l_orderkey").alias("processed_article_id"), F.when(known, F.col("l_suppkey")).alias("supplier_id"), F.when(known, F.concat(F.lit("supplier#"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("unknown "), (F.col("l_partkey") % 50).cast("string"))).alias("surface_form"), F.when(known, 1.0).otherwise(0.0).alias("confidence"))


MENTIONS = """mentions AS (
  SELECT l_orderkey AS processed_article_id, CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS supplier_id,
    CASE WHEN l_linenumber <> 7 THEN 'supplier#' || CAST(l_suppkey AS VARCHAR) ELSE 'unknown ' || CAST(l_partkey % 50 AS VARCHAR) END AS surface_form,
    CASE WHEN l_linenumber <> 7 THEN 1.0 ELSE 0.0 END AS confidence
  FROM lineitem)"""


def risk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)
    return o.select(
        key.alias("id"), key.alias("processed_article_id"), pick(RISK_PICK).alias("risk_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low").alias("severity"),
        F.round(F.lit(0.55) + (key % 40).cast("double") / 100, 2).alias("confidence"),
        F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "new").otherwise("dismissed").alias("status"),
        F.array(pick(SUPPLIER_PICK)).alias("affected_suppliers"), F.array(F.concat(F.lit("sup-"), (key % 100 + 1).cast("string")), F.concat(F.lit("sup-"), (key % 37 + 1).cast("string"))).alias("affected_supplier_ids"),
        F.array(pick(REGION_PICK)).alias("affected_locations"), F.array(pick(CATEGORY_PICK)).alias("affected_categories"), F.col("o_orderdate").alias("published_at"),
    )


RISK_PICK = ("tariff", "strike", "sanctions", "logistics", "bankruptcy")
RISK_EVENTS = f"""risk_events AS (
  SELECT o_orderkey AS id, o_orderkey AS processed_article_id, {_pick(RISK_PICK)} AS risk_type,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
    round(CAST(0.55 AS DOUBLE) + CAST(o_orderkey % 40 AS DOUBLE) / 100, 2) AS confidence,
    CASE o_orderstatus WHEN 'F' THEN 'reviewed' WHEN 'O' THEN 'new' ELSE 'dismissed' END AS status,
    [{_pick(SUPPLIER_PICK)}] AS affected_suppliers, ['sup-' || CAST(o_orderkey % 100 + 1 AS VARCHAR), 'sup-' || CAST(o_orderkey % 37 + 1 AS VARCHAR)] AS affected_supplier_ids,
    [{_pick(REGION_PICK)}] AS affected_locations, [{_pick(CATEGORY_PICK)}] AS affected_categories, o_orderdate AS published_at
  FROM orders)"""


def fx_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.upper(F.substring("event_type", 1, 3)).alias("currency"), F.col("ts").alias("seen_at"), F.col("event_id"), (F.col("value") + 1).alias("rate"))


FX_TICKS = "fx_ticks AS (SELECT upper(substr(event_type, 1, 3)) AS currency, ts AS seen_at, event_id, value + 1 AS rate FROM events)"
