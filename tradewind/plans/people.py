"""Queries over what users write and save: conversations, preferences, signal lists, retries, extraction judged by sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import signals as S
from tradewind.operators import chat, lifecycle, preferences, supply
from tradewind.plans import articles as A
from tradewind.plans import relations as R
from tradewind.plans import stores
from tradewind.plans.articles import q
from tradewind.plans.registry import query
from tradewind.session import table
from tradewind.sources.adapters import MENTIONS, PHRASES, PROCESSED, RAW_ARTICLES, SUPPLIERS, mentions, processed, raw_articles, suppliers

# ---- conversations ----

_start = "TIMESTAMP '2024-01-01 00:00:00'"
CHATS = f"""said AS (SELECT conv_id, conv_id % 20 AS user_id, conv_id * 1000 + turn AS message_id, role, text AS content, {_start} + to_minutes(CAST(conv_id * 7 % 900 + turn * (conv_id % 5) AS BIGINT)) AS created_at FROM conversations),
convs AS (SELECT DISTINCT conv_id, user_id, {_start} + to_minutes(CAST(conv_id * 7 % 900 AS BIGINT)) AS created_at FROM said),
kept_c AS (SELECT * FROM convs WHERE NOT (user_id % 6 = 0 AND created_at <= {_start} + to_minutes(300))), kept_m AS (SELECT * FROM said WHERE NOT (user_id % 6 = 0 AND created_at <= {_start} + to_minutes(300))),
threads AS (SELECT c.conv_id, c.user_id, c.created_at, substr(arg_min(m.content, (m.created_at, m.message_id)) FILTER (m.role = 'user' AND coalesce(m.content, '') <> ''), 1, 200) AS title, 2 * count(*) FILTER (m.role = 'assistant') AS message_count, max(m.created_at) FILTER (m.role = 'assistant') AS last_message_at
  FROM kept_c c LEFT JOIN kept_m m USING (conv_id) GROUP BY ALL)"""


def chats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(conversations, messages) of twenty users; every sixth user cleared theirs five hours after the first began."""
    start, k = F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("conv_id")
    at = lambda minutes: F.timestamp_add("MINUTE", minutes.cast("int"), start)
    c = table(spark, sf_dir, "conversations")
    said = c.select(k.alias("conversation_id"), (k % 20).alias("user_id"), (k * 1000 + F.col("turn")).alias("message_id"), "role", F.col("text").alias("content"), at(k * 7 % 900 + F.col("turn") * (k % 5)).alias("created_at"))
    convs = c.select(k.alias("conversation_id"), (k % 20).alias("user_id"), at(k * 7 % 900).alias("created_at")).distinct()
    cleared = convs.where("user_id % 6 = 0").select("user_id", at(F.lit(300)).alias("cleared_at")).distinct()
    return chat.left_after(convs, cleared, "created_at"), chat.left_after(said, cleared, "created_at")


@query(CHATS, sql="SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY last_message_at DESC NULLS FIRST, created_at DESC, conv_id) AS place, conv_id AS conversation_id, title, message_count, last_message_at FROM threads")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's conversations in the order of their list, after some have cleared theirs."""
    found = chat.listed(chat.threads(*chats(spark, sf_dir)))
    return found.select("user_id", F.col("place").cast("long").alias("place"), "conversation_id", "title", "message_count", "last_message_at")


@query(CHATS, sql="SELECT m.conv_id AS conversation_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.created_at, message_id) AS place, message_id, role, count(*) OVER (PARTITION BY m.conv_id) AS total_count FROM kept_m m JOIN kept_c c ON c.conv_id = m.conv_id")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every conversation in order."""
    found = chat.history(*chats(spark, sf_dir))
    return found.select("conversation_id", F.col("place").cast("long").alias("place"), "message_id", "role", "total_count")


# ---- preferences ----


def _names(key: str, count: int) -> str:
    return f"['supplier#' || lpad(CAST({key} % {count} AS VARCHAR), 9, '0'), 'Nobody']"


SAVED = f"""old AS (SELECT c_custkey AS user_id, ['general'] AS pc, {_names('c_custkey', 60)} AS ps, ['logistics'] AS xc, ['logistics'] AS xt, CAST([] AS VARCHAR[]) AS xs, 'de' AS lang FROM customer WHERE c_custkey % 2 = 0),
asks AS (SELECT c_custkey AS user_id, 1 AS place, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ['Chips', 'electronics', 'automotive'] END AS pc, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {_names('c_custkey', 90)} END AS ps, CASE WHEN c_custkey % 7 = 0 THEN ['chips'] WHEN c_custkey % 7 = 1 THEN CAST([] AS VARCHAR[]) END AS xc, CASE WHEN c_custkey % 3 = 0 THEN ['Automotive'] END AS xt, {_names('c_custkey', 40)} AS xs, ' FR ' AS lang FROM customer WHERE c_custkey % 3 <> 2
  UNION ALL SELECT c_custkey, 2, NULL, CASE WHEN c_custkey % 10 = 0 THEN CAST([] AS VARCHAR[]) END, NULL, CASE WHEN c_custkey % 9 = 0 THEN ['general'] END, NULL, '' FROM customer WHERE c_custkey % 4 < 2),
r0 AS (SELECT a.*, o.user_id IS NULL AND row_number() OVER (PARTITION BY a.user_id ORDER BY place) = 1 AS born FROM asks a LEFT JOIN old o ON o.user_id = a.user_id),
r1 AS (SELECT user_id, place, CASE WHEN born THEN coalesce(pc, []) ELSE pc END AS pc, CASE WHEN born THEN coalesce(ps, []) ELSE ps END AS ps, CASE WHEN born THEN coalesce(xs, []) ELSE xs END AS xs, coalesce(nullif(lower(trim(lang)), ''), 'en') AS lang,
    CASE WHEN born THEN CASE WHEN len(xc) > 0 THEN xc WHEN len(xt) > 0 THEN xt ELSE [] END ELSE coalesce(xc, xt) END AS xc, CASE WHEN born THEN CASE WHEN len(xt) > 0 THEN xt WHEN len(xc) > 0 THEN xc ELSE [] END ELSE coalesce(xc, xt) END AS xt FROM r0),
n AS (SELECT user_id, arg_max(pc, place) FILTER (pc IS NOT NULL) AS pc, arg_max(ps, place) FILTER (ps IS NOT NULL) AS ps, arg_max(xs, place) FILTER (xs IS NOT NULL) AS xs, arg_max(xc, place) FILTER (xc IS NOT NULL) AS xc, arg_max(xt, place) FILTER (xt IS NOT NULL) AS xt, arg_max(lang, place) AS lang FROM r1 GROUP BY 1),
p AS (SELECT coalesce(n.user_id, old.user_id) AS user_id, n.user_id IS NOT NULL AS asked, coalesce(n.pc, old.pc) AS pc, coalesce(n.ps, old.ps) AS ps, coalesce(n.xs, old.xs) AS xs, coalesce(n.xc, old.xc) AS xc, coalesce(n.xt, old.xt) AS xt, coalesce(n.lang, old.lang) AS lang FROM old FULL JOIN n ON n.user_id = old.user_id),
canon AS (SELECT v, {A.category_sql('v')} AS c FROM (SELECT DISTINCT unnest(list_concat(list_concat(pc, xc), xt)) AS v FROM p)),
active AS (SELECT alias, public_id FROM aliases JOIN suppliers s ON s.id = supplier_id WHERE is_active)"""


def _canon(column: str) -> str:
    return f"coalesce((SELECT string_agg(c, '|' ORDER BY nth) FROM (SELECT c, min(nth) AS nth FROM (SELECT unnest({column}) AS v, generate_subscripts({column}, 1) AS nth) JOIN canon USING (v) GROUP BY c)), '')"


def _ids(column: str) -> str:
    return f"coalesce((SELECT string_agg(DISTINCT public_id, '|' ORDER BY public_id) FROM (SELECT unnest({column}) AS name) JOIN active ON alias = {R._norm('name')}), '')"


@query(SUPPLIERS, R.ALIASES, SAVED, stores.FEED, sql=f"SELECT p.user_id, {_canon('pc')} AS preferred_categories, array_to_string(ps, '|') AS preferred_suppliers, {_canon('xc')} AS excluded_categories, {_canon('xt')} AS excluded_topics, lang AS platform_language, CASE WHEN asked THEN {_ids('ps')} END AS preferred_supplier_ids, CASE WHEN asked THEN {_ids('xs')} END AS excluded_supplier_ids, CASE WHEN asked THEN 0 ELSE coalesce(f.n, 0) END AS feed_rows FROM p LEFT JOIN (SELECT user_id, count(*) AS n FROM feed GROUP BY 1) f ON f.user_id = p.user_id")
def preferences_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's preferences after up to two requests, with the supplier ids resolved, and what is left of their feeds."""
    s, c, k = suppliers(spark, sf_dir), table(spark, sf_dir, "customer"), F.col("c_custkey")
    none = F.expr("cast(array() as array<string>)")
    words = lambda *values: F.array(*map(F.lit, values))
    names = lambda count: F.array(F.concat(F.lit("supplier#"), F.lpad((k % count).cast("string"), 9, "0")), F.lit("Nobody"))
    lists = ("preferred_categories", "preferred_suppliers", "preferred_regions", "preferred_signals", "excluded_categories", "excluded_topics", "excluded_suppliers", "excluded_regions", "excluded_signals")

    def rows(of: DataFrame, language: str, *extra, **given) -> DataFrame:
        return of.select(k.alias("user_id"), *extra, *(given.get(n, F.lit(None).cast("array<string>")).alias(n) for n in lists), F.lit(language).alias("platform_language"))

    stored = rows(c.where("c_custkey % 2 = 0"), "de", preferred_categories=words("general"), preferred_suppliers=names(60), preferred_regions=none, preferred_signals=none, excluded_categories=words("logistics"), excluded_topics=words("logistics"), excluded_suppliers=none, excluded_regions=none, excluded_signals=none)
    first = rows(c.where("c_custkey % 3 <> 2"), " FR ", F.lit(1).alias("place"), preferred_categories=F.when(k % 5 != 0, words("Chips", "electronics", "automotive")), preferred_suppliers=F.when(k % 4 != 0, names(90)), excluded_categories=F.when(k % 7 == 0, words("chips")).when(k % 7 == 1, none), excluded_topics=F.when(k % 3 == 0, words("Automotive")), excluded_suppliers=names(40))
    second = rows(c.where("c_custkey % 4 < 2"), "", F.lit(2).alias("place"), preferred_suppliers=F.when(k % 10 == 0, none), excluded_topics=F.when(k % 9 == 0, words("general")))
    requests = first.unionByName(second)
    found = preferences.saved(stored, requests, supply.register(s, ascii_only=True), s, ascii_only=True)
    left = preferences.feeds_left(stores.feed(spark, sf_dir), requests).groupBy("user_id").agg(F.count("*").alias("feed_rows"))
    shown = ("preferred_categories", "preferred_suppliers", "excluded_categories", "excluded_topics")
    ids = ("preferred_supplier_ids", "excluded_supplier_ids")
    return found.join(left, "user_id", "left").select("user_id", *(F.array_join(n, "|").alias(n) for n in shown), "platform_language", *(F.when(F.col(n).isNotNull(), F.array_join(n, "|")).alias(n) for n in ids), F.coalesce("feed_rows", F.lit(0).cast("long")).alias("feed_rows"))


# ---- lists, retries, conflicts ----


@query(RAW_ARTICLES, A.SIGNALS, sql="SELECT 'type' AS by, id, signal_type, severity FROM (SELECT * FROM signals WHERE signal_type = 'tariff' ORDER BY id, signal_type LIMIT 25 OFFSET 5) UNION ALL SELECT 'entity', id, signal_type, severity FROM (SELECT * FROM signals WHERE id = 4 ORDER BY id, signal_type LIMIT 50) UNION ALL SELECT 'all', id, signal_type, severity FROM (SELECT * FROM signals WHERE signal_type = 'tariff' AND severity = 'high' AND id = 34 ORDER BY id, signal_type LIMIT 50)")
def signal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of signals by type, by the article that they name, and by type, article and severity at once."""
    found = A.classified(spark, sf_dir).select("id", "signal_type", "severity")
    pages = (("type", page_of(found, signal_type="tariff", skip=5, limit=25)), ("entity", page_of(found, entity=4)), ("all", page_of(found, signal_type="tariff", severity="high", entity=34)))
    out = None
    for name, page in pages:
        one = page.select(F.lit(name).alias("by"), "id", "signal_type", "severity")
        out = one if out is None else out.unionByName(one)
    return out


def page_of(found: DataFrame, signal_type: str | None = None, entity: int | None = None, severity: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of signals that meet every filter given, by id and type."""
    for column, value in (("signal_type", signal_type), ("id", entity), ("severity", severity)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.orderBy("id", "signal_type").offset(skip).limit(limit)


@query(R.LIFE, sql="SELECT stage, attempt, CAST(CASE stage WHEN 'normalise' THEN least(360, 15 * pow(2, attempt - 1)) * 60 WHEN 'enrich' THEN 7200 WHEN 'release' THEN 60 WHEN 'task' THEN 60 * pow(2, attempt) END AS BIGINT) AS seconds, count(*) AS n FROM (SELECT attempt, CASE event_id % 5 WHEN 0 THEN 'normalise' WHEN 1 THEN 'enrich' WHEN 2 THEN 'release' WHEN 3 THEN 'task' ELSE 'other' END AS stage FROM life) GROUP BY ALL")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each failed row waits for its next try, by the stage that failed and how often it has."""
    k = F.col("event_id") % 5
    stage = F.when(k == 0, "normalise").when(k == 1, "enrich").when(k == 2, "release").when(k == 3, "task").otherwise("other")
    rows = R.life(spark, sf_dir).select(stage.alias("stage"), "attempt")
    return rows.withColumn("seconds", lifecycle.retry_seconds(F.col("stage"), F.col("attempt")).cast("long")).groupBy("stage", "attempt", "seconds").agg(F.count("*").alias("n"))


@query(SUPPLIERS, R.ALIASES, f"asked AS (SELECT c_custkey AS id, 'Supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0') || CASE WHEN c_custkey % 2 = 0 THEN ' GmbH' ELSE '' END AS canonical_name FROM customer)", f"spelt AS (SELECT id, {R._norm('canonical_name')} AS alias FROM asked UNION SELECT id, trim(regexp_replace({R._norm('canonical_name')}, ' gmbh$', '')) FROM asked)", sql="SELECT s.id AS supplier_id, s.alias, a.supplier_id AS holder_id FROM spelt s JOIN aliases a USING (alias) WHERE a.supplier_id <> s.id")
def register_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New suppliers, one a customer, whose spellings a registered supplier holds already."""
    s, k = suppliers(spark, sf_dir), F.col("c_custkey")
    name = F.concat(F.lit("Supplier#"), F.lpad((k % 200).cast("string"), 9, "0"), F.when(k % 2 == 0, " GmbH").otherwise(""))
    asked = table(spark, sf_dir, "customer").select(k.alias("id"), name.alias("canonical_name"))
    return supply.conflicts(asked, supply.register(s, ascii_only=True), ascii_only=True)


@query(PROCESSED, MENTIONS, "payload AS (SELECT doc_id AS raw_article_id, '{\"names\": [' || CASE doc_id % 3 WHEN 0 THEN '' ELSE '\"Firm ' || CAST(doc_id AS VARCHAR) || '\", \"Alias\"' END || ']}' AS body FROM documents WHERE doc_id % 4 <> 3)", sql="SELECT p.id, json_extract_string(body, '$.names[0]') AS primary_name, CAST(json_array_length(body, '$.names') AS INT) AS names FROM processed p JOIN payload USING (raw_article_id) WHERE p.id NOT IN (SELECT processed_article_id FROM mentions WHERE supplier_id IS NULL)")
def unscreened_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a payload and no unresolved mention yet, and the names that screening would take from it."""
    k = F.col("doc_id")
    listed = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('"Firm '), k.cast("string"), F.lit('", "Alias"')))
    payload = table(spark, sf_dir, "documents").where("doc_id % 4 <> 3").select(k.alias("raw_article_id"), F.concat(F.lit('{"names": ['), listed, F.lit("]}")).alias("body"))
    seen = mentions(spark, sf_dir).where("supplier_id is null").select(F.col("processed_article_id").alias("id"))
    names = F.from_json("body", "names array<string>")["names"]
    found = processed(spark, sf_dir).join(payload, "raw_article_id").join(seen, "id", "left_anti")
    return found.select("id", F.get(names, F.lit(0)).alias("primary_name"), F.size(names).alias("names"))


# ---- extraction judged by sets ----

#: The regions that each phrase of the raw articles names (fixed values), by the phrase's number.
NAMED = {0: ("Germany",), 2: ("China",), 4: ("Netherlands",), 5: ("Poland",), 8: ("France",), 12: ("Japan",), 13: ("Canada",), 15: ("Mexico",), 20: ("India",), 21: ("Taiwan",), 30: ("Spain",)}


def recall(found, expected):
    """The share of the expected values that are found; 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))


_expected = "CASE id % 32 " + " ".join(f"WHEN {k} THEN [{', '.join(map(q, v))}]" for k, v in NAMED.items()) + " ELSE CAST([] AS VARCHAR[]) END"


@query(RAW_ARTICLES, "t AS (SELECT id, query_group, lower(title) AS low FROM raw_articles)", f"j AS (SELECT query_group, {A._regions} AS found, {_expected} AS expected FROM t)", "r AS (SELECT query_group, CASE WHEN len(expected) = 0 THEN CAST(1.0 AS DOUBLE) ELSE len(list_intersect(found, expected)) / CAST(len(expected) AS DOUBLE) END AS recall, len(expected) AS n FROM j)", sql="SELECT query_group, count(*) AS articles, sum(n)::BIGINT AS expected, round(avg(recall), 6) AS recall, avg(recall) >= 0.95 AS passes FROM r GROUP BY 1")
def extraction_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall of the regions extracted from titles against those that their phrases name, and whether the gate lets it pass."""
    k = F.col("id") % len(PHRASES)
    expected = F.coalesce(F.try_element_at(F.create_map(*(x for n, v in NAMED.items() for x in (F.lit(n).cast("long"), F.array(*map(F.lit, v))))), k), F.expr("cast(array() as array<string>)"))
    judged = raw_articles(spark, sf_dir).select("query_group", S.regions(F.col("title")).alias("found"), expected.alias("expected"))
    judged = judged.withColumn("recall", recall(F.col("found"), F.col("expected")))
    return judged.groupBy("query_group").agg(F.count("*").alias("articles"), F.sum(F.size("expected")).alias("expected"), F.round(F.avg("recall"), 6).alias("recall"), (F.avg("recall") >= 0.95).alias("passes"))
