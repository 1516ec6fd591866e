"""Queries over the source registry, caches, audit rows, preferences and evaluation sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.functions.text import plain_text
from tradewind.operators import audit
from tradewind.plans.articles import q
from tradewind.plans.registry import query
from tradewind.plans.relations import fx_monitor
from tradewind.session import spread, table
from tradewind.sources import registry
from tradewind.sources.adapters import FX_TICKS, PROCESSED, RAW_ARTICLES, RISK_EVENTS, processed, raw_articles, risk_events
from tradewind.sources.feeds import clean_quotes

_rows = ", ".join(f"({q(i)}, {q(a)}, {q(k)}, [{', '.join(map(q, d))}], {p}, {n}, CAST({t} AS DOUBLE), {str(on).lower()})" for i, _, _, _, a, k, d, _, p, n, _, t, on in registry.CATALOG)
CATALOG = f"catalog(source_id, adapter, source_class, domains, poll_minutes, item_limit, trust_seed, enabled) AS (VALUES {_rows})"
_domains = ", ".join(f"({q(d)})" for d in registry.DOMAINS)


@query(CATALOG, sql="SELECT source_id, source_class, poll_minutes, trust_seed FROM catalog WHERE enabled")
def enabled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.enabled(registry.catalog(spark)).select("source_id", "source_class", "poll_minutes", "trust_seed")


@query(CATALOG, f"every(domain) AS (VALUES {_domains})", "held AS (SELECT unnest(domains) AS domain, source_class = 'official' AS official, source_class = 'official' AND adapter = 'structured_sanctions' AS structured FROM catalog WHERE enabled)", "f AS (SELECT domain, bool_or(official) AS official, bool_or(structured) AS structured FROM held GROUP BY 1)", sql="SELECT e.domain, f.domain IS NOT NULL AS covered, coalesce(official, false) AS authoritative, CASE WHEN f.domain IS NULL THEN 'missing' WHEN e.domain IN ('sanctions', 'regulation') AND NOT official THEN 'no official source' WHEN e.domain = 'sanctions' AND NOT structured THEN 'no structured source' ELSE '' END AS gap FROM every e LEFT JOIN f USING (domain)")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.coverage(registry.catalog(spark))


@query(CATALOG, sql="SELECT source_id, CASE WHEN source_id LIKE 'eu%' THEN 30 ELSE poll_minutes END AS poll_minutes, item_limit, CASE WHEN source_id = 'freightwaves' THEN true ELSE enabled END AS enabled FROM catalog")
def source_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = registry.catalog(spark)
    faster = c.where("source_id like 'eu%'").select("source_id", F.lit(30).alias("poll_minutes"), F.lit(None).cast("int").alias("item_limit"), F.lit(None).cast("boolean").alias("enabled"))
    on = c.where("source_id = 'freightwaves'").select("source_id", F.lit(None).cast("int").alias("poll_minutes"), F.lit(None).cast("int").alias("item_limit"), F.lit(True).alias("enabled"))
    return registry.configured(c, faster.unionByName(on)).select("source_id", "poll_minutes", "item_limit", "enabled")


@query(CATALOG, sql="SELECT source_id, 'poll_minutes' AS violation FROM catalog WHERE poll_minutes > 1000 UNION ALL SELECT source_id, 'duplicate source_id' FROM catalog, (VALUES (1), (2)) t(k) WHERE source_id = 'oilprice'")
def source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions polled twice too rarely, and one given twice."""
    c = registry.catalog(spark)
    bad = c.withColumn("poll_minutes", F.when(F.col("poll_minutes") > 1000, 2 * F.col("poll_minutes")).otherwise(F.col("poll_minutes")))
    return registry.violations(bad.unionByName(c.where("source_id = 'oilprice'")))


@query(FX_TICKS, "daily AS (SELECT currency, CAST(seen_at AS DATE) AS day, arg_max(rate, (seen_at, event_id)) AS rate FROM fx_ticks GROUP BY ALL)", "r AS (SELECT currency, arg_max(rate, day) AS latest, min(rate) AS low, max(rate) AS high FROM daily GROUP BY 1)", "p AS (SELECT currency, round(greatest(0.0, least(1.0, (latest - low) / (high - low))), 6) AS range_position FROM r)", sql="SELECT currency, range_position, row_number() OVER (ORDER BY abs(range_position - 0.5) DESC, currency) AS place, range_position = max(range_position) OVER () AS strongest FROM p")
def fx_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currencies by distance from mid-range; a handful of rows, so one window over all is fine."""
    m = fx_monitor(spark, sf_dir).select("currency", "range_position")
    place = F.row_number().over(Window.orderBy(F.desc(F.abs(F.col("range_position") - 0.5)), "currency")).cast("long")
    return m.select("currency", "range_position", place.alias("place"), (F.col("range_position") == F.max("range_position").over(Window.partitionBy())).alias("strongest"))


@query(FX_TICKS, sql="SELECT currency, count(*) AS n FROM fx_ticks WHERE length(currency) = 3 AND currency <> 'EUR' GROUP BY 1")
def fx_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tradewind.sources.adapters import fx_ticks

    codes = F.explode(clean_quotes(F.array(F.lower("currency"), F.lit(" eur"), F.concat(F.lit(" "), "currency")), ("USD",)))
    return fx_ticks(spark, sf_dir).select(codes.alias("currency")).groupBy("currency").agg(F.count("*").alias("n"))


@query(sql="SELECT user_id, event_id, sha256(CAST(event_id AS VARCHAR) || chr(31) || event_type || chr(31) || CAST(user_id AS VARCHAR)) AS row_hash, coalesce(lag(sha256(CAST(event_id AS VARCHAR) || chr(31) || event_type || chr(31) || CAST(user_id AS VARCHAR))) OVER (PARTITION BY user_id ORDER BY event_id), '') AS previous_hash FROM events")
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.chained(table(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_id", "event_type", "user_id"])
    return rows.select("user_id", "event_id", "row_hash", "previous_hash")


@query(sql="""SELECT conv_id, turn, replace(substr('{"password": "' || role || '", "note": "' || CAST(turn AS VARCHAR) || '", "apiToken": 7}', 1, 4000), '"password": "' || role || '", "note": "' || CAST(turn AS VARCHAR) || '", "apiToken": 7', '"password": "[redacted]", "note": "' || CAST(turn AS VARCHAR) || '", "apiToken": "[redacted]"') AS payload FROM conversations""")
def dead_letter_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    payload = F.concat(F.lit('{"password": "'), "role", F.lit('", "note": "'), F.col("turn").cast("string"), F.lit('", "apiToken": 7}'))
    return audit.dead_letters(c.select("conv_id", "turn", F.lit("e").alias("error"), payload.alias("payload"))).select("conv_id", "turn", "payload")


@query(PROCESSED, sql="SELECT raw_article_id, count(*) - 1 AS hits, max_id FROM (SELECT raw_article_id, arg_max(id, (processed_at, id)) OVER (PARTITION BY raw_article_id) AS max_id FROM processed) GROUP BY ALL")
def enrichment_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries: the last write of a key stays, every further use is a hit."""
    return processed(spark, sf_dir).groupBy("raw_article_id").agg((F.count("*") - 1).alias("hits"), F.max_by("id", F.struct("processed_at", "id")).alias("max_id"))


@query(sql="SELECT quality, count(*) AS n, round(avg(CASE WHEN toxic = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END), 6) AS recall FROM labels GROUP BY 1")
def evaluation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean recall of found against expected sets, 1 where nothing is expected."""
    expected = F.when(F.col("toxic") == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    found = F.array(F.lit("a"), F.lit("c"))
    recall = F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(found, expected)) / F.size(expected))
    return table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(recall), 6).alias("recall"))


@query(PROCESSED, sql="SELECT top_level_category, count(*) AS n, rank() OVER (ORDER BY top_level_category) AS place FROM processed WHERE processing_status = 'completed' GROUP BY 1")
def feed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = processed(spark, sf_dir).where("processing_status = 'completed'").groupBy("top_level_category").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.rank().over(Window.orderBy("top_level_category")).cast("long"))


@query(RISK_EVENTS, sql="SELECT risk_type, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, round(avg(confidence), 6) AS mean_confidence, max(published_at) AS latest FROM risk_events WHERE status = 'new' GROUP BY 1")
def open_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk_events(spark, sf_dir).where("status = 'new'").groupBy("risk_type").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.max("published_at").alias("latest"))


@query(PROCESSED, RAW_ARTICLES, sql="SELECT p.id, r.article_url, r.source_name, p.normalized_title FROM processed p JOIN raw_articles r ON r.id = p.raw_article_id WHERE p.processing_status = 'completed'")
def article_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed(spark, sf_dir).where("processing_status = 'completed'").select(F.col("id").alias("pid"), "raw_article_id", "normalized_title")
    return p.join(raw_articles(spark, sf_dir), F.col("raw_article_id") == F.col("id")).select(F.col("pid").alias("id"), "article_url", "source_name", "normalized_title")


@query(sql="""SELECT source_id, run_key, status, CASE WHEN status = 'running' AND lease > TIMESTAMP '2024-01-15 00:00:00' THEN 'already_running' WHEN status = 'completed' THEN 'already_completed' ELSE 'claim' END AS decision FROM (
  SELECT user_id AS source_id, date_trunc('hour', ts) - to_hours(hour(ts) % 6) AS run_key, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'completed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'running' END AS status, max(ts) + INTERVAL 65 MINUTE AS lease FROM events GROUP BY ALL)""")
def run_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a worker may do with each source's six-hour run: a live lease or a finished run is left alone."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.col("user_id").alias("source_id"), F.window("ts", "6 hours")["start"].alias("run_key")).agg(F.count_if(F.col("event_type") == "purchase").alias("done"), F.count_if(F.col("event_type") == "error").alias("failed"), F.max("ts").alias("last"))
    status = F.when(F.col("done") > 0, "completed").when(F.col("failed") > 0, "failed").otherwise("running")
    live = F.col("last") + F.expr("interval 65 minutes") > F.expr("timestamp_ntz'2024-01-15 00:00:00'")
    return runs.withColumn("status", status).select("source_id", "run_key", "status", F.when((F.col("status") == "running") & live, "already_running").when(F.col("status") == "completed", "already_completed").otherwise("claim").alias("decision"))


@query(sql="SELECT DISTINCT u AS user_id, CASE WHEN u % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM (SELECT o_custkey AS u FROM orders EXCEPT SELECT user_id FROM events)")
def preference_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of buyers, less those whose feed the new preferences delete."""
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return buyers.join(table(spark, sf_dir, "events").select("user_id"), "user_id", "left_anti").select("user_id", F.when(F.col("user_id") % 2 == 0, "de").otherwise("en").alias("language"))


@query(sql=r"""SELECT page_id, nullif(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '\s+([.,;:!?])', '\1', 'g'), '') AS text FROM (SELECT page_id,
  replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&amp;', '&') AS t FROM pages)""")
def page_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", plain_text(F.col("html")).alias("text"))


@query(RISK_EVENTS, sql="SELECT id, list_has_any(list_transform(affected_suppliers, lambda x: lower(x)), ['bosch', 'toyota']) AS hit FROM risk_events WHERE status <> 'dismissed'")
def supplier_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.arrays_overlap(F.transform("affected_suppliers", F.lower), F.array(F.lit("bosch"), F.lit("toyota")))
    return risk_events(spark, sf_dir).where("status <> 'dismissed'").select("id", hit.alias("hit"))


