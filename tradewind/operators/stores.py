"""Changes of stored tables, each from the table's rows and a batch of requests to the rows as they are afterwards."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.names import normal_name
from tradewind.functions.text import strip


def transition(rows: DataFrame, outcomes: DataFrame, key: str, now: Column) -> DataFrame:
    """Raw articles after a batch of outcomes (key, owner, status, retry_minutes), at most one a row.

    An outcome counts where its owner is null or holds the row's lease. It sets the status and clears the lease; with
    retry_minutes the next attempt is due then and the attempt is counted, without it none is due.
    """
    o = outcomes.select(key, F.col("owner").alias("_owner"), F.col("status").alias("_status"), F.col("retry_minutes").alias("_retry"), F.lit(True).alias("_some"))
    held = rows.join(o, key, "left")
    done = F.coalesce(F.col("_some") & (F.col("_owner").isNull() | (F.col("_owner") == F.col("enrichment_lease_owner"))), F.lit(False))
    due = F.when(F.col("_retry").isNotNull(), F.timestamp_add("MINUTE", F.col("_retry"), now))
    change = {"enrichment_status": F.col("_status"), "enrichment_next_attempt_at": due, "enrichment_lease_owner": F.lit(None), "enrichment_lease_expires_at": F.lit(None), "enrichment_attempt_count": F.col("enrichment_attempt_count") + F.when(F.col("_retry").isNotNull(), 1).otherwise(0)}
    kept = held.withColumn("_done", done)
    return kept.select(*(F.when(F.col("_done"), change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in rows.columns))


def marked(rows: DataFrame, keys: DataFrame, on: list[str], column: str) -> DataFrame:
    """rows with the flag set where a request names their key; requests may repeat, flags that are set stay."""
    asked = keys.select(*on).distinct().withColumn("_asked", F.lit(True))
    return rows.join(asked, on, "left").withColumn(column, F.coalesce(F.col(column), F.lit(False)) | F.col("_asked").isNotNull()).select(rows.columns)


def updated(rows: DataFrame, log: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """rows with one column as the last of the log's entries for their key says, as it was where there is none."""
    last = log.groupBy(key).agg(F.max_by(column, F.struct(*order)).alias("_last"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_last", column)).select(rows.columns)


def latest_values(log: DataFrame, key: str, name: str, value: str, order: list[str], names: tuple[str, ...]) -> DataFrame:
    """One row a key of an append-only log of named values: the last value of each name."""
    return log.groupBy(key).agg(*(F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(*order))).alias(n) for n in names))


def membership(entries: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Entries after additions, those present being left alone, and then removals."""
    return entries.unionByName(added).distinct().join(removed.distinct(), entries.columns, "left_anti")


def survivors_only(rows: DataFrame, survivor: str = "survivor_id", key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == F.col(survivor))


def repointed(rows: DataFrame, survivors: DataFrame, column: str, key: str = "id", survivor: str = "survivor_id") -> DataFrame:
    """Rows of a dependent table that named a duplicate, pointing at the one that stays."""
    to = survivors.where(F.col(key) != F.col(survivor)).select(F.col(key).alias("_from"), F.col(survivor).alias("_to"))
    return rows.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).select(rows.columns)


def rule_outcomes(requests: DataFrame, existing: DataFrame, severities: tuple[str, ...], ascii_only: bool = False) -> DataFrame:
    """requests (request_id, organization_id, name, min_severity, risk_types) with outcome and the fields a rule is stored with.

    A rule needs a name and a known severity. Of valid requests for one name in an organisation the first is created,
    unless the name is taken; risk types are stored sorted, each once. existing has organization_id, normalized_name.
    """
    r = requests.withColumns({"normalized_name": normal_name(F.col("name"), ascii_only), "name": strip(F.col("name")), "risk_types": F.array_sort(F.array_distinct(F.coalesce("risk_types", F.expr("cast(array() as array<string>)"))))})
    named = F.coalesce(F.col("normalized_name"), F.lit("")) != ""
    fit = named & F.col("min_severity").isin(*severities)
    first = F.row_number().over(Window.partitionBy("organization_id", "normalized_name", fit).orderBy("request_id"))
    taken = existing.select("organization_id", "normalized_name").distinct().withColumn("_taken", F.lit(True))
    r = r.withColumns({"_named": named, "_fit": F.coalesce(fit, F.lit(False)), "_first": first}).join(taken, ["organization_id", "normalized_name"], "left")
    outcome = F.when(~F.col("_named"), "no name").when(~F.col("_fit"), "no severity").when(F.col("_taken").isNotNull() | (F.col("_first") > 1), "duplicate").otherwise("created")
    return r.select("request_id", "organization_id", "name", "normalized_name", "min_severity", "risk_types", outcome.alias("outcome"))


CACHE_KEY = ("content_fingerprint", "policy_version", "taxonomy_version")
CACHED = "summary string, category string, signal_tags array<string>"
METHODS = ("deterministic", "llm")


def cache_put(entries: DataFrame, puts: DataFrame, order: list[str]) -> DataFrame:
    """Cache entries (key, payload, original_method, hit_count) after writes: the last of a key stays, its hits are kept.

    Writes of any other method than the rules' or the model's are refused.
    """
    last = puts.where(F.col("original_method").isin(*METHODS)).groupBy(*CACHE_KEY).agg(F.max_by(F.struct("payload", "original_method"), F.struct(*order)).alias("_new"))
    both = entries.join(last, list(CACHE_KEY), "full_outer")
    return both.select(*CACHE_KEY, *(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in ("payload", "original_method")), F.coalesce("hit_count", F.lit(0).cast("long")).alias("hit_count"))


def cache_get(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests with payload and original_method of the entry of the same fingerprint and versions, null on a miss.

    A payload that isn't a JSON object with a summary and a category is corrupt and counts as a miss.
    """
    read = F.from_json("payload", CACHED)
    sound = entries.where(read["summary"].isNotNull() & read["category"].isNotNull()).select(*CACHE_KEY, "payload", "original_method")
    return requests.join(sound, list(CACHE_KEY), "left")


def count_hits(entries: DataFrame, got: DataFrame) -> DataFrame:
    """Cache entries with the hits of a batch of reads counted."""
    hits = got.where(F.col("payload").isNotNull()).groupBy(*CACHE_KEY).agg(F.count("*").alias("_hits"))
    return entries.join(hits, list(CACHE_KEY), "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_hits", F.lit(0))).select(entries.columns)


def duplicate_level(incoming: DataFrame, stored: DataFrame, hours: int = 48) -> DataFrame:
    """incoming (id, source_name, published_at, url_hash, title_hash, ingest_hash) with the level at which it is a duplicate.

    1: its URL's hash is a stored one's; 2: its title's hash is that of one of the same source published at most
    `hours` before; 3: its ingest hash is; null: none. stored has ingest_hash, source_name, published_at. Levels 1 and 3
    are joins by equality with distinct hashes. For level 2 requests and stored times of a title and source are put in
    one order and each request looks at the latest time before it: a title that a source repeats is met once a request.
    """
    known = stored.where("ingest_hash <> ''")
    by = lambda column, level: incoming.select("id", F.col(column).alias("ingest_hash")).join(known.select("ingest_hash").distinct(), "ingest_hash").select("id", F.lit(level).alias("level"))
    asked = incoming.select("source_name", F.col("title_hash").alias("ingest_hash"), F.col("published_at").alias("at"), F.lit(1).alias("kind"), "id")
    times = known.select("source_name", "ingest_hash", F.col("published_at").alias("at")).distinct().select("*", F.lit(0).alias("kind"), F.lit(None).cast(incoming.schema["id"].dataType).alias("id"))
    before = Window.partitionBy("ingest_hash", "source_name").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    latest = asked.unionByName(times).withColumn("latest", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(before))
    second = latest.where("kind = 1").where(F.col("latest") >= F.col("at") - F.expr(f"interval {hours} hours")).select("id", F.lit(2).alias("level"))
    levels = by("url_hash", 1).unionByName(second).unionByName(by("ingest_hash", 3)).groupBy("id").agg(F.min("level").alias("level"))
    return incoming.join(levels, "id", "left").select("id", "level")


def any_ilike(text: str, columns: list[str]) -> Column:
    """Whether any column holds the text, case aside; % and _ in it keep their meaning, nulls drop out."""
    return reduce(or_, (F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False)) for c in columns))


def search_processed(processed: DataFrame, raw: DataFrame, text: str, since: Column, limit: int) -> DataFrame:
    """The best `limit` of the latest 3 * limit processed articles since then that hold the text in any of five columns.

    Needs processed (id, raw_article_id, normalized_title, summary, processed_at) and raw (id, title, description,
    content_snippet, published_at).
    """
    r = raw.select(F.col("id").alias("raw_article_id"), "title", "description", "content_snippet", "published_at")
    joined = processed.select("id", "raw_article_id", "normalized_title", "summary", "processed_at").where(F.col("processed_at") >= since).join(r, "raw_article_id")
    latest = joined.where(any_ilike(text.strip(), ["normalized_title", "summary", "title", "description", "content_snippet"])).orderBy(F.desc("processed_at"), "id").limit(3 * limit)
    hay = F.lower(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("normalized_title", "summary", "title", "description", "content_snippet"))))
    low = text.strip().lower()
    terms = reduce(lambda a, b: a + b, (F.contains("_hay", F.lit(t)).cast("int") for t in low.split()))
    score = F.when(F.contains("_hay", F.lit(low)), 0.5).otherwise(0.0) + F.least(F.lit(0.3), F.lit(0.1) * terms) + F.when(F.contains(F.lower("title"), F.lit(low)), 0.2).otherwise(0.0)
    found = latest.withColumn("_hay", hay).withColumn("relevance", F.least(score, F.lit(1.0))).where("relevance > 0")
    return found.orderBy(F.desc("relevance"), F.desc("processed_at"), "id").limit(limit).drop("_hay")
