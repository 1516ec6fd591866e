"""Articles from files of news feeds: RSS and Atom in XML, and the JSON of two news services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.text import plain_text
from tradewind.functions.url import canonical

MAX_TITLE, MAX_TEXT = 500, 2000
RSS = "guid string, title string, link string, description string, pubDate string, language string"
ATOM = "id string, title string, link struct<_href: string, _rel: string>, summary string, content string, published string, updated string"
NEWS = "articles array<struct<source: struct<id: string, name: string>, title: string, description: string, content: string, url: string, publishedAt: string, language: string>>"
GDELT = "articles array<struct<title: string, url: string, seendate: string, domain: string, language: string, sourcecountry: string>>"


def absolute(link: Column, base: str) -> Column:
    """A link resolved against the feed's own URL."""
    root = base.split("/", 3)
    host = "/".join(root[:3])
    folder = base.rsplit("/", 1)[0] if len(root) > 3 else base
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.lit(root[0]), link)).when(link.startswith("/"), F.concat(F.lit(host), link)).otherwise(F.concat(F.lit(folder + "/"), link))


def feed_time(raw: Column, now: Column) -> Column:
    """Mail or ISO time as naive UTC, now where there is none or it lies ahead.

    Spark's parser takes no weekday, so it is cut off first.
    """
    bare = F.regexp_replace(F.trim(raw), "^[A-Za-z]{3}, *", "")
    bare = F.regexp_replace(bare, " (GMT|UT|UTC|Z)$", " +0000")
    mail = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))
    iso = F.trim(raw).try_cast("timestamp")
    return F.least(F.coalesce(mail, iso).cast("timestamp_ntz"), now).alias("published_at")


def read_rss(spark: SparkSession, path: str, base: str, now: Column, limit: int = 50, language: str = "en") -> DataFrame:
    """The first `limit` items of an RSS file with a link; position is the order in which the reader meets them."""
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(RSS).load(path)
    link = absolute(F.trim(F.coalesce("link", F.lit(""))), base)
    text = plain_text(F.coalesce(F.nullif("description", F.lit("")), F.lit(None)), MAX_TEXT)
    return _articles(rows.where(F.coalesce("link", F.lit("")) != ""), F.coalesce(F.nullif("guid", F.lit("")), link), link, text, F.col("pubDate"), F.coalesce(F.lower("language"), F.lit(language)), now, limit)


def read_atom(spark: SparkSession, path: str, base: str, now: Column, limit: int = 50, language: str = "en") -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(ATOM).load(path)
    link = absolute(F.coalesce("link._href", F.lit("")), base)
    text = plain_text(F.coalesce(F.nullif("summary", F.lit("")), "content"), MAX_TEXT)
    return _articles(rows.where(F.coalesce("link._href", F.lit("")) != ""), F.coalesce(F.nullif("id", F.lit("")), link), link, text, F.coalesce("published", "updated"), F.lit(language), now, limit)


def _articles(rows: DataFrame, own_id: Column, link: Column, text: Column, raw_time: Column, language: Column, now: Column, limit: int) -> DataFrame:
    title = F.coalesce(plain_text(F.col("title"), MAX_TITLE), F.lit(""))
    a = rows.select(F.lit("rss").alias("provider"), own_id.alias("provider_article_id"), title.alias("title"), text.alias("description"), text.alias("content_snippet"), link.alias("article_url"), canonical(link).alias("canonical_url"), feed_time(F.coalesce(raw_time, F.lit("")), now).alias("published_at"), raw_time.alias("source_published_at_raw"), language.alias("language"), F.monotonically_increasing_id().alias("position"))
    return a.orderBy("position").limit(limit)


def read_news_json(spark: SparkSession, path: str, now: Column) -> DataFrame:
    rows = spark.read.schema(NEWS).option("multiLine", "true").json(path).select(F.explode("articles").alias("a")).select("a.*")
    return rows.where("url is not null and title is not null").select(F.lit("newsapi").alias("provider"), F.col("url").alias("provider_article_id"), "title", "description", F.col("content").alias("content_snippet"), F.col("url").alias("article_url"), F.col("source.name").alias("source_name"), feed_time(F.coalesce("publishedAt", F.lit("")), now).alias("published_at"), F.coalesce("language", F.lit("en")).alias("language"))


def read_gdelt_json(spark: SparkSession, path: str, now: Column) -> DataFrame:
    rows = spark.read.schema(GDELT).option("multiLine", "true").json(path).select(F.explode("articles").alias("a")).select("a.*")
    seen = F.try_to_timestamp(F.regexp_replace("seendate", "[^0-9]", ""), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return rows.where("url is not null").select(F.lit("gdelt").alias("provider"), F.col("url").alias("provider_article_id"), "title", F.col("url").alias("article_url"), F.col("domain").alias("source_name"), F.least(F.coalesce(seen, now), now).alias("published_at"), F.lower("language").alias("language"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """date, currency, rate of a rates file in either shape: a map of dates to maps of rates, or a list of rows."""
    raw = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", "struct<base: string, date: string, rates: map<string, string>>")
    one = raw.select(nested.alias("j")).where("j.rates is not null").select("j.date", F.explode("j.rates"))
    by_day = one.select(F.when(F.col("value").startswith("{"), F.col("key")).otherwise(F.col("date")).alias("date"), F.when(F.col("value").startswith("{"), F.from_json("value", "map<string, double>")).otherwise(F.create_map("key", F.col("value").try_cast("double"))).alias("m")).select("date", F.explode("m").alias("currency", "rate"))
    rows = raw.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", "array<struct<date: string, quote: string, currency: string, rate: double>>")).alias("r")).select("r.date", F.coalesce(F.nullif("r.quote", F.lit("")), "r.currency").alias("currency"), "r.rate")
    return by_day.unionByName(rows).select(F.to_date("date").alias("date"), F.upper("currency").alias("currency"), "rate").where("length(currency) = 3 and rate is not null")


def clean_quotes(values: Column, defaults: tuple[str, ...]) -> Column:
    """Three-letter codes but EUR, upper case, each once in order; the defaults if none is left."""
    codes = F.array_distinct(F.filter(F.transform(values, lambda v: F.upper(F.trim(v))), lambda v: (F.length(v) == 3) & (v != "EUR")))
    return F.when(F.size(codes) > 0, codes).otherwise(F.array(*map(F.lit, defaults)))
