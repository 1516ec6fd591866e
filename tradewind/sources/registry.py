"""The registry of sources as a table: validation, overrides, enabled sources, coverage of procurement domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "source_id string, display_name string, homepage_url string, endpoint_url string, adapter string, source_class string, domains array<string>, countries array<string>, languages array<string>, poll_minutes int, item_limit int, expected_content_types array<string>, allowed_hosts array<string>, trust_seed double, license_note string, enabled boolean"
# Domains in order, those that need an official source, adapters, classes.
DOMAINS = ("sanctions", "regulation", "logistics", "commodities", "fx", "supplier_risk", "europe_business")
AUTHORITY_REQUIRED = ("sanctions", "regulation")
ADAPTERS = ("rss", "structured_sanctions", "newsapi", "gdelt")
CLASSES = ("official", "established_media", "industry")

# The catalogue. id, name, homepage, endpoint, adapter, class, domains, countries, poll minutes, item limit, hosts, trust, enabled.
CATALOG = (
    ("eu_commission_press", "European Commission Press Corner", "https://ec.europa.eu/commission/presscorner/home/en", "https://ec.europa.eu/commission/presscorner/api/rss?language=en", "rss", "official", ("commodities", "europe_business", "logistics", "regulation", "sanctions", "supplier_risk"), "eu", 60, 50, "ec.europa.eu", 0.95, True),
    ("eu_council_press", "Council of the EU Press Releases", "https://www.consilium.europa.eu/en/press/press-releases/", "https://www.consilium.europa.eu/en/press/press-releases/?rss=true", "rss", "official", ("europe_business", "regulation", "sanctions"), "eu", 60, 50, "www.consilium.europa.eu", 0.95, False),
    ("ecb_press", "European Central Bank Press", "https://www.ecb.europa.eu/press/html/index.en.html", "https://www.ecb.europa.eu/rss/press.html", "rss", "official", ("europe_business", "fx", "regulation"), "eu", 60, 50, "www.ecb.europa.eu", 0.95, True),
    ("eu_financial_sanctions", "EU Consolidated Financial Sanctions List", "https://webgate.ec.europa.eu/fsd/fsf/", "https://webgate.ec.europa.eu/fsd/fsf/public/files/xmlFullSanctionsList_1_1/content", "structured_sanctions", "official", ("sanctions", "supplier_risk"), "eu", 1440, 100, "webgate.ec.europa.eu", 1.0, True),
    ("eurostat_updates", "Eurostat Data Updates", "https://ec.europa.eu/eurostat/", "https://ec.europa.eu/eurostat/api/dissemination/catalogue/rss/en/statistics-update.rss", "rss", "official", ("commodities", "europe_business", "logistics", "supplier_risk"), "eu", 720, 50, "ec.europa.eu", 0.9, True),
    ("freightwaves", "FreightWaves", "https://www.freightwaves.com/", "https://www.freightwaves.com/feed", "rss", "industry", ("logistics", "supplier_risk"), "us", 60, 50, "www.freightwaves.com", 0.72, False),
    ("mining_com", "MINING.COM", "https://www.mining.com/", "https://www.mining.com/feed/", "rss", "industry", ("commodities", "supplier_risk"), "ca", 60, 50, "www.mining.com", 0.72, True),
    ("oilprice", "Oilprice.com", "https://oilprice.com/", "https://oilprice.com/rss/main", "rss", "industry", ("commodities", "logistics", "supplier_risk"), "gb", 60, 50, "oilprice.com", 0.68, True),
    ("supply_chain_dive", "Supply Chain Dive", "https://www.supplychaindive.com/", "https://www.supplychaindive.com/feeds/news/", "rss", "industry", ("europe_business", "logistics", "supplier_risk"), "us", 60, 50, "www.supplychaindive.com", 0.72, True),
    ("dw_business", "Deutsche Welle Business", "https://www.dw.com/en/business/s-1431", "https://rss.dw.com/rdf/rss-en-bus", "rss", "established_media", ("commodities", "europe_business", "regulation", "supplier_risk"), "de", 60, 50, "rss.dw.com", 0.82, True),
)


def catalog(spark: SparkSession) -> DataFrame:
    types = ["application/rss+xml", "application/xml", "text/xml"]
    rows = [(i, name, home, end, adapter, kind, list(domains), [country], ["en"], poll, limit, types[1:] if adapter != "rss" else types, [host], trust, "Public feed; keep attribution and links.", on) for i, name, home, end, adapter, kind, domains, country, poll, limit, host, trust, on in CATALOG]
    return spark.createDataFrame(rows, SCHEMA)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))


def violations(sources: DataFrame) -> DataFrame:
    """source_id, violation: the first rule that a definition breaks, and ids used twice."""
    c = F.col
    every = lambda column, pattern: (F.size(column) > 0) & F.forall(column, lambda x: x.rlike(pattern))
    bad_url = lambda u: ~c(u).rlike("^https://[^/@?#]+") | c(u).rlike("^https://[^/]*@")
    first = (
        F.when(~c("source_id").rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$"), "source_id").when(F.trim("display_name") == "", "display_name").when(~c("adapter").isin(*ADAPTERS), "adapter").when(~c("source_class").isin(*CLASSES), "source_class")
        .when((F.size("domains") == 0) | ~F.forall("domains", lambda x: x.isin(*DOMAINS)), "domains").when(~every("languages", "^[a-z]{2,3}$"), "languages").when(~every("countries", "^[a-z]{2}$"), "countries")
        .when(~c("poll_minutes").between(5, 1440), "poll_minutes").when(~c("item_limit").between(1, 100), "item_limit").when(~c("trust_seed").between(0, 1), "trust_seed").when(F.trim("license_note") == "", "license_note")
        .when((F.size("expected_content_types") == 0) | F.exists("expected_content_types", lambda x: F.trim(x) == ""), "expected_content_types")
        .when((F.size("allowed_hosts") == 0) | F.exists("allowed_hosts", lambda x: (F.trim(x) == "") | (x != F.lower(x))), "allowed_hosts")
        .when(bad_url("homepage_url"), "homepage_url").when(bad_url("endpoint_url"), "endpoint_url").when(~F.array_contains("allowed_hosts", _host(c("endpoint_url"))), "endpoint host")
    )
    twice = F.when(F.count("*").over(Window.partitionBy("source_id")) > 1, "duplicate source_id")
    return sources.select("source_id", F.coalesce(first, twice).alias("violation")).where("violation is not null")


def configured(sources: DataFrame, overrides: DataFrame) -> DataFrame:
    """sources with poll_minutes, item_limit and enabled replaced where overrides (source_id and these) give a value."""
    o = overrides.select("source_id", *(F.col(x).alias(f"_{x}") for x in ("poll_minutes", "item_limit", "enabled")))
    joined = sources.join(o, "source_id", "left")
    return joined.withColumns({x: F.coalesce(f"_{x}", x) for x in ("poll_minutes", "item_limit", "enabled")}).select(*sources.columns)


def enabled(sources: DataFrame, source_ids: list[str] | None = None) -> DataFrame:
    chosen = sources.where("enabled")
    return (chosen.where(F.col("source_id").isin(*source_ids)) if source_ids is not None else chosen).orderBy("source_id")


def coverage(sources: DataFrame) -> DataFrame:
    """domain, covered, authoritative, gap: how enabled sources cover each domain, and whether a required official or structured one lacks."""
    spark = sources.sparkSession
    every = spark.createDataFrame([(d, d in AUTHORITY_REQUIRED) for d in DOMAINS], "domain string, required boolean")
    official = F.col("source_class") == "official"
    held = sources.where("enabled").select(F.explode("domains").alias("domain"), official.alias("official"), (official & (F.col("adapter") == "structured_sanctions")).alias("structured"))
    found = held.groupBy("domain").agg(F.max("official").alias("official"), F.max("structured").alias("structured"))
    no = lambda x: ~F.coalesce(x, F.lit(False))
    gap = F.when(F.col("official").isNull(), "missing").when(F.col("required") & no("official"), "no official source").when((F.col("domain") == "sanctions") & no("structured"), "no structured source")
    return every.join(found, "domain", "left").select("domain", F.col("official").isNotNull().alias("covered"), F.coalesce("official", F.lit(False)).alias("authoritative"), F.coalesce(gap, F.lit("")).alias("gap"))
