"""Quality gates, source trust and normalisation of raw articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.language import detected, gate
from tradewind.functions.text import strip
from tradewind.functions.url import domain

def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def quality_columns(as_of: Column) -> dict[str, Column]:
    """failures (reasons that reject) and warnings (reasons that don't), in check order."""
    title, url = strip(F.col("title")), strip(F.col("article_url"))
    description, snippet = F.col("description"), F.col("content_snippet")
    missing_title, no_content = _blank(F.col("title")), _blank(description) & _blank(snippet)
    strong = (F.length(strip(F.coalesce(description, F.lit("")))) >= 20) | (F.length(strip(F.coalesce(snippet, F.lit("")))) >= 30)
    fail = [
        F.when(missing_title, "Missing title").when(F.length(title) < 10, "Title too short").when(F.length(title) > 500, "Title too long"),
        F.when(no_content, "No description or content"),
        F.when(_blank(url), "Missing URL").when(~F.lower(url).rlike("^https?://"), "Invalid URL scheme").when(F.length(url) > 2000, "URL too long"),
        F.when(F.col("published_at").isNull(), "Missing publication date"),
    ]
    spam = F.array_compact(F.array(*(F.when(F.contains(F.lower(title), F.lit(w)), w) for w in D.SPAM_WORDS)))
    warn = [
        F.when(~missing_title & F.length(title).between(10, 500) & (F.size(spam) > 0), "Spam word detected"),
        F.when(~no_content & ~strong, "Content too short or weak"),
        F.when(F.col("published_at") > as_of, "Article from future").when(F.col("published_at") < as_of - F.expr("interval 730 days"), "Article too old"),
    ]
    return {"failures": F.array_compact(F.array(*fail)), "warnings": F.array_compact(F.array(*warn))}


def with_trust(articles: DataFrame) -> DataFrame:
    """domain, blocked, low_priority and trust (0.5 where unknown) of each article's URL."""
    d = F.col("domain")
    trust = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in D.DOMAIN_TRUST.items() for x in p)), d), F.lit(0.5))
    return articles.withColumn("domain", domain(F.col("article_url"))).withColumns({"blocked": d.isin(*D.BLOCKED_DOMAINS), "low_priority": d.isin(*D.LOW_PRIORITY_DOMAINS), "trust": trust})


def clean_text(c: Column) -> Column:
    """Stripped, runs of line ends as one, common character references decoded; null if empty."""
    t = F.regexp_replace(strip(c), "\n+", "\n")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.nullif(t, F.lit(""))


def normalise(articles: DataFrame, as_of: Column) -> DataFrame:
    """Articles with cleaned text and the language found in their title, and a reject_reason where the source is blocked,

    a gate fails or the language gate does, in this order; nothing is dropped."""
    judged = with_trust(articles).withColumns(quality_columns(as_of))
    judged = judged.withColumns({c: clean_text(F.col(c)) for c in ("title", "description", "content_snippet")})
    has_content = F.col("description").isNotNull() | F.col("content_snippet").isNotNull()
    reason = F.when(F.col("blocked"), "Blocked source").when(F.size("failures") > 0, F.element_at("failures", 1)).when(F.col("title").isNull(), "Missing title").otherwise(gate(F.col("language"), F.col("title"), has_content))
    return judged.withColumn("reject_reason", reason).withColumn("language", F.coalesce(F.when(has_content, detected(F.col("title"))), "language"))
