"""Article identity: fingerprints, winners within a run, insert-if-absent, survivors of duplicate rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind import dictionaries as D
from tradewind.functions.payload import payload_key
from tradewind.functions.text import strip
from tradewind.functions.url import canonical, iso_time


def stable_id() -> Column:
    return F.col("provider").isin(*D.STABLE_ID_PROVIDERS) & (F.coalesce("provider_article_id", F.lit("")) != "")


def folded(c: Column) -> Column:
    """Lower case, with the letters that case folding alone changes: sharp s, long s and final sigma."""
    return F.replace(F.translate(F.lower(c), "\u017f\u03c2", "s\u03c3"), F.lit("\u00df"), F.lit("ss"))


def article_fingerprint(canonical_url: str | None = None) -> Column:
    """Hash of the provider's own id where that is authoritative, else of the canonical URL, else of the content.

    canonical_url names a column that holds a feed's own canonical URL; it comes before the article's.
    """
    own_url = F.col("article_url") if canonical_url is None else F.coalesce(F.nullif(canonical_url, F.lit("")), "article_url")
    url = canonical(own_url)
    own = F.concat_ws("\0", F.lit("provider"), "provider", "provider_article_id")
    content = F.concat_ws("\0", F.lit("content"), strip(folded(F.col("title"))), strip(folded(F.coalesce("description", F.lit("")))), iso_time(F.col("published_at")))
    return F.sha2(F.when(stable_id(), own).when(F.coalesce(F.col("article_url"), F.lit("")) != "", F.concat(F.lit("url\0"), url)).otherwise(content), 256)


def ingest_hash() -> Column:
    return F.sha2(F.when(stable_id(), F.concat(F.lit("provider|"), "provider", F.lit("|"), "provider_article_id")).otherwise(F.concat("title", F.lit("|"), "source_name", F.lit("|"), iso_time(F.col("published_at")))), 256)


def total_order(columns: list[str]) -> list[Column]:
    """A null sorts before every value, the empty one too."""
    return [x for c in columns for x in (F.col(c).isNotNull().asc(), F.col(c).asc())]


def winners(articles: DataFrame, columns: list[str], canonical_url: str | None = None, payload: str | None = None) -> DataFrame:
    """One article a fingerprint: the highest authority, then the least in the total order of the columns and the payload.

    canonical_url names a column with a feed's own canonical URL, which the fingerprint takes before the article's;
    payload one of nested JSON, which decides between articles that agree in all columns, keys in any order. Only the
    payloads of such articles are put in order text.
    """
    authority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in D.AUTHORITY.items() for x in p)), F.col("source_class")), F.lit(0))
    held = articles.withColumn("fingerprint", article_fingerprint(canonical_url))
    rank = F.rank().over(Window.partitionBy("fingerprint").orderBy(authority.desc(), *total_order(columns)))
    if payload is None:
        rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy(authority.desc(), *total_order(columns)))
        return held.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    best = held.withColumn("_rank", rank).where("_rank = 1").drop("_rank").withColumn("_ties", F.count("*").over(Window.partitionBy("fingerprint")))
    tied = best.where("_ties > 1").drop("_ties").withColumn("_key", payload_key(payload))
    first = F.row_number().over(Window.partitionBy("fingerprint").orderBy(*total_order(["_key"])))
    return best.where("_ties = 1").drop("_ties").unionByName(tied.withColumn("_first", first).where("_first = 1").drop("_first", "_key"))


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of the batch to append: one a key, the first in order, none whose key the target has."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return batch.withColumn("_first", first).where("_first = 1").drop("_first").join(target.select(key), key, "left_anti")


def survivors(rows: DataFrame, group: str, order: list[Column], key: str = "id") -> DataFrame:
    """rows with survivor_id, the key of the row of each group that stays."""
    return rows.withColumn("survivor_id", F.first_value(key).over(Window.partitionBy(group).orderBy(*order)))
