"""Supplier identity: registry with aliases, resolution of names, mentions, coverage, screening, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.names import alias_forms, normal_name
from tradewind.session import written


def register(suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """supplier_id, alias, source: the aliases each supplier may claim; a spelling that several derive goes to the least id.

    A supplier's own normal name comes before any other's derived one.
    """
    forms = suppliers.select(F.col("id").alias("supplier_id"), F.posexplode(alias_forms(F.col("canonical_name"), ascii_only)).alias("place", "alias"))
    first = F.row_number().over(Window.partitionBy("alias").orderBy(F.least("place", F.lit(1)), "supplier_id"))
    return forms.withColumn("_first", first).where("_first = 1").select("supplier_id", "alias", F.when(F.col("place") == 0, "canonical").otherwise("derived").alias("source"))


def conflicts(suppliers: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """supplier_id, alias, holder_id of names that another supplier already holds."""
    forms = suppliers.select(F.col("id").alias("supplier_id"), F.explode(alias_forms(F.col("canonical_name"), ascii_only)).alias("alias"))
    return forms.join(aliases.select("alias", F.col("supplier_id").alias("holder_id")), "alias").where("holder_id <> supplier_id")


def keyed(rows: DataFrame, name: str, out: str, ascii_only: bool = False) -> DataFrame:
    """rows with the normal form of a name; only the distinct names beyond ASCII go through Python, and are joined back."""
    plain = normal_name(F.col(name), ascii_only=True)
    if ascii_only:
        return rows.withColumn(out, plain)
    beyond = rows.where(~F.col(name).rlike(r"^[\x00-\x7F]*$")).select(F.col(name).alias("_name")).distinct().select("_name", normal_name(F.col("_name")).alias("_normal"))
    return rows.join(beyond, F.col(name) == F.col("_name"), "left").withColumn(out, F.coalesce("_normal", plain)).drop("_name", "_normal")


def resolve(names: DataFrame, aliases: DataFrame, suppliers: DataFrame, name: str = "surface_form", ascii_only: bool = False) -> DataFrame:
    """names with supplier_id, public_id and confidence 1, or nulls and 0 where no active supplier answers to the name."""
    active = aliases.join(suppliers.where("is_active").select(F.col("id").alias("supplier_id"), "public_id"), "supplier_id").select("alias", "supplier_id", "public_id")
    out = keyed(names, name, "_key", ascii_only).join(active, F.col("_key") == F.col("alias"), "left").drop("_key", "alias")
    return out.withColumn("confidence", F.when(F.col("supplier_id").isNotNull(), 1.0).otherwise(0.0))


def record_mentions(articles: DataFrame, recorded: DataFrame, aliases: DataFrame, suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """New mentions (processed_article_id, surface_form, supplier_id, confidence): distinct forms by normal name, none already recorded."""
    forms = articles.select(F.col("id").alias("processed_article_id"), F.posexplode("detected_suppliers").alias("place", "surface_form"))
    forms = keyed(forms, "surface_form", "_key", ascii_only).where("_key <> ''")
    first = F.row_number().over(Window.partitionBy("processed_article_id", "_key").orderBy("place"))
    fresh = forms.withColumn("_first", first).where("_first = 1").select("processed_article_id", "surface_form").join(recorded.select("processed_article_id", "surface_form"), ["processed_article_id", "surface_form"], "left_anti")
    return resolve(fresh, aliases, suppliers, ascii_only=ascii_only).select("processed_article_id", "surface_form", "supplier_id", "confidence")


def coverage(mentions: DataFrame) -> DataFrame:
    resolved = F.count("supplier_id")
    return mentions.agg(resolved.alias("resolved"), (F.count("*") - resolved).alias("unresolved"), F.round(F.coalesce(F.try_divide(resolved, F.count("*")), F.lit(0.0)), 6).alias("coverage"))


def merge(rows: DataFrame, merged: DataFrame, column: str = "supplier_id") -> DataFrame:
    """rows with suppliers repointed by the map merged (drop_id, keep_id)."""
    return rows.join(merged, rows[column] == merged.drop_id, "left").withColumn(column, F.coalesce("keep_id", column)).drop("drop_id", "keep_id")


def final_keepers(merges: DataFrame, most: int = 20) -> DataFrame:
    """drop_id, keep_id of merges with chains followed to their ends; a merge into itself is left out.

    Each round doubles the length of the chains followed and is written out, so a round's plan is one join whatever
    came before; a map of merges is small beside what it is applied to.
    """
    now = written(merges.where("drop_id <> keep_id").select("drop_id", "keep_id"), "merges")
    for _ in range(most):
        following = now.select(F.col("drop_id").alias("_at"), F.col("keep_id").alias("_next"))
        if now.join(following, F.col("keep_id") == F.col("_at"), "left_semi").isEmpty():
            return now
        now = written(now.join(following, F.col("keep_id") == F.col("_at"), "left").select("drop_id", F.coalesce("_next", "keep_id").alias("keep_id")), "merges")
    raise ValueError("merges form a circle")


def merge_suppliers(suppliers: DataFrame, aliases: DataFrame, mentions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suppliers, aliases, mentions) after merges (drop_id, keep_id): what named the loser names the keeper, the loser is inactive.

    Merges of which either side is no supplier are left out.
    """
    known = suppliers.select("id").distinct()
    sound = merges.join(known.withColumnRenamed("id", "drop_id"), "drop_id", "left_semi").join(known.withColumnRenamed("id", "keep_id"), "keep_id", "left_semi")
    final = final_keepers(sound)
    lost = final.select(F.col("drop_id").alias("id"), F.lit(True).alias("_lost"))
    left = suppliers.join(lost, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_lost").isNull()).select(suppliers.columns)
    return left, merge(aliases, final), merge(mentions, final)


def claims_of_aliases(requests: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """requests (request_id, supplier_id, name) with outcome: empty, own (already held), conflict (another's), or added.

    Of several suppliers that ask for one free alias in a batch, the first request gets it; later ones are own or conflict.
    """
    r = keyed(requests, "name", "alias", ascii_only).join(aliases.select("alias", F.col("supplier_id").alias("_held")), "alias", "left")
    w = Window.partitionBy("alias").orderBy("request_id")
    holder = F.coalesce("_held", F.first("supplier_id").over(w))
    new = F.col("_held").isNull() & (F.row_number().over(w) == 1)
    outcome = F.when(F.coalesce("alias", F.lit("")) == "", "empty").when(new, "added").when(holder == F.col("supplier_id"), "own").otherwise("conflict")
    return r.select("request_id", "supplier_id", "alias", outcome.alias("outcome"))


def seeded(names: DataFrame, aliases: DataFrame, ascii_only: bool = False) -> DataFrame:
    """name, created: which names of a starting catalogue become suppliers; one whose spellings anyone holds is skipped.

    names has name and place, its order; of two names that share a spelling the first is created.
    """
    forms = names.select("name", "place", F.explode(alias_forms(F.col("name"), ascii_only)).alias("alias"))
    first = F.min("place").over(Window.partitionBy("alias"))
    held = forms.withColumn("_first", first).join(aliases.select("alias").distinct().withColumn("_held", F.lit(True)), "alias", "left")
    blocked = F.bool_or(F.col("_held").isNotNull() | (F.col("_first") < F.col("place")))
    return held.groupBy("name").agg((~blocked).alias("created"))


def re_resolved(mentions: DataFrame, aliases: DataFrame, suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Unresolved mentions resolved anew, those resolved left alone; changed tells which rows the backfill updates."""
    found = resolve(mentions.drop("confidence").withColumnRenamed("supplier_id", "_old"), aliases, suppliers, ascii_only=ascii_only)
    now = F.coalesce("_old", "supplier_id")
    return found.select("processed_article_id", "surface_form", now.alias("supplier_id"), F.when(now.isNotNull(), 1.0).otherwise(0.0).alias("confidence"), (~now.eqNullSafe(F.col("_old"))).alias("changed"))


def screen(designations: DataFrame, aliases: DataFrame, suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """designation_id, hits (array of supplier_id, public_id, matched_name) and unmatched names, both in name order.

    A supplier is reported once, by the first of its spellings. Needs id and names (array, primary first).
    """
    names = designations.select(F.col("id").alias("designation_id"), F.posexplode("names").alias("place", "surface_form")).where(F.trim("surface_form") != "")
    found = resolve(names, aliases, suppliers, ascii_only=ascii_only)
    rank = F.row_number().over(Window.partitionBy("designation_id", "supplier_id").orderBy("place"))
    kept = found.withColumn("_rank", rank).where("supplier_id is null or _rank = 1")
    listed = lambda condition, value: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(condition, F.struct("place", value))))), lambda x: x["v"])
    hit = F.struct("supplier_id", "public_id", F.col("surface_form").alias("matched_name")).alias("v")
    return kept.groupBy("designation_id").agg(listed(F.col("supplier_id").isNotNull(), hit).alias("hits"), listed(F.col("supplier_id").isNull(), F.col("surface_form").alias("v")).alias("unmatched"))


def supplier_ids_of(mentions: DataFrame, suppliers: DataFrame) -> DataFrame:
    """processed_article_id, supplier_ids: sorted distinct public ids of active suppliers that an article names."""
    active = suppliers.where("is_active").select(F.col("id").alias("supplier_id"), "public_id")
    return mentions.join(active, "supplier_id").groupBy("processed_article_id").agg(F.array_sort(F.collect_set("public_id")).alias("supplier_ids"))


def re_resolved_lists(rows: DataFrame, key: str, names: str, ids: str, aliases: DataFrame, suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """rows with the list `ids` made anew: the sorted distinct public ids of the suppliers that answer to `names`.

    changed tells the rows whose list is another than before, null and empty alike: those that a backfill writes. Each
    row's names are looked up and come back by its key, so what meets is one row's list; keys are distinct. Null lists
    are empty; names beyond a row's own, orders and repeats make no difference.
    """
    asked = rows.select(key, F.explode(F.array_distinct(names)).alias("surface_form"))
    found = resolve(asked, aliases, suppliers, ascii_only=ascii_only).where("public_id is not null").groupBy(key).agg(F.sort_array(F.collect_set("public_id")).alias("_found"))
    none = F.expr("cast(array() as array<string>)")
    now = F.coalesce("_found", none)
    joined = rows.join(found, key, "left")
    return joined.withColumn("changed", now != F.coalesce(ids, none)).withColumn(ids, now).drop("_found")
