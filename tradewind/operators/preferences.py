"""Articles matched to preferences in full: suppliers by identity, name or text, categories, regions, signals, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.signals import canonical_category, expanded, regions
from tradewind.functions.text import normal, strip
from tradewind.operators.matching import names_in_texts
from tradewind.operators.personal import LEAST_SCORE, category_tokens, graded, latest, overall, region_tokens, tagged, tokens
from tradewind.operators.supply import re_resolved_lists
from tradewind.session import written

WISHES = ("categories", "suppliers", "supplier_ids", "regions", "signals")


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


#: What an article has and what a profile excludes of it.
_EXCLUSIONS = (("supplier_ids", "excluded_supplier_ids"), ("suppliers", "excluded_suppliers"), ("categories", "excluded_categories"), ("regions", "excluded_regions"), ("all_terms", "excluded_signals"))


def as_profiles(users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, profile) and one row a profile with its wanted_ and excluded_ tokens and signal terms.

    users has user_id and ten lists, wanted_ and excluded_ of WISHES; null lists are empty. Users whose lists hold the
    same form one profile.
    """
    names = [f"{side}_{kind}" for side in ("wanted", "excluded") for kind in WISHES]
    lists = users.select("user_id", *(F.sort_array(F.array_distinct(F.coalesce(c, _none()))).alias(c) for c in names))
    placed = lists.withColumn("profile", F.sha2(F.to_json(F.struct(*names)), 256))
    made = {"categories": category_tokens, "suppliers": tokens, "supplier_ids": tokens, "regions": region_tokens, "signals": lambda c: F.when(F.size(c) > 0, expanded(c)).otherwise(_none())}
    once = placed.groupBy("profile").agg(*(F.any_value(c).alias(c) for c in names))
    return placed.select("user_id", "profile"), once.select("profile", *(made[c.split("_", 1)[1]](F.col(c)).alias(c) for c in names))


def as_offers(articles: DataFrame, profiles: DataFrame) -> DataFrame:
    """id, processed_at and what an article has to be matched by, as token lists.

    articles has id, processed_at, title, summary, category, categories, suppliers, supplier_ids, regions, priority_signal
    and signal_tags. The profiles' supplier names and signal terms are looked up in the articles' short texts by joined
    stretches of words, so each article lists those it holds, however many profiles there are.
    """
    said = F.array_join(F.filter(F.transform(F.array(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))), lambda t: F.lower(strip(t))), lambda t: t != ""), " ")
    a = articles.withColumn("text", said)
    a = a.select(
        "id", "processed_at", "text", canonical_category(F.coalesce("category", F.lit(""))).alias("category"), category_tokens(F.array_compact(F.concat(F.array("category"), F.coalesce("categories", _none())))).alias("categories"),
        tokens(F.array_compact("suppliers")).alias("suppliers"), tokens(F.array_compact("supplier_ids")).alias("supplier_ids"), F.array_union(region_tokens(F.array_compact("regions")), region_tokens(regions(F.col("text")))).alias("regions"),
        expanded(F.concat(F.array("priority_signal"), F.coalesce("signal_tags", _none()))).alias("terms"), F.when(F.coalesce("priority_signal", F.lit("")) != "", expanded(F.array("priority_signal"))).otherwise(_none()).alias("priority_terms"),
    )
    a = written(a, "offers")
    listed = lambda column: profiles.select(F.explode(column).alias("name")).distinct().select(F.col("name").alias("name_id"), "name")
    named = names_in_texts(a.select("id", "text"), listed(F.col("wanted_suppliers"))).groupBy("id").agg(F.collect_set("name_id").alias("text_suppliers"))
    context = normal(F.concat_ws(" ", "text", F.array_join("regions", " ")))
    termed = names_in_texts(a.select("id", context.alias("text")), listed(F.concat("wanted_signals", "excluded_signals"))).groupBy("id").agg(F.collect_set("name_id").alias("text_terms"))
    both = a.drop("text").join(named, "id", "left").join(termed, "id", "left").withColumns({c: F.coalesce(c, _none()) for c in ("text_suppliers", "text_terms")})
    return both.withColumn("all_terms", F.array_union(F.array_union("terms", F.when(F.size("regions") > 0, expanded(F.col("regions"))).otherwise(_none())), "text_terms"))


def scores() -> dict[str, Column]:
    """The four scores of an article that no exclusion meets, and the weighted whole to nine places, so equals are equal."""
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    names = F.array_union("suppliers", F.array_intersect("text_suppliers", "wanted_suppliers"))  # the text holds other profiles' too
    category = F.when(F.size("wanted_categories") == 0, 0.5).when(F.array_contains("wanted_categories", F.col("category")), 1.0).otherwise(0.3)
    supplier = F.when((F.size(names) == 0) | (F.size("wanted_suppliers") == 0), 0.5).otherwise(graded(shared(names, "wanted_suppliers") + shared("supplier_ids", "wanted_supplier_ids")))
    region = F.when((F.size("regions") == 0) | (F.size("wanted_regions") == 0), 0.5).otherwise(graded(shared("regions", "wanted_regions")))
    counted = shared("terms", "wanted_signals") + F.when(F.arrays_overlap("text_terms", "wanted_signals"), 1).otherwise(0)
    signal = F.when(F.size("wanted_signals") == 0, 0.5).when(F.arrays_overlap("priority_terms", "wanted_signals"), 1.0).otherwise(graded(counted))
    parts = {"category_match": category, "supplier_match": supplier, "region_match": region, "signal_match": signal}
    return parts | {"rank_score": F.round(overall(*(F.col(c) for c in parts)), 9)}


def _pairs(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, id) of articles that a profile with interests may include, by equality on one tag.

    Category and supplier interests come first, then regions, then signals. An article that resolved to suppliers offers
    their ids alone, else its suppliers' names and those that its text holds.
    """
    supplier = F.when(F.size("supplier_ids") > 0, tagged("supplier_ids", "id")).otherwise(tagged(F.array_union("suppliers", "text_suppliers"), "name"))
    offer = offers.select("id", F.explode(F.concat(tagged("categories", "category"), supplier, tagged("regions", "region"), tagged("all_terms", "signal"))).alias("x")).select("id", "x.*")
    focus = F.concat(tagged("wanted_categories", "category"), tagged("wanted_suppliers", "name"), tagged("wanted_supplier_ids", "id"))
    focused = (F.size("wanted_categories") > 0) | (F.size("wanted_suppliers") > 0)
    wish = F.when(focused, focus).when(F.size("wanted_regions") > 0, tagged("wanted_regions", "region")).otherwise(tagged("wanted_signals", "signal"))
    want = profiles.select("profile", F.explode(wish).alias("x")).select("profile", "x.*")
    return offer.join(want, ["kind", "value"]).select("profile", "id").distinct()


def _open() -> Column:
    """Whether a profile has no interest that an article would have to meet."""
    return (F.size("wanted_categories") == 0) & (F.size("wanted_suppliers") == 0) & (F.size("wanted_regions") == 0) & (F.size("wanted_signals") == 0)


def _key(*lists: str) -> Column:
    """The same for rows whose lists hold the same in whatever order."""
    return F.sha2(F.to_json(F.struct(*(F.sort_array(c).alias(c) for c in lists))), 256)


_HAD = ("categories", "suppliers", "supplier_ids", "regions", "terms", "priority_terms", "text_suppliers", "text_terms", "all_terms")
_WANTED = tuple(f"wanted_{kind}" for kind in WISHES)
_MATCHES = ("category_match", "supplier_match", "region_match", "signal_match", "rank_score")
_BEST = ((F.desc, "rank_score"), (F.desc, "processed_at"), (F.asc, "id"))


def _tasks(df: DataFrame) -> int:
    """A count of tasks that adaptive execution leaves as it is: rows are few bytes beside the work on them."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _first(rows: DataFrame, by: Sequence[str], name: str, limit: int) -> DataFrame:
    """The best rows of each group, as many as the limit, with their place among them."""
    order = [way(c) for way, c in _BEST if c in rows.columns]
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= limit)


def _merged(heads: DataFrame, members: DataFrame, by: Sequence[str], group: Sequence[str], place: str, limit: int) -> DataFrame:
    """The best rows of each of by, out of lists (group) that are each in order, with a place in their list.

    heads has by, group and each list's first row. Ahead of the r-th row of the p-th list, by their first rows, are the
    first rows of p - 1 lists and r - 1 rows of its own, so only those with p + r <= limit + 1 can be among the best.
    """
    lists = _first(heads, by, "_list", limit).select(*dict.fromkeys([*by, *group]), "_list", *(c for c in _MATCHES if c not in members.columns))
    met = lists.join(members, list(group)).where(F.col("_list") + F.col(place) <= limit + 1).drop("_list", place)
    return _first(met, by, "rank", limit)


def _wished(offers: DataFrame, profiles: DataFrame, limit: int) -> DataFrame:
    """profile, id, rank and the matches: the best articles of every profile with interests.

    Articles that have the same to be matched by are of one kind, and profiles that want the same have one wish; what is
    scored is a wish and a kind. barred is what a kind has of all that anybody excludes, so a profile leaves out either
    all or none of its wish's articles of one barred set: these have a list a wish, and a profile merges those of its wish.
    """
    tags = lambda of: F.explode(F.concat(*(tagged(names[of], names[0]) for names in _EXCLUSIONS))).alias("tag")
    placed = offers.withColumn("kind", F.concat(_key(*_HAD), "category"))
    kinds = placed.groupBy("kind").agg(*(F.any_value(c).alias(c) for c in (*_HAD, "category")))
    named = profiles.select(tags(1)).distinct()
    barred = kinds.select("kind", tags(0)).join(named, "tag").groupBy("kind").agg(F.collect_set("tag").alias("tags"))
    kinds = kinds.join(barred, "kind", "left").withColumn("barred", F.coalesce(F.sha2(F.to_json(F.sort_array("tags")), 256), F.lit("")))
    kinds = written(kinds, "kinds")
    articles = written(_first(placed.select("kind", "id", "processed_at"), ["kind"], "place", limit), "articles-of-kinds")

    known = profiles.select("profile", *_WANTED, _key(*_WANTED).alias("wish"), _key(*(c for _, c in _EXCLUSIONS)).alias("exclusion"), *(c for _, c in _EXCLUSIONS))
    wishes = known.groupBy("wish").agg(*(F.any_value(c).alias(c) for c in _WANTED))
    pairs = _pairs(kinds.withColumnRenamed("kind", "id"), wishes.withColumnRenamed("wish", "profile")).toDF("wish", "kind")
    scored = pairs.repartition(_tasks(offers), "wish", "kind").join(kinds, "kind").join(wishes, "wish")
    for name, column in scores().items():
        scored = scored.withColumn(name, column)
    scored = scored.where(F.col("rank_score") >= LEAST_SCORE).select("wish", "barred", "kind", *_MATCHES)
    heads = scored.join(articles.where("place = 1").drop("place"), "kind")
    lists = written(_merged(heads, articles, ["wish", "barred"], ["kind"], "place", limit).drop("kind"), "lists-of-wishes")

    exclusions = known.groupBy("exclusion").agg(*(F.any_value(c).alias(c) for _, c in _EXCLUSIONS))
    hit = kinds.select("barred", F.explode("tags").alias("tag")).distinct().join(exclusions.select("exclusion", tags(1)), "tag").select("exclusion", "barred").distinct()
    open_to = known.select("profile", "wish", "exclusion").join(lists.where("rank = 1").drop("rank"), "wish").join(hit, ["exclusion", "barred"], "left_anti")
    return _merged(open_to, lists.withColumnRenamed("rank", "place"), ["profile"], ["wish", "barred"], "place", limit).select("profile", "id", "rank", *_MATCHES)


def feeds(articles: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """user_id, id, rank, the four matches and rank_score: the best articles of every user.

    Users with equal preferences share a profile, whose list is made once: of profiles with interests by kinds of articles
    and wishes (see _wished), of the others from the latest articles. An article must meet a profile's interests, hit none
    of its exclusions and score LEAST_SCORE; ties go to the later article, then the lesser id. Null lists are empty;
    repeated users each get the feed; without articles or users the result is empty.
    """
    placed, profiles = as_profiles(users)
    profiles = written(profiles, "profiles")
    offers = written(as_offers(articles, profiles), "offered")
    idle = profiles.where(_open())
    served = latest(offers, idle.withColumn("lacks", F.lit(limit)), _EXCLUSIONS).join(offers, "id").join(idle, "profile")
    for name, column in scores().items():
        served = served.withColumn(name, column)
    served = _first(served.where(F.col("rank_score") >= LEAST_SCORE), ["profile"], "rank", limit).select("profile", "id", "rank", *_MATCHES)
    best = written(_wished(offers, profiles.where(~_open()), limit).unionByName(served), "lists-of-profiles")
    return placed.join(best, "profile").select("user_id", "id", "rank", *_MATCHES)


# ---- saving ----

WANTED_LISTS = ("preferred_categories", "preferred_suppliers", "preferred_regions", "preferred_signals")
OTHER_EXCLUSIONS = ("excluded_suppliers", "excluded_regions", "excluded_signals")


def _canonical_list(values: Column) -> Column:
    return F.when(values.isNotNull(), F.array_distinct(F.filter(F.transform(F.array_compact(values), canonical_category), lambda v: v != "")))


def saved(stored: DataFrame, requests: DataFrame, aliases: DataFrame, suppliers: DataFrame, ascii_only: bool = False) -> DataFrame:
    """The preferences of every user after requests (user_id, place, the lists, excluded_topics, platform_language).

    stored has user_id, the lists, excluded_topics and platform_language. Requests of a user are applied by place: a list
    that is null stays as it is, an excluded category list stands for topics too and the other way round, and the
    language is the last request's, en if blank. A user without preferences gets the first request's, categories and
    topics standing in for each other where one is empty. Categories are canonical, each once. The ids of preferred
    and excluded suppliers are resolved anew for those who asked; other users' rows stay, their ids null if they had none.
    """
    plain = (*WANTED_LISTS, *OTHER_EXCLUSIONS)
    every = (*plain, "excluded_categories", "excluded_topics")
    r = requests.withColumns({c: _canonical_list(F.col(c)) for c in ("preferred_categories", "excluded_categories", "excluded_topics")})
    r = r.withColumn("_language", F.coalesce(F.nullif(F.lower(F.trim("platform_language")), F.lit("")), F.lit("en")))
    r = r.join(stored.select("user_id").withColumn("_known", F.lit(True)), "user_id", "left")
    first = F.col("_known").isNull() & (F.row_number().over(Window.partitionBy("user_id").orderBy("place")) == 1)
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    made = {
        "excluded_categories": F.when(F.col("_first"), F.coalesce(full("excluded_categories"), full("excluded_topics"), _none())).otherwise(F.coalesce("excluded_categories", "excluded_topics")),
        "excluded_topics": F.when(F.col("_first"), F.coalesce(full("excluded_topics"), full("excluded_categories"), _none())).otherwise(F.coalesce("excluded_categories", "excluded_topics")),
    }
    r = r.withColumn("_first", first).withColumns(made | {c: F.when(F.col("_first"), F.coalesce(c, _none())).otherwise(F.col(c)) for c in plain})
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("place", F.col(c).alias("v"))))["v"]
    asked = r.groupBy("user_id").agg(*(last(c).alias(f"_{c}") for c in every), last("_language").alias("_new_language"))
    both = stored.join(asked, "user_id", "full_outer").select("user_id", F.col("_new_language").isNotNull().alias("_asked"), *(F.coalesce(f"_{c}", c).alias(c) for c in every), F.coalesce("_new_language", "platform_language").alias("platform_language"))
    for names, ids in (("preferred_suppliers", "preferred_supplier_ids"), ("excluded_suppliers", "excluded_supplier_ids")):
        both = re_resolved_lists(both.withColumn(ids, F.lit(None).cast("array<string>")), "user_id", names, ids, aliases, suppliers, ascii_only).drop("changed").withColumn(ids, F.when(F.col("_asked"), F.col(ids)))
    return both.drop("_asked")


def feeds_left(feed: DataFrame, requests: DataFrame) -> DataFrame:
    """Feed rows less those of users who saved preferences: their feeds are made anew."""
    return feed.join(requests.select("user_id").distinct(), "user_id", "left_anti")
