"""Names resolved against a table of companies: by equality, else by edit distance over shared parts of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.text import strip

#: Of the longer name's characters, at most one in so many may be edited: a ratio of 0.75.
ONE_IN = 4


def _most(a: Column, b: Column) -> Column:
    """Edits that names of so many characters may differ by."""
    return F.floor(F.greatest(a, b) / ONE_IN).cast("int")


def _shortest(size: Column) -> Column:
    """Characters of the shortest name within the ratio of one of so many."""
    return (size - F.floor(size / ONE_IN)).cast("int")


def _longest(size: Column) -> Column:
    """Characters of the longest name within the ratio of one of so many."""
    return F.floor(size * ONE_IN / (ONE_IN - 1)).cast("int")


def _edge(size: Column, most: Column, part: Column) -> Column:
    """Where a part begins, from 0, if a name of so many characters is cut into one more than the edits it may have."""
    return F.floor(part * size / (most + 1)).cast("int")


def _piece(name: str, begin: Column, end: Column) -> Column:
    return F.substring(F.col(name), begin + 1, end - begin)


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, most: pairs of names that share a part at a fit place, with the edits that they may have; pairs may repeat.

    A name b is cut into one more part than the edits it may have with a. Then some part k is free of edits with exactly
    k of them before it and so at most `most - k` behind: the part stands in a, shifted by no more than either. Keys
    hold the length of b, the edits and the part's number, so what meets is alike in length, place and three or four
    characters.
    """
    size = F.length("b")
    b = right.select(F.col("name").alias("b")).where(_most(_longest(size), size) >= 1).select("b", size.alias("size"))
    b = b.select("b", "size", F.explode(F.sequence(F.greatest(_most(F.col("size"), F.col("size")), F.lit(1)), _most(_longest(F.col("size")), F.col("size")))).alias("most"))
    b = b.select("b", "size", "most", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("part"))
    size, most, part = F.col("size"), F.col("most"), F.col("part")
    theirs = b.select("b", "size", "most", "part", _piece("b", _edge(size, most, part), _edge(size, most, part + 1)).alias("piece"))

    a = left.select(F.col("name").alias("a"), F.length("name").alias("own"))
    a = a.select("a", "own", F.explode(F.sequence(_shortest(F.col("own")), _longest(F.col("own")))).alias("size")).withColumn("most", _most(F.col("own"), size)).where("most >= 1 and size > 0")
    a = a.select("*", F.explode(F.sequence(F.lit(0), most)).alias("part"))
    more, behind = F.col("own") - size, most - part
    a = a.withColumns({"low": F.greatest(-part, more - behind), "high": F.least(part, more + behind), "begin": _edge(size, most, part), "end": _edge(size, most, part + 1)})
    a = a.withColumns({"low": F.greatest("low", -F.col("begin")), "high": F.least("high", F.col("own") - F.col("end"))}).where("low <= high")
    a = a.select("*", F.explode(F.sequence("low", "high")).alias("shift"))
    mine = a.select("a", "size", "most", "part", _piece("a", F.col("begin") + F.col("shift"), F.col("end") + F.col("shift")).alias("piece")).distinct()
    return mine.join(theirs, ["size", "most", "part", "piece"]).select("a", "b", "most")


def near_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, edits for distinct names of left and right (name) that differ, within one edit in ONE_IN characters of the longer.

    Names are compared as they are. What meets by a shared part is verified where it meets by its edit distance, which
    stops at the edits allowed, and only pairs within them are shuffled. No pair within the ratio is missed.
    """
    a, b = left.select("name").distinct(), right.select("name").distinct()
    edits = met(a, b).where("a <> b").select("a", "b", F.expr("levenshtein(a, b, most)").alias("edits"))
    return edits.where("edits >= 0").distinct()


def resolve_names(requests: DataFrame, companies: DataFrame) -> DataFrame:
    """requests with company_id, company_name and confidence of the best company (company_id, name) for each name, or nulls.

    An equal name, case and outer white space aside, has confidence 1; else the nearest within the ratio has one less
    its share of edited characters, to six places; of equals the least name, then the least id. Each distinct name is
    compared once. Null and blank names have no company.
    """
    key = F.lower(strip(F.coalesce("name", F.lit(""))))
    known = companies.withColumn("_key", key).where("_key <> ''").groupBy("_key").agg(F.min(F.struct(F.col("company_id").alias("company_id"), F.col("name").alias("company_name"))).alias("company"))
    asked = requests.withColumn("_key", key)
    wanted = asked.where("_key <> ''").select("_key").distinct()
    exact = wanted.join(known, "_key").select("_key", "company", F.lit(1.0).alias("confidence"))
    rest = wanted.join(known, "_key", "left_anti")
    ratio = F.lit(1.0) - F.col("edits") / F.greatest(F.length("a"), F.length("b"))
    near = near_names(rest.select(F.col("_key").alias("name")), known.select(F.col("_key").alias("name")))
    best = near.groupBy(F.col("a").alias("_near")).agg(F.min(F.struct((-ratio).alias("less"), "b")).alias("m"))
    fuzzy = best.join(known, F.col("m.b") == F.col("_key")).select(F.col("_near").alias("_key"), "company", F.round(-F.col("m.less"), 6).alias("confidence"))
    return asked.join(exact.unionByName(fuzzy), "_key", "left").drop("_key").select(*requests.columns, "company.*", "confidence")
