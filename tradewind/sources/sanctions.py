"""Designations of a structured sanctions list in XML, and the articles made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

TEXT_LIMIT = 2000
_s = lambda *names: StructType([StructField(n, StringType()) for n in names])
#: Declared, not inferred: inference turns lists of one into scalars and ids into numbers.
SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("_euReferenceNumber", "_logicalId", "_designationDate", "_lastUpdated", "_unitedNationId")]
    + [
        StructField("nameAlias", ArrayType(_s("_wholeName", "_strong", "_nameLanguage", "_VALUE"))),
        StructField("regulation", ArrayType(_s("_numberTitle", "_publicationDate", "_VALUE"))),
        StructField("remark", ArrayType(StringType())),
        StructField("subjectType", ArrayType(_s("_code", "_classificationCode"))),
    ]
)


def _clean(c: Column, most: int = TEXT_LIMIT) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, most), F.lit(""))


def unsafe_files(spark: SparkSession, path: str) -> DataFrame:
    """path, reason of XML files not to be read: a document type or entity declaration, NUL bytes, or an encoding but UTF-8.

    Files are read line by line in splits, so none is held whole.
    """
    line = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("t"), F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("h"))
    reason = F.when(F.col("t").rlike(r"(?i)<!(DOCTYPE|ENTITY)"), "document type declaration").when(F.contains("t", F.lit("\0")), "NUL byte").when(F.col("h").isin("FEFF", "FFFE"), "byte order mark").when(F.col("t").rlike(r"""(?i)^\s*<\?xml[^>]*encoding=["'](?!utf-8)"""), "encoding")
    return line.select("path", reason.alias("reason")).where("reason is not null").groupBy("path").agg(F.min("reason").alias("reason"))


def designations(spark: SparkSession, path: str) -> DataFrame:
    """designation_id, reference, revision, is_update, is_entity, names (primary first), description: a row an element.

    The primary name is the last marked strong, else the first; the earliest revision of a reference is its
    designation, every other an update. The reader splits files at the row tag, so no task holds a whole list. Files
    that unsafe_files names are an error.
    """
    if bad := unsafe_files(spark, path).limit(3).collect():
        raise ValueError("unsafe XML: " + ", ".join(f"{x.path} ({x.reason})" for x in bad))
    rows = spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", "true").schema(SCHEMA).load(path)
    names = lambda c, of: F.array_distinct(F.array_compact(F.transform(F.coalesce(c, F.array()), of)))
    alias = lambda a: _clean(F.coalesce(F.nullif(a["_wholeName"], F.lit("")), a["_VALUE"]), 500)
    strong = F.filter(F.coalesce("nameAlias", F.array()), lambda a: (F.lower(a["_strong"]) == "true") & alias(a).isNotNull())
    aliases, regulations = names(F.col("nameAlias"), alias), names(F.col("regulation"), lambda r: _clean(F.coalesce(F.nullif(r["_numberTitle"], F.lit("")), r["_VALUE"]), 500))
    code = F.lower(F.concat(*(F.coalesce(F.try_element_at("subjectType", F.lit(-1))[k], F.lit("")) for k in ("_code", "_classificationCode"))))
    some = lambda *cs: F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cs), F.lit(""))
    r = rows.select(
        F.coalesce(_clean(some("_euReferenceNumber", "_logicalId"), 100), F.lit("")).alias("reference"), F.coalesce(_clean(some("_designationDate", "_lastUpdated", "_logicalId"), 40), F.lit("")).alias("revision"),
        aliases.alias("aliases"), F.transform(strong, alias).alias("strong"), regulations.alias("regulations"), _clean(F.try_element_at("remark", F.lit(-1))).alias("remark"),
        (code.startswith("e") | F.contains(code, F.lit("enterprise")) | F.contains(code, F.lit("entity"))).alias("is_entity"),
    )
    r = r.withColumn("primary", F.coalesce(F.try_element_at("strong", F.lit(-1)), F.get("aliases", F.lit(0)), "reference"))
    r = r.withColumn("secondary", F.filter("aliases", lambda a: a != F.col("primary")))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    facts = F.concat_ws("; ", F.when(F.col("is_entity"), "Entity").otherwise("Person"), F.concat(F.lit("EU reference "), "reference"), listed("aliases: ", "secondary"), listed("regulations: ", "regulations"), F.concat(F.lit("remarks: "), "remark"))
    earliest = F.min("revision").over(Window.partitionBy("reference"))
    return r.select(F.concat_ws(":", F.lit("eu-sanctions"), "reference", "revision").alias("designation_id"), "reference", "revision", (F.col("revision") != earliest).alias("is_update"), "is_entity", F.concat(F.array("primary"), "secondary").alias("names"), F.substring(facts, 1, TEXT_LIMIT).alias("description"))


def as_articles(found: DataFrame, limit: int) -> DataFrame:
    """The first designations by id as articles of the official source, with the names that screening compares."""
    title = F.concat(F.lit("EU sanctions designation"), F.when(F.col("is_update"), " update").otherwise(""), F.lit(": "), F.element_at("names", 1))
    top = found.orderBy("designation_id").limit(limit)
    return top.select(F.lit("eu_sanctions").alias("provider"), F.col("designation_id").alias("provider_article_id"), F.lit("sanctions").alias("query_group"), title.alias("title"), "description", F.col("description").alias("content_snippet"), F.lit("official").alias("source_class"), F.lit("en").alias("language"), F.try_to_timestamp("revision", F.lit("yyyy-MM-dd")).alias("published_at"), F.col("names").alias("designation_names"))
