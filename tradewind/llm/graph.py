"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import discard, stored

#: Parts that the rows of one node are dealt into when they meet the node's minimum.
PARTS = 16


def _stars(links: DataFrame, both_ways: bool) -> DataFrame:
    """Each node's neighbours are hung on the least of them and the node itself.

    Minima are aggregated where the rows lie before they are shuffled. To meet its minimum, a node's rows are dealt
    into PARTS by their other end, and the minimum goes to each part: a centre of any degree is no single task's.
    """
    seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else links
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    every = F.array(*(F.lit(k) for k in range(PARTS)))
    hung = seen.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")).join(least.withColumn("part", F.explode(every)), ["u", "part"])
    if both_ways:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every linked node; component is the least node reachable.

    Each round is written to the shared folder, so no lineage builds up, and the round before it is deleted. Self-links
    and nulls are dropped, repeated links count once; an empty link table gives an empty result.
    """
    spark = links.sparkSession
    now, path = stored(links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "links", few=True)
    mark = None
    while True:
        after, following = stored(_stars(_stars(now, True), False), "stars", few=True)
        discard(spark, path)
        now, path = after, following
        at = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first()
        if at == mark:
            break
        mark = at
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
