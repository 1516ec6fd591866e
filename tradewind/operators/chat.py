"""Conversations from an append-only log of messages: their list, their messages, and what clearing leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def left_after(rows: DataFrame, cleared: DataFrame, at: str) -> DataFrame:
    """rows (user_id, a time `at`) of conversations or messages less those that a user's clearing (user_id, cleared_at) deleted."""
    last = cleared.groupBy("user_id").agg(F.max("cleared_at").alias("_cleared"))
    return rows.join(last, "user_id", "left").where(F.col("_cleared").isNull() | (F.col(at) > F.col("_cleared"))).drop("_cleared")


def threads(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """conversations (conversation_id, user_id, created_at) with title, message_count and last_message_at.

    messages has conversation_id, message_id, role, content and created_at. The title is the first 200 characters of
    the first question that has any text; an answer counts for two messages, its question's and its own, and is the
    last message; a conversation without an answer has none.
    """
    answer = F.col("role") == "assistant"
    asked = F.when((F.col("role") == "user") & (F.coalesce("content", F.lit("")) != ""), F.struct("created_at", "message_id", "content"))
    found = messages.withColumn("_asked", asked).groupBy("conversation_id").agg(F.min("_asked")["content"].alias("_title"), (2 * F.count_if(answer)).alias("_count"), F.max(F.when(answer, F.col("created_at"))).alias("last_message_at"))
    joined = conversations.join(found, "conversation_id", "left")
    return joined.select(*conversations.columns, F.substring("_title", 1, 200).alias("title"), F.coalesce("_count", F.lit(0)).alias("message_count"), "last_message_at")


def listed(of: DataFrame) -> DataFrame:
    """Each user's conversations with their place: the latest message first, those without one before all, then the newest."""
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_first("last_message_at"), F.desc("created_at"), "conversation_id")
    return of.withColumn("place", F.row_number().over(order))


def history(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages of conversations in order, each with its place and how many there are; a conversation of another user has none."""
    own = messages.join(conversations.select("conversation_id", "user_id"), ["conversation_id", "user_id"], "left_semi")
    order = Window.partitionBy("conversation_id").orderBy("created_at", "message_id")
    return own.withColumns({"place": F.row_number().over(order), "total_count": F.count("*").over(Window.partitionBy("conversation_id"))})
