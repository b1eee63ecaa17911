"""Conversations, messages and feedback as append-only tables with merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import canonical_uuid
from foliant.operators.batches import upserted
from foliant.operators.numbering import numbered

ROLES, RATINGS = ("user", "assistant"), ("up", "down")


def ensured(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(id, user_id, title, at)`` merged in: new ids are added, known ones keep title and user and are touched. Ids that are no
    UUID are left out."""
    valid = asked.withColumn("id", canonical_uuid(F.col("id"))).where("id IS NOT NULL")
    new = valid.groupBy("id").agg(
        F.min_by("user_id", F.struct(F.col("user_id").isNull(), F.col("at"))).alias("user_id"),
        F.min_by("title", "at").alias("title"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at")
    )
    return upserted(conversations, new, ["id"], ["user_id", "title", "created_at"])


def history(messages: DataFrame, conversation: str | None = None) -> DataFrame:
    """(role, content) of one conversation in order, or an ordered array for each."""
    if conversation is not None:
        return messages.where(F.col("conversation_id") == conversation).orderBy("id").select("role", "content")
    ordered = F.array_sort(F.collect_list(F.struct("id", "role", "content")))
    return messages.groupBy("conversation_id").agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history")
    )


def last_turns(history: Column, n: int = 6) -> Column:
    """E11's window."""
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), F.lit(n))


def turn(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Two rows a turn of ``turns(conversation_id, at, question, answer, confidence_flag)``, numbered after the last message. Turns
    of an id that is no UUID are left out."""
    ok = turns.withColumn("conversation_id", canonical_uuid(F.col("conversation_id"))).where("conversation_id IS NOT NULL")
    two = F.explode(
        F.array(
            F.struct(
                F.lit(0).alias("k"),
                F.lit("user").alias("role"),
                F.col("question").alias("content"),
                F.lit(None).cast("string").alias("flag")
            ),
            F.struct(
                F.lit(1).alias("k"),
                F.lit("assistant").alias("role"),
                F.col("answer").alias("content"),
                F.col("confidence_flag").alias("flag")
            )
        )
    )
    rows = ok.select("conversation_id", "at", two.alias("m")).select(
        "conversation_id", "at", "m.k", "m.role", "m.content", F.col("m.flag").alias("confidence_flag")
    )
    last = messages.agg(F.coalesce(F.max("id"), F.lit(0).cast("long"))).first()[0]
    new = numbered(rows, ["at", "conversation_id", "k"], last + 1).select(
        "id", "conversation_id", "role", "content", "confidence_flag", F.col("at").alias("created_at")
    )
    return messages.unionByName(new, allowMissingColumns=True)


def valid_messages(messages: DataFrame) -> DataFrame:
    """Rows with a role that the store allows, and content."""
    return messages.where(F.col("role").isin(*ROLES) & (F.trim(F.coalesce("content", F.lit(""))) != ""))


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """A known rating, a message and a conversation."""
    return feedback.where(
        F.col("rating").isin(*RATINGS) & F.col("message_id").isNotNull() & canonical_uuid(F.col("conversation_id")).isNotNull()
    )


def feedback_of(feedback: DataFrame, conversation: str) -> DataFrame:
    return feedback.where(F.col("conversation_id") == conversation).orderBy("id")


def user_questions(messages: DataFrame) -> DataFrame:
    """X04."""
    return messages.where(F.col("role") == "user").select("conversation_id", "id", "content").orderBy("conversation_id", "id")


def source_detail(chunks: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """``wanted(chunk_id)`` with the chunk, null where the id is no number or unknown."""
    asked = wanted.withColumn("__id", F.col("chunk_id").try_cast("bigint"))
    return asked.join(chunks.withColumnRenamed(key, "__key"), F.col("__id") == F.col("__key"), "left").drop("__id", "__key")
