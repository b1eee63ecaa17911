"""C02-C05 as a log of events: a turn is one event, so it is kept whole or not at all, and what a conversation is, is a fold of its events.

Events have ids that clients make. One that comes again, as after a lost reply, counts once; events of one moment are ordered by id. Nothing is ever
changed, so writers need no lock and no number that another may take: messages are numbered by their place in the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.chatlog import RATINGS, ROLES
from foliant.operators.numbering import numbered

TITLE = 80
ORDER = ("at", "event_id", "place")


def once(events: DataFrame) -> DataFrame:
    """Each event once; those without id or conversation are none."""
    return events.where("event_id IS NOT NULL AND conversation_id IS NOT NULL").dropDuplicates(["conversation_id", "event_id"])


def _first(value: Column) -> Column:
    """The earliest that isn't missing."""
    return F.min_by(value, F.struct(value.isNull(), F.col("at"), F.col("event_id")))


def conversations(events: DataFrame) -> DataFrame:
    """(id, user_id, title, created_at, updated_at, n_messages) of each conversation with a turn: the first user and the first message's beginning stay,
    later turns touch it. All by sums and least values, so a conversation with most of the events is no single task's."""
    said = once(events).where("kind = 'turn'")
    return said.groupBy(F.col("conversation_id").alias("id")).agg(
        _first(F.col("user_id")).alias("user_id"),
        _first(F.left(F.get("messages", F.lit(0))["content"], F.lit(TITLE))).alias("title"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.sum(F.greatest(F.size("messages"), F.lit(0)).cast("long")).alias("n_messages")
    )


def _placed(events: DataFrame, what: Column) -> DataFrame:
    """Rows of ``what`` (an array) with their place in the event."""
    own = once(events).select("conversation_id", "at", "event_id", "user_id", F.posexplode(what).alias("place", "m"))
    return own.select("conversation_id", *ORDER, "user_id", "m.*")


def _by_place(rows: DataFrame, name: str) -> DataFrame:
    """``name``, from 1 within each conversation. Rows are numbered over all ranges of the order, less what stands before their conversation, so a long one is
    many tasks."""
    every = numbered(rows, ["conversation_id", *ORDER], name="__n")
    first = every.groupBy("conversation_id").agg(F.min("__n").alias("__first")).hint("rebalance")
    return every.join(first, "conversation_id").withColumn(name, F.col("__n") - F.col("__first") + 1).drop("__n", "__first")


def messages(events: DataFrame) -> DataFrame:
    """(conversation_id, message_id, role, content, confidence_flag, created_at) of all turns; messages of another role or without content are none."""
    rows = _placed(events.where("kind = 'turn'"), F.col("messages"))
    kept = rows.where(F.col("role").isin(*ROLES) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    return _by_place(kept, "message_id").select(
        "conversation_id", "message_id", "role", "content", "confidence_flag", F.col("at").alias("created_at")
    )


def feedback(events: DataFrame) -> DataFrame:
    """(conversation_id, id, message_id, rating, reason, user_id, created_at) of ratings that are known and name a message."""
    what = F.array(F.struct("message_id", "rating", "reason"))
    rows = _placed(events.where("kind = 'feedback'"), what).where(F.col("rating").isin(*RATINGS) & F.col("message_id").isNotNull())
    return _by_place(rows, "id").select("conversation_id", "id", "message_id", "rating", "reason", "user_id", F.col("at").alias("created_at"))
