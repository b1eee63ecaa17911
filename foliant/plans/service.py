"""What the chat and the retrieval service offer, as calls on a store's tables; a web layer of any kind can sit on top.

A call is a small batch: it reads what it needs by key and appends one event, so many processes can serve one store, and no call rewrites a table. A turn is one
event, so a question is never kept without its answer. Messages and ratings are numbered within their conversation. ``tidied`` joins the small files that
calls leave; it can run beside them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chat_events, chatlog, search
from foliant.plans.answer import answer, degraded
from foliant.sources import schemas, sinks
from foliant.sources.buckets import BucketTable
from foliant.sources.readers import companies, stored

WELCOME = "Ask about a company's annual reports: name the company and the year."


class NotFound(LookupError):
    """There is no such row (404)."""


class Invalid(ValueError):
    """The request can't be taken (422)."""


@dataclass(frozen=True)
class Service:
    """The store in ``folder`` with an encoder of questions and, if there is one, a model that turns prompts into text."""

    spark: SparkSession
    folder: str
    embed: Callable[[Column], Column]
    generate: Callable[[Column], Column] | None = None
    dimension: int = 384

    def start(self) -> Service:
        """Makes the tables that the store lacks."""
        schemas.bootstrap(self.spark, self.folder)
        self._events().create()
        return self

    def _events(self) -> BucketTable:
        return schemas.in_buckets(self.spark, self.folder, "chat_events")

    def _of(self, conversation: str) -> DataFrame:
        """A conversation's events, from its bucket."""
        log = self._events()
        return log.read([log.bucket_of(conversation)]).where(F.col("conversation_id") == conversation)

    def _add(self, kind: str, conversation: str, now: datetime, **fields) -> str:
        event = {"event_id": str(uuid.uuid4()), "conversation_id": conversation, "kind": kind, "at": now} | fields
        self._events().append(self.spark.createDataFrame([event], schemas.CHAT_EVENTS))
        return event["event_id"]

    def tidied(self) -> None:
        """Joins the parts of buckets that have many, and the commits."""
        self._events().compact()

    def _table(self, name: str) -> DataFrame:
        return stored(self.spark, self.folder, name)

    def health(self) -> dict[str, object]:
        """Whether the store can be read, and how many chunks it has."""
        try:
            return {"status": "ok", "chunks": self._table("rag_chunks").count()}
        except Exception as e:  # what fails is part of the answer
            return {"status": "unavailable", "error": type(e).__name__}

    def welcome(self) -> str:
        return WELCOME

    def ingest(self, chunks: DataFrame) -> int:
        """Loads chunks of any number of documents; the number of chunks there are then."""
        sinks.load_chunks(self.spark, self.folder, chunks, self.dimension)
        return self._table("rag_chunks").count()

    def companies(self) -> DataFrame:
        return companies(self._table("rag_chunks"))

    def search(self, question: str, k: int = 5, **filters) -> tuple[DataFrame, dict]:
        """The sources of a question, and what was asked for."""
        one = self.spark.createDataFrame([(question,)], "question string")
        vector = one.select(self.embed(F.col("question")).alias("v")).first()["v"]
        return search.retrieve(self._table("rag_chunks"), [float(x) for x in vector], "store", k, **filters)

    def chat(self, message: str, conversation_id: str | None = None, user_id: int | None = None) -> dict[str, object]:
        """Answers a message and keeps the turn. An id that is no UUID begins a conversation; a store that can't be read gives the degraded answer,
        which isn't kept."""
        if not message or not message.strip():
            raise Invalid("a blank message")
        known = self.spark.createDataFrame([(conversation_id,)], "id string").select(
            T.canonical_uuid(F.col("id")).alias("id")
        ).first()["id"]
        conversation, now = known or str(uuid.uuid4()), datetime.now(timezone.utc).replace(tzinfo=None)
        asked = self.spark.createDataFrame([(1, message)], "question_id int, question string")
        try:
            chunks = self._table("rag_chunks")
            found = answer(asked, companies(chunks).select("company", "ticker"), chunks, self.embed, generate=self.generate).first()
        except (PySparkException, Py4JError, OSError):  # the store or the encoder is away: say so, and make nothing up
            row = degraded(asked).first()
            return {
                "conversation_id": conversation,
                "message_id": None,
                "answer": row["answer"],
                "confidence_flag": row["flag"],
                "sources": []
            }
        said = [("user", message, None), ("assistant", found["answer"], found["flag"])]
        event = self._add("turn", conversation, now, user_id=user_id, messages=said)
        message_id = self._last_of(conversation, event)
        sources = [s.asDict() for s in found["sources"] or []]
        return {
            "conversation_id": conversation,
            "message_id": message_id,
            "answer": found["answer"],
            "confidence_flag": found["flag"],
            "sources": sources
        }

    def _last_of(self, conversation: str, event: str) -> int:
        """The place of an event's last message. Turns count two, so only their order is asked for."""
        own = chat_events.once(self._of(conversation).where("kind = 'turn'")).select("at", "event_id", "messages")
        mark = own.where(F.col("event_id") == event).select(F.col("at").alias("__at"), F.col("event_id").alias("__id"))
        before = own.join(F.broadcast(mark), F.struct("at", "event_id") <= F.struct("__at", "__id"))
        return before.agg(F.sum(F.size("messages"))).first()[0]

    def history(self, conversation_id: str) -> DataFrame:
        """(role, content) of a conversation, in order."""
        return chat_events.messages(self._of(conversation_id)).orderBy("message_id").select("role", "content")

    def conversation(self, conversation_id: str) -> dict[str, object]:
        """A conversation's user, title and times."""
        row = chat_events.conversations(self._of(conversation_id)).first()
        if row is None:
            raise NotFound(f"conversation {conversation_id}")
        return row.asDict()

    def save_feedback(
        self, conversation_id: str, message_id: int, rating: str, reason: str | None = None, user_id: int | None = None
    ) -> int:
        """Keeps a rating of an answer; its id."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        given = self.spark.createDataFrame(
            [(message_id, conversation_id, rating)], "message_id long, conversation_id string, rating string"
        )
        if chatlog.valid_feedback(given).isEmpty():
            raise Invalid("feedback needs a known rating, a message and a conversation")
        own = self._of(conversation_id)
        held = chat_events.once(own.where("kind = 'turn'")).agg(F.sum(F.size("messages"))).first()[0] or 0
        if not 1 <= message_id <= held:
            raise NotFound(f"message {message_id}")
        event = self._add("feedback", conversation_id, now, user_id=user_id, message_id=message_id, rating=rating, reason=reason)
        return chat_events.once(self._of(conversation_id).where("kind = 'feedback'")).where(
            (F.col("at") < now) | ((F.col("at") == now) & (F.col("event_id") <= event))
        ).count()

    def feedback(self, conversation_id: str) -> DataFrame:
        return chat_events.feedback(self._of(conversation_id)).orderBy("id")

    def source(self, chunk_id: str) -> dict[str, object]:
        """A source's chunk by its id."""
        wanted = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        row = chatlog.source_detail(self._table("rag_chunks").drop("embedding"), wanted).first()
        if row["content"] is None:
            raise NotFound(f"source {chunk_id}")
        return row.asDict()
