"""Tables in buckets, and the chat log that is kept in one: what changes rewrite, and what many writers leave."""

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliant.operators import chat_events
from foliant.sources import schemas
from foliant.sources.buckets import BucketTable, Conflict

SCHEMA = "doc string, place long, word string"


@pytest.fixture
def made(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, "doc", ("place",), 8)
    assert t.create() and not t.create()
    return t


def rows_of(spark, names, word):
    return spark.createDataFrame([(n, i, word) for n in names for i in range(3)], SCHEMA)


def held(t, **kw):
    return sorted((r.doc, r.word) for r in t.read(**kw).where("place = 0").collect())


def test_a_document_that_comes_again_rewrites_its_bucket(spark, made):
    assert made.read().count() == 0 and made.parts() == []
    assert made.upsert(rows_of(spark, "abcdefgh", "old")) == []
    before, last = made.parts(), made._commits()[-1].name
    own = made.bucket_of("c")
    assert made.upsert(rows_of(spark, "cz", "new")) == [own]
    now = made.parts()
    assert {p for p in before if p not in now} == {p for p in before if p.endswith(f"={own}")}
    want = sorted([*((n, "old") for n in "abdefgh"), ("c", "new"), ("z", "new")])
    assert held(made) == want and made.read().count() == 27
    # The old table can still be read, by its commit or by who has listed its parts.
    assert held(made, upto=last) == held(made, parts=before) == [(n, "old") for n in "abcdefgh"]
    assert {r.doc for r in made.read([own]).collect()} <= {w[0] for w in want} and made.read([own]).where("doc = 'c'").count() == 3
    assert made.vacuum() == 0
    for most in (0, 8, 8):
        made.compact(most)
        assert held(made) == want
    assert len(made._commits()) == 2
    assert made.vacuum(0) == 2 and held(made) == want


def test_deletes_touch_only_what_they_must(spark, made):
    made.append(rows_of(spark, "abcdefgh", "x"))
    before = made.parts()
    assert made.delete_where(F.col("doc") == "nobody") == 0 and made.parts() == before
    assert made.delete_where(F.col("doc") == "a") == 3
    assert {p for p in before if p not in made.parts()} == {p for p in before if p.endswith(f"={made.bucket_of('a')}")}
    assert made.delete_where(F.lit(None).cast("boolean")) == 0
    made.clear()
    assert made.read().count() == 0
    made.append(rows_of(spark, "a", "y"))
    assert held(made) == [("a", "y")]


def test_two_that_replace_the_same_rows(spark, made):
    made.append(rows_of(spark, "a", "x"))
    parts = made.parts()
    made.commit(made.write(rows_of(spark, "a", "first")), parts)
    with pytest.raises(Conflict):
        made.commit(made.write(rows_of(spark, "a", "second")), parts)
    assert held(made) == [("a", "first")]


def test_a_write_that_dies_leaves_the_table(spark, made):
    made.append(rows_of(spark, "a", "x"))
    made.write(rows_of(spark, "b", "lost"))  # and no commit
    assert held(made) == [("a", "x")] and made.vacuum(0) == 1 and held(made) == [("a", "x")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    """Chats of three writers, one of which tidies up meanwhile; a repeated event counts once."""
    log = BucketTable(spark, f"file://{tmp_path}/log", schemas.CHAT_EVENTS, "conversation_id", ("at",), 4)
    log.create()
    begin = datetime(2024, 1, 1)

    def say(writer):
        for i in range(4):
            turn = [("user", f"q{writer}-{i}", None), ("assistant", f"a{writer}-{i}", "ok")]
            event = {"event_id": str(uuid.uuid4()), "conversation_id": f"c{i % 2}", "kind": "turn", "at": begin + timedelta(seconds=i), "user_id": writer if i else None, "messages": turn}
            for _ in range(1 + (i == 1)):
                log.append(spark.createDataFrame([event], schemas.CHAT_EVENTS))
            if writer == 0:
                log.compact(1)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(say, range(3)))
    log.compact(1)
    said = chat_events.messages(log.read()).orderBy("conversation_id", "message_id").collect()
    assert [(r.conversation_id, r.message_id) for r in said] == [(f"c{k}", i + 1) for k in (0, 1) for i in range(12)]
    assert {r.content for r in said} == {f"{x}{w}-{i}" for x in "qa" for w in range(3) for i in range(4)}
    for a, b in zip(said[::2], said[1::2], strict=True):
        assert (a.role, b.role) == ("user", "assistant") and a.content[1:] == b.content[1:] and a.created_at == b.created_at
    talks = {r.id: r for r in chat_events.conversations(log.read()).collect()}
    assert talks["c0"].n_messages == 12 and talks["c0"].user_id in range(3) and talks["c0"].title.startswith("q")
    assert (talks["c1"].created_at, talks["c1"].updated_at) == (begin + timedelta(seconds=1), begin + timedelta(seconds=3))


def test_events_that_are_odd(spark):
    rows = [
        {"event_id": "1", "conversation_id": None, "kind": "turn", "at": None},
        {"event_id": None, "conversation_id": "c", "kind": "turn", "at": None},
        {"event_id": "2", "conversation_id": "c", "kind": "turn", "at": None, "messages": [("user", "  ", None), ("nobody", "x", None), ("user", "real", None)]},
        {"event_id": "3", "conversation_id": "c", "kind": "turn", "at": None, "messages": None},
        {"event_id": "4", "conversation_id": "c", "kind": "feedback", "at": None, "message_id": 1, "rating": "meh"},
        {"event_id": "5", "conversation_id": "c", "kind": "feedback", "at": None, "message_id": 1, "rating": "up"},
    ]
    events = spark.createDataFrame(rows, schemas.CHAT_EVENTS)
    assert [(r.message_id, r.content) for r in chat_events.messages(events).collect()] == [(1, "real")]
    assert [(r.id, r.rating) for r in chat_events.feedback(events).collect()] == [(1, "up")]
    assert [(r.id, r.n_messages) for r in chat_events.conversations(events).collect()] == [("c", 3)]
    assert chat_events.messages(events.limit(0)).count() == chat_events.conversations(events.limit(0)).count() == 0
