"""Questions to graded answers, as one batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import gate
from foliant.functions.text import snippet
from foliant.operators import resolve, search
from foliant.operators.search import SOURCE_FIELDS

#: Keys and scores that are sent to all executors: under 64 MiB at 256 bytes each.
BROADCAST_ROWS = 1 << 18


def answer(
    questions: DataFrame,
    entities: DataFrame,
    chunks: DataFrame,
    embed: Callable[[Column], Column],
    k: int = 5,
    generate: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``questions(question_id, question)`` with ``company``, ``fiscal_year``, ``sources``, ``flag``, ``answer`` and ``retrieval_meta``.

    A question that names a company meets that company's chunks alone (of its year, if it names one), by a join; the others meet all chunks. ``generate``
    turns a prompt into text; without it the fallback answers. A blank question is left out.
    """
    asked = questions.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    known = resolve.resolve(asked, entities).withColumn("query_vector", embed(F.col("question")))
    rows = search.filtered(chunks)
    q = known.select(
        F.col("question_id").alias("query_id"),
        F.col("company").alias("asked_company"),
        F.col("fiscal_year").alias("asked_year"),
        "query_vector"
    )
    named = (F.col("company") == F.col("asked_company")) & (F.col("asked_year").isNull() | (F.col("fiscal_year") == F.col("asked_year")))
    pairs = rows.select("id", "embedding", "company", "fiscal_year").join(q.where("asked_company IS NOT NULL"), named)
    scored = pairs.select("query_id", "id", search.vectors.cosine_similarity(F.col("embedding"), F.col("query_vector")).alias("similarity"))
    scoped = scored.withColumn("rank", F.row_number().over(search._by("query_id", "id"))).where(F.col("rank") <= search.clamped(k))
    open_ = search.batch_scan(rows, q.where("asked_company IS NULL"), k)
    # The best are found by key and score; what they say is joined to those few, and no text is shuffled unless they are many.
    best = scoped.unionByName(open_)
    few = asked.count() * search.clamped(k) <= BROADCAST_ROWS
    top = (F.broadcast(best) if few else best).join(rows.drop("embedding"), "id")
    source = F.struct(
        "rank",
        F.col("id").cast("string").alias("chunk_id"),
        *SOURCE_FIELDS,
        F.col("similarity").alias("relevance_score"),
        "content",
        snippet(F.col("content")).alias("text_snippet"),
        "company_name_mismatch"
    )
    found = top.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    joined = known.join(found, known["question_id"] == found["query_id"], "left").drop("query_id", "query_vector")
    graded = joined.withColumn("flag", gate.confidence_flag(F.col("question"), F.col("sources")))
    text = generate(gate.prompt(F.col("question"), F.col("sources"), F.col("flag"))) if generate else F.lit(None).cast("string")
    done = graded.withColumn("a", gate.answered(F.col("flag"), text))
    meta = F.struct(
        resolve.filters(F.col("company"), F.col("fiscal_year")).alias("filters_applied"),
        F.greatest(F.size("sources"), F.lit(0)).alias("chunks_considered")
    )
    return done.select(
        "question_id",
        "question",
        "company",
        "fiscal_year",
        "sources",
        F.col("a.flag").alias("flag"),
        F.col("a.answer").alias("answer"),
        meta.alias("retrieval_meta")
    )


def degraded(questions: DataFrame) -> DataFrame:
    """What is said when the store can't be reached; no source is made up."""
    return questions.select(
        "question_id",
        "question",
        F.lit("system_unavailable").alias("flag"),
        F.lit("The filings can't be searched now.").alias("answer"),
        F.array().cast("array<string>").alias("sources")
    )


def chat_prompt(history: Column, question: Column, context: Column, turns: int = 6) -> Column:
    """The last turns, what was found, and the question."""
    from foliant.operators.chatlog import last_turns

    said = F.array_join(F.transform(last_turns(history, turns), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.concat(F.lit("HISTORY\n"), said, F.lit("\n\nCONTEXT\n"), context, F.lit("\n\nQUESTION\n"), question)
