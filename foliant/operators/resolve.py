"""Questions to the company and year that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.similar import similar_words

THRESHOLD = 0.8
_BETWEEN = r"(?U)\W+"


def by_ticker(questions: DataFrame, entities: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """E01, first path: the first entity (by company, ticker) whose ticker is a whole word of the upper-cased question.

    Words are joined to the first word of each ticker, so questions meet only the entities they may name; a ticker with signs in it, as BRK.B,
    is then looked for as it is."""
    words = questions.select(
        key, F.col(question).alias("__q"), F.explode(F.array_distinct(F.split(F.upper(question), _BETWEEN))).alias("t")
    ).where("t <> ''")
    known = entities.where(F.coalesce("ticker", F.lit("")) != "").select(F.upper("ticker").alias("__ticker"), "company", "ticker")
    first = F.get(F.filter(F.split("__ticker", _BETWEEN), lambda w: w != ""), 0)
    met = words.join(known.withColumn("t", first), "t").where(
        (F.col("__ticker") == F.col("t")) | T.names_ticker(F.col("__q"), F.col("__ticker"))
    )
    return met.groupBy(key).agg(F.min(F.struct("company", "ticker")).alias("e")).select(key, "e.company", F.lit(1.0).alias("score"))


def by_name(
    questions: DataFrame, entities: DataFrame, key: str = "question_id", question: str = "question", threshold: float = THRESHOLD
) -> DataFrame:
    """E01, second path: the entity whose weakest name part has the best match in the question, if that reaches ``threshold``.

    Distinct words are compared once, and only those that share a piece that the threshold asks for (``similar``); a name with a part that matches
    nothing is no candidate."""
    words = questions.select(key, F.explode(F.array_distinct(T.tokens(T.normal_name(F.col(question))))).alias("q"))
    names = entities.select("company", F.array_distinct(T.core_tokens(T.normal_name(F.col("company")))).alias("parts")).distinct()
    parts = names.select("company", F.size("parts").alias("n"), F.explode("parts").alias("p"))
    scored = similar_words(parts, words, threshold)
    best = words.join(scored, "q").groupBy(key, "p").agg(F.max("ratio").alias("ratio"))
    whole = best.join(parts, "p").groupBy(key, "company", "n").agg(
        F.min("ratio").alias("score"), F.count("*").alias("hit")
    ).where("hit = n")
    top = Window.partitionBy(key).orderBy(F.col("score").desc(), "company")
    return whole.withColumn("r", F.row_number().over(top)).where("r = 1").select(key, "company", "score")


def resolve(questions: DataFrame, entities: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """``questions`` with ``company``, ``fiscal_year`` (only with a company) and ``score``; all null where nothing is named."""
    exact = by_ticker(questions, entities, key, question)
    fuzzy = by_name(questions.join(exact, key, "left_anti"), entities, key, question)
    return questions.join(exact.unionByName(fuzzy), key, "left").withColumn(
        "fiscal_year", F.when(F.col("company").isNotNull(), T.first_year(F.col(question)))
    )


def filters(company: Column, fiscal_year: Column) -> Column:
    """What is set, as a map from name to list."""
    both = F.filter(
        F.array(
            F.struct(F.lit("company").alias("key"), company.alias("value")),
            F.struct(F.lit("fiscal_year").alias("key"), fiscal_year.cast("string").alias("value"))
        ),
        lambda e: e["value"].isNotNull()
    )
    return F.map_from_entries(both)
