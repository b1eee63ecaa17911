"""F04 by the corpus's own words: tokens that lost their spaces, cut into words that the corpus knows.

A token of ``GLUED`` letters or more is glued. Words are the shorter ones; a word's cost is the logarithm of all words over its own count. Nothing is
broadcast: the pieces that a token might be cut into (fewer than ``GLUED`` letters, so a token has at most ``GLUED`` - 1 for each letter) are joined to the
counts, each distinct token comes back with the few that are words, and the cheapest cut is found by itself. Tokens meet texts by a join, a text once.
Joins are by sort on both sides, so no table of words, tokens or cuts is gathered on the driver, however small its shuffle looks.

Null and empty texts stay as they are; a corpus without words leaves every token whole, as does a token with a part that is no word (``unknown`` letters
are never invented). Equal costs take the cut with the shorter last word. Repeated rows are each cut; ``docs`` may have any other columns, whose names
are free of ``__token`` and ``__cut``.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions.udfs import segmented
from foliant.session import ship, spread

GLUED = 15
_LETTERS = rf"\p{{L}}{{{GLUED},}}"
_WORD = r"\p{L}+"


def word_costs(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """(``word``, ``n``, ``cost``) of the lower-cased words of under ``GLUED`` letters that stand ``least`` times or more in all texts."""
    words = spread(docs.select(text)).select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))).alias("word"))
    counts = words.where(F.length("word") < GLUED).groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # One row, so a join to it is no shuffle of the counts.
    return counts.where(F.col("n") >= least).join(F.broadcast(total)).select("word", "n", F.log(F.col("total") / F.col("n")).alias("cost"))


@F.pandas_udf(StringType())
def _cheapest(tokens: pd.Series, words: pd.Series, costs: pd.Series) -> pd.Series:
    def cut(token: str, names, prices) -> str:
        known = dict(zip(names, prices, strict=True)) if names is not None else {}
        parts = segmented(token, known, math.inf, GLUED - 1)
        return " ".join(parts) if all(p.lower() in known for p in parts) else token

    return pd.Series([cut(t, w, c) for t, w, c in zip(tokens, words, costs, strict=True)], dtype="object")


def cut_tokens(tokens: DataFrame, costs: DataFrame, token: str = "token") -> DataFrame:
    """Each distinct ``token`` with ``cut``: itself, or its cheapest words with a space between them."""
    ship(tokens.sparkSession)
    own = tokens.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct()
    low = F.lower("token")
    starts = F.sequence(F.lit(1), F.length("token"))
    sizes = F.sequence(F.lit(1), F.lit(GLUED - 1))
    pieces = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(sizes, lambda k: F.substring(low, i, k)))))
    found = own.where(F.length("token") > 0).select("token", F.explode(pieces).alias("word")).join(costs.select("word", "cost").hint("merge"), "word")
    # A token has a bounded number of pieces for each of its letters, so its list is no longer than the token.
    listed = found.groupBy("token").agg(F.collect_list("word").alias("words"), F.collect_list("cost").alias("costs"))
    return own.join(listed.hint("merge"), "token", "left").select("token", _cheapest("token", "words", "costs").alias("cut"))


def deglued(docs: DataFrame, costs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the glued tokens of ``text`` cut. ``key`` tells rows apart; rows that repeat it must have one text."""
    tokens = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_LETTERS), F.lit(0)))).alias("token"))
    changed = tokens.join(cut_tokens(tokens, costs).hint("merge"), "token").where("token <> cut")
    cuts = changed.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "cut"))).alias("__cut"))
    parts = F.regexp_extract_all(F.col(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    whole = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("__cut", p), p)), "")
    body = F.when(F.col("__cut").isNotNull(), whole).otherwise(F.col(text))
    return docs.join(cuts.hint("merge"), key, "left").select(*(body.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
