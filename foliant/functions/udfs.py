"""What no built-in expresses: Unicode normal form, word segmentation, and Ratcliff-Obershelp similarity."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from foliant.session import ship

_GLUED = re.compile(r"\b\w{15,}\b")


def _printable(part: str) -> str:
    return part if part.isprintable() else "".join(c for c in part if c.isprintable())


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        lines = unicodedata.normalize("NFKC", t).split("\n")
        return "\n".join("\t".join(map(_printable, x.split("\t"))) for x in lines)

    return texts.map(clean)


def clean_unicode(text: Column) -> Column:
    """NFKC without what can't be printed, but for newlines and tabs. Texts of ASCII alone stay in the JVM, and the others go to workers in small batches."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    odd = text.rlike(r"[^\x00-\x7F]")
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]+", "")
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(plain)


def segmented(word: str, cost: Mapping[str, float], unknown: float, longest: int) -> list[str]:
    """The cheapest way to cut a word into known ones; an unknown letter costs ``unknown``."""
    best, back = [0.0], [0]
    low = word.lower()
    for i in range(1, len(word) + 1):
        price, size = min(
            (best[i - k] + cost.get(low[i - k : i], unknown * k if k == 1 else math.inf), k) for k in range(1, min(i, longest) + 1)
        )
        best.append(price)
        back.append(size)
    out, i = [], len(word)
    while i:
        out.append(word[i - back[i] : i])
        i -= back[i]
    return out[::-1]


def deglue(words_by_rank: list[str]):
    """a column function that cuts words of fifteen letters or more by a list of words, most frequent first."""
    n = max(2, len(words_by_rank))
    cost = {w: math.log((i + 1) * math.log(n)) for i, w in enumerate(words_by_rank)}
    longest = max(map(len, words_by_rank), default=1)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def cut(m: re.Match) -> str:
            return " ".join(segmented(m[0], cost, 1e3, longest))

        return texts.map(lambda t: None if t is None else _GLUED.sub(cut, t))

    return run


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """twice the matching characters over all characters."""
    return pd.Series(
        [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)],
        dtype="float64"
    )
