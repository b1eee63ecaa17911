"""Vectors as arrays of floats: similarity, checks, text form, and encoders."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from foliant.session import ship

DIMENSION = 384


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v)).cast("array<double>")


def cosine_similarity(a: Column, b: Column) -> Column:
    """One minus the cosine distance; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity_to(a: Column, v: Sequence[float]) -> Column:
    """V01 against one vector: its norm is computed here, once."""
    size = float(np.sqrt(sum(float(x) * float(x) for x in v)))
    return F.try_divide(dot(a, literal(v)), norm(a) * F.lit(size))


def checked(a: Column, dimension: int = DIMENSION) -> Column:
    """The vector; another dimension is an error."""
    return F.when(a.isNull() | (F.size(a) == dimension), a).otherwise(
        F.raise_error(F.format_string("vector of %d numbers, not %d", F.size(a), F.lit(dimension)))
    )


def to_text(a: Column) -> Column:
    """``[a,b,…]``."""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))


def from_text(s: Column) -> Column:
    return F.from_json(s, "array<double>")


@F.pandas_udf(ArrayType(DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    def of(t: str | None) -> list[float | None]:
        if t is None:
            return [None] * 3
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
        blank = ((codes >= 9) & (codes <= 13)) | (codes == 32)
        starts = np.count_nonzero(~blank[1:] & blank[:-1]) + np.count_nonzero(~blank[:1])
        letters = codes[~blank]
        return [float(starts), float(len(letters)), float((letters % 1000).sum(dtype=np.int64))]

    return texts.map(of)


def token_statistics(text: Column) -> Column:
    """[tokens, sum of their lengths, sum over characters of code point mod 1000], for tests without a model. Tokens lie between blanks, tabs and line ends;
    the letters of a text are numbers of one numpy array, not values of an array column."""
    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    return _statistics(F.lower(text))


def hashing_encoder(dimension: int = DIMENSION) -> Callable[[list[str]], np.ndarray]:
    """A deterministic encoder: signed word counts by hash, of unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dimension] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return encode


def embed(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32) -> Callable[[Column], Column]:
    """Text to unit vector by an injected encoder, which each worker loads once and feeds ``batch`` texts at a time."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            rows: list[np.ndarray] = []
            for a in range(0, len(texts), batch):
                rows.extend(encode(texts.iloc[a : a + batch].fillna("").tolist()))
            yield pd.Series(rows, index=texts.index, dtype=object)

    return run
