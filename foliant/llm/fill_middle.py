"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the pieces are put in another order between marks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.session import released, ship, spread

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space, as runs of it are units of their own where units are words.
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_from(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def boundaries(points: np.ndarray, units: str = "characters") -> np.ndarray:
    """Places where units begin, and the end. Neighbours of unlike class are parted: where units are ``characters`` classes alternate, so each
    code point is a unit; where they are ``words``, runs of white space and of all else are units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = np.arange(len(points)) & 1 if units == "characters" else np.isin(points, SPACES)
    return np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]])


def draws(key: str, seed: int) -> list[int]:
    """Four numbers that hang on the key and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(
    text: str, key: str, seed: int = 1, units: str = "characters", cut_percent: int = 90, spm_percent: int = 20
) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and of middle, and the new text."""
    points = code_points(text)
    at = boundaries(points, units)
    n, h = len(at) - 1, draws(key, seed)
    if not n or h[2] % 100 >= cut_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = at[sorted((h[0] % (n + 1), h[1] % (n + 1)))]
    prefix, middle, suffix = text_from(points[:a]), text_from(points[a:b]), text_from(points[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", int(a), int(b - a), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", int(a), int(b - a), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, units: str = "characters", cut_percent: int = 90, spm_percent: int = 20
) -> DataFrame:
    """``docs`` without its text, with ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (code points; null if
    plain) and ``output``, the text to train on.

    Cuts hang on ``key`` and ``seed`` alone, so rows that repeat a key and a text get the same output and a task that runs again gives what it
    gave. A missing text counts as empty and a missing key as an empty one; empty texts, and texts that hold a mark, stay plain. Texts
    are processed whole, a batch at a time. No rows: an empty result. A column of ``docs`` named like a result column is replaced; all others are carried.
    """
    if units not in ("characters", "words"):
        raise ValueError(f"units are characters or words, not {units}")
    ship(docs.sparkSession)
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    own = [f for f in docs.schema.fields if f.name != text and f.name not in results]
    # Columns go by place, so that no name clashes.
    kept = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)]
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("name")
    rows = spread(docs.select(*kept, name, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    schema = StructType(list(own)).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()
            made = [rearranged(t, k, seed, units, cut_percent, spm_percent) for k, t in zip(names, texts, strict=True)]
            found = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *found], names=[f.name for f in schema.fields])

    return rows.mapInArrow(released(run), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from what was made of it. No mark can arise where a piece meets a mark, so the marks part the pieces."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(piece[1], piece[3], piece[2]), F.concat(piece[2], piece[3], piece[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
