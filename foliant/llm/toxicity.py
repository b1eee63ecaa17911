"""Toxicity scores from a counterfactually regularised classifier.

The model is a logistic regression on which words, and which beginnings of words, a text has. For each labelled sentence that names a group of
people, twins are made in which the identity term is swapped for others of its kind; a squared penalty
on the change of score between text and twin keeps the terms themselves from counting, so that a neutral mention of a
group is no reason to reject.

The fit takes at most ``max_train`` labelled documents (those of least hash, so any size of table gives one
sample), one of each distinct text. Words that stand apart between the labels by ``least_z`` standard
errors become features, ``max_features`` at most. Candidates are counted and twins made on executors; the driver gets
feature numbers only: those of each text once, and of each twin those that it loses or gains, so its memory grows with the sample's
texts and not with their squares. Scoring is a narrow map over whole texts.

Null texts count as empty and get the score of a text without features. Null labels are ignored; of repeated
labels the larger holds. With no labels, or only one kind, all scores are the smoothed share of label 1
(0.5 without labels). An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_of, written
from foliant.session import released, ship, spread

#: Terms by kind; a term is swapped for others of its line.
IDENTITY = (
    "muslim christian jewish hindu buddhist atheist catholic sikh",
    "muslims christians jews hindus buddhists atheists catholics sikhs",
    "women men girls boys",
    "woman man girl boy",
    "gay straight lesbian bisexual transgender",
    "black white asian african latino hispanic arab",
    "american mexican chinese indian french german polish turkish russian",
    "immigrants refugees foreigners citizens",
    "deaf blind disabled autistic",
    "old young elderly teenage",
    "femmes hommes",
    "musulmans chrétiens juifs",
    "frauen männer",
    "muslime christen juden",
    "mujeres hombres",
    "musulmanes cristianos judíos",
)
_SWAPS = {w: [v for v in line.split() if v != w] for line in IDENTITY for w in line.split()}
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
_WORDS_SQL = r"(?U)[^\w]+"
#: Letters of a word's beginnings that count beside the word.
STARTS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, words: set[str]) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(features_of(words) & self.weights.keys()))
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def held_out(key: Column) -> Column:
    """The third of all documents that no fit may see."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _of_word(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in STARTS if len(word) > k)]


def features_of(words: set[str]) -> set[str]:
    """Words, and their beginnings under a mark."""
    out = set(words)
    for k in STARTS:
        out.update(["^" + w[:k] for w in words if len(w) > k])
    return out


def twin_changes(text: str, each: int = 2) -> list[tuple[set[str], set[str]]]:
    """For each twin of a text, in which the identity terms of one sentence are swapped: the features that it loses and those that it gains.

    A twin is told by its few changes, so all twins of a text take room and time in proportion to it.
    """
    sentences = [WORD.findall(s) for s in SENTENCE.findall(text.lower())]
    swaps: list[Counter[str]] = []
    for own in sentences:
        terms = [w for w in own if w in _SWAPS]
        for k in range(each if terms else 0):
            change: Counter[str] = Counter()
            for w in terms:
                change.subtract(_of_word(w))
                change.update(_of_word(_SWAPS[w][k % len(_SWAPS[w])]))
            swaps.append(change)
    if not swaps:
        return []
    touched = {f for change in swaps for f in change}
    has = Counter(f for own in sentences for w in own for f in _of_word(w) if f in touched)
    changes = [({f for f, n in c.items() if has[f] and has[f] + n == 0}, {f for f, n in c.items() if n > 0 and not has[f]}) for c in swaps]
    return [c for c in changes if c[0] or c[1]]


def _sample(docs: DataFrame, labels: DataFrame, max_train: int, key: str, text: str, label: str) -> DataFrame:
    """(label, text) of at most ``max_train`` labelled documents, one of each distinct text."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    picked = known.orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(max_train)  # ids and labels only
    rows = docs.join(F.broadcast(picked) if max_train <= 200_000 else picked, key).select(
        "__y", text_of(text).alias("text"), F.sha2(text_of(text), 256).alias("d")
    )
    return rows.groupBy("d").agg(F.max("__y").alias("y"), F.first("text").alias("text"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_train: int = 20_000,
    max_features: int = 20_000,
    least_z: float = 4.0,
    least_docs: int = 3,
    penalty: float = 1.0,
    l2: float = 0.01,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic"
) -> Model:
    """A model of ``label``; the caller leaves out of ``labels`` what it must not see. ``penalty`` weighs the change of
    score between a text and its twins; ``l2`` the size of weights."""
    ship(docs.sparkSession)
    train = written(_sample(docs, labels, max_train, key, text, label), "toxicity-sample", size=max_train * 8192)
    n = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    total, ones = n[0], n[1]
    share = (ones + 1) / (total + 2)
    flat = float(np.log(share / (1 - share)))
    if not ones or ones == total:
        return Model({}, flat)
    base = ones / total
    own = F.array_distinct(F.split(F.lower("text"), _WORDS_SQL))
    starts = [F.transform(F.filter(own, _longer(k)), _start(k)) for k in STARTS]
    words = spread(train).select("y", F.explode(F.array_distinct(F.concat(own, *starts))).alias("w")).where("w != ''")
    counts = words.groupBy("w").agg(F.count("*").alias("n"), F.sum("y").alias("k")).where(F.col("n") >= least_docs)
    z = (F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    picked = counts.withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.abs("z").desc(), "w").limit(max_features)
    features = [r["w"] for r in picked.collect()]
    number = {w: i for i, w in enumerate(features)}

    numbers, many = pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("y", pa.int32()), ("d", pa.string()), ("x", numbers), ("gone", many), ("new", many)])

    def numbered(words: set[str]) -> list[int]:
        return sorted(number[w] for w in words if w in number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, d, whole in zip(*(batch.column(c).to_pylist() for c in ("y", "d", "text")), strict=True):
                changes = [(numbered(gone), numbered(new)) for gone, new in twin_changes(whole)]
                changes = [c for c in changes if c[0] or c[1]]
                out.append(
                    {
                        "y": y,
                        "d": d,
                        "x": numbered(features_of(set(WORD.findall(whole.lower())))),
                        "gone": [c[0] for c in changes],
                        "new": [c[1] for c in changes]
                    }
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "y int, d string, x array<int>, gone array<array<int>>, new array<array<int>>"
    rows = sorted(spread(train).mapInArrow(released(run), kinds).collect(), key=lambda r: r["d"])
    changes = [(i, gone, new) for i, r in enumerate(rows) for gone, new in zip(r["gone"], r["new"], strict=True)]
    w, b = _fit([r["x"] for r in rows], np.array([r["y"] for r in rows], float), changes, len(features), flat, penalty, l2)
    return Model(dict(zip(features, w.tolist(), strict=True)), b)


def _longer(k: int):
    return lambda w: F.length(w) > k


def _start(k: int):
    return lambda w: F.concat(F.lit("^"), F.substring(w, 1, k))


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lens), np.array([i for r in rows for i in r], np.int64)


class _Loss:
    """Mean log loss + ``penalty`` * mean (score change between text and twin)^2 + ``l2`` * |w|^2 / n, and its slope.

    ``changes`` are (row, features lost, features gained): a twin's score is its text's, with what it loses and gains.
    """

    def __init__(
        self, xs: list[list[int]], y: np.ndarray, changes: list[tuple[int, list[int], list[int]]], m: int, penalty: float, l2: float
    ):
        self.row, self.col = _flat(xs)
        self.of = np.array([r for r, _, _ in changes], np.int64)
        self.lost_row, self.lost = _flat([gone for _, gone, _ in changes])
        self.won_row, self.won = _flat([new for _, _, new in changes])
        self.y, self.m, self.penalty, self.l2 = y, m, penalty, l2

    def at(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        n, p = len(self.y), len(self.of)
        z = b + np.bincount(self.row, w[self.col], n)
        s = _sigmoid(z)
        e = (s - self.y) / n
        loss = float(-np.log(np.clip(np.where(self.y == 1, s, 1 - s), 1e-300, None)).mean() + self.l2 / n * (w @ w))
        g = 2 * self.l2 / n * w
        if p:
            sa, sb = s[self.of], _sigmoid(
                z[self.of] + np.bincount(self.won_row, w[self.won], p) - np.bincount(self.lost_row, w[self.lost], p)
            )
            loss += float(self.penalty * ((sa - sb) ** 2).mean())
            d = 2 * self.penalty * (sa - sb) / p
            db = -d * sb * (1 - sb)
            e = e + np.bincount(self.of, d * sa * (1 - sa) + db, n)
            g = g + np.bincount(self.won, db[self.won_row], self.m) - np.bincount(self.lost, db[self.lost_row], self.m)
        return loss, g + np.bincount(self.col, e[self.row], self.m), float(e.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _fit(
    xs: list[list[int]],
    y: np.ndarray,
    changes: list[tuple[int, list[int], list[int]]],
    m: int,
    flat: float,
    penalty: float,
    l2: float,
    rounds: int = 1000
) -> tuple[np.ndarray, float]:
    """Full-batch Adam on ``_Loss``; the same for the same rows."""
    loss = _Loss(xs, y, changes, m, penalty, l2)
    w, b = np.zeros(m), flat
    mom, var, mom_b, var_b = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        _, g, gb = loss.at(w, b)
        rate = 0.1 if t <= rounds // 2 else 0.02
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        mom_b, var_b = 0.9 * mom_b + 0.1 * gb, 0.999 * var_b + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - rate * fix * mom / (np.sqrt(var) + 1e-8)
        b = b - rate * fix * mom_b / (np.sqrt(var_b) + 1e-8)
    return w, float(b)


def score_documents(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, from whole texts alone; a column of that name is replaced."""
    ship(docs.sparkSession)
    rows = spread(docs.drop(score))
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(set(WORD.findall((v.as_py() or "").lower()))) for v in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, score])

    return rows.mapInArrow(released(run), rows.schema.__class__(list(rows.schema.fields)).add(score, "double"))
