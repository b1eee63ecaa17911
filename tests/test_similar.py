"""Similar words: the same pairs as comparing all with all, from far fewer comparisons."""

import random
from difflib import SequenceMatcher
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foliant.operators import similar


def words_of(spark, words, name):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def brute(a, b, t):
    pairs = {(x, y) for x in a for y in b if x is not None and y is not None}
    return {(x, y): r for x, y in pairs if (r := SequenceMatcher(None, x, y).ratio()) >= t}


def found(spark, a, b, t):
    rows = similar.similar_words(words_of(spark, a, "p"), words_of(spark, b, "q"), t).collect()
    assert len({(r.p, r.q) for r in rows}) == len(rows)
    return {(r.p, r.q): r.ratio for r in rows}


@pytest.mark.parametrize("t", [0.3, 0.8, 0.95, 1.0])
def test_no_pair_is_lost(spark, t):
    rng = random.Random(str(t))
    words = ["".join(rng.choices("abcé𝒳", k=rng.randint(0, 12))) for _ in range(160)]
    words += [w[:i] + rng.choice(["", "a", "bc"]) + w[i + rng.randint(0, 2) :] for w in words for i in [rng.randint(0, len(w))]]
    words += [c * rng.randint(44, 52) + "z" * rng.randint(0, 9) for c in "ab" for _ in range(6)]
    a, b = words[::3], words[1:]
    assert found(spark, a, b, t) == brute(a, b, t)


def test_nulls_repeats_empty_and_long_words(spark):
    a = ["", None, "ab", "ab", "x" * 3000, "a.b\\d+"]
    b = ["", None, "ab", "ba", "x" * 2999 + "y", "a.b\\d+", "x" * 150 + "y" * 30]
    assert found(spark, a, b, 0.8) == brute(a, b, 0.8)
    assert found(spark, [], b, 0.8) == found(spark, a, [None], 0.8) == {}
    for t in (0, 1.1):
        with pytest.raises(ValueError):
            found(spark, a, b, t)


def test_words_of_documents(spark):
    """All words of the documents against some that are asked for; candidates are few."""
    split = F.split(F.lower("text"), r"[^\p{L}]+")
    words = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(split).alias("q")).where("q <> ''").distinct()
    known = sorted(r.q for r in words.collect())
    asked = known[:: len(known) // 15] + ["thanedbel", "therecihng"]
    got = found(spark, asked, known, 0.8)
    assert got == brute(asked, known, 0.8) and len(got) > len(asked)
    met = similar.candidates(words_of(spark, asked, "p"), words, 0.8).count()
    by_length = sum(2 * len(x) <= 3 * len(y) and 2 * len(y) <= 3 * len(x) for x in asked for y in known)
    assert met < by_length / 10, (met, by_length, len(got))


def test_order_of_letters_cuts_candidates(spark):
    """words of the same syllables in another order share all letters and many pieces; they aren't compared, and no word is, each time that it meets another."""
    syllables = ("tan", "ren", "dal", "vic", "nok")
    words = sorted("".join(p) for n in (4, 5) for p in permutations(syllables, n)) + ["tanrendalvi", "tanrendalvick"]
    got = found(spark, words, words, 0.8)
    assert got == brute(words, words, 0.8)
    w = words_of(spark, words, "p")
    met = similar.candidates(w, w.withColumnRenamed("p", "q"), 0.8).count()
    assert met <= 2 * len(got), (met, len(got))
    plan = similar.similar_words(w, w.withColumnRenamed("p", "q"), 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence_ratio" not in plan and plan.index("MapInArrow") < plan.index("Aggregate")
