"""Pairs of words whose Ratcliff-Obershelp similarity reaches a threshold, without comparing all words with all.

The similarity of words of n and m letters is 2 * M / (n + m), M being the letters in their matching blocks, which lie in the same order in both. So a
threshold sets the least M for each pair of lengths, and what isn't matched, d = n + m - 2 * M letters at most, can break d of d + 1 pieces of
either word: one of them stands whole in the other, moved by no more than the letters left out or put in before it. Words meet by (lengths, number of the
piece, piece). Those that met also need M letters in common, in any order, and, as the blocks keep their order, d changes of a letter at most that make one
word of the other, before their blocks are looked for. No pair that reaches the threshold is lost.

Null words meet nothing; the empty word is like itself alone. Words that come again count once. Where d + 1 pieces would be more than the word's letters
(thresholds far below a half, and words of a letter), all words of those two lengths meet. Pieces of a word grow with the square of its letters, so what
is longer than ``LONG``, no word of a language, meets all that is about as long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import ship

_EPS = 1e-9  # what a product of the threshold may be off
LONG = 48


def _least(n: Column, m: Column, threshold: float) -> Column:
    """Matching letters that words of ``n`` and ``m`` letters need."""
    return F.ceil((n + m) * (threshold / 2) - _EPS).cast("int")


def _partners(n: Column, threshold: float) -> Column:
    """Lengths up to ``LONG`` of words that a word of ``n`` letters, no more than that, can be like."""
    short = threshold / (2 - threshold)
    return F.sequence(F.ceil(n * short - _EPS).cast("int"), F.least(F.floor(n / short + _EPS).cast("int"), F.lit(LONG)))


def _pieces(n: Column, m: Column, threshold: float) -> Column:
    """Pieces of a word of ``n`` letters that meets one of ``m``: (number, start, length); one empty piece where there are too few letters."""
    k = n + m - 2 * _least(n, m, threshold) + 1
    at = lambda i: F.floor(i * n / k).cast("int")
    whole = F.transform(
        F.sequence(F.lit(0), k - 1),
        lambda i: F.struct(i.cast("int").alias("i"), at(i).alias("start"), (at(i + 1) - at(i)).alias("size"))
    )
    none = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("size")))
    return F.when(k <= n, whole).otherwise(none)


def shared_letters(a: Column, b: Column) -> Column:
    """Letters that two words have in common, in any order, each as often as in the word that has fewer."""
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    letters = F.array_distinct(F.split(a, ""))
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))


def candidates(left: DataFrame, right: DataFrame, threshold: float, distinct_from: bool = False) -> DataFrame:
    """Distinct (p, q) of the words ``left.p`` and ``right.q`` that may reach the threshold; with ``distinct_from`` only those with p < q."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies over 0 and is 1 at most")
    p, q, n, m = (F.col(x) for x in ("p", "q", "n", "m"))
    # Few bytes that become many pieces: dealt out before they are cut, by word and length, as by words alone they lie already, in one task.
    tasks = _tasks(left)
    a = left.select("p").where("p IS NOT NULL").distinct().withColumn("n", F.length("p")).repartition(tasks, "p", "n").withColumn("has_p", _marks(p))
    b = right.select("q").where("q IS NOT NULL").distinct().withColumn("m", F.length("q")).repartition(tasks, "q", "m").withColumn("has_q", _marks(q))
    met = _by_pieces(a, b, threshold).unionByName(_by_length(a, b, threshold))
    if distinct_from:
        met = met.where(p < q)
    least = _least(n, m, threshold)
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    met = met.where((lacks("has_p", "has_q") <= n - least) & (lacks("has_q", "has_p") <= m - least))
    met = met.where(F.call_function("levenshtein", p, q, n + m - 2 * least) >= 0).select("p", "q", "n", "m")  # -1 where there are more
    once = met.repartition(tasks, "p", "q").dropDuplicates(["p", "q"])
    return once.where(shared_letters(p, q) >= least).select("p", "q")


def _tasks(rows: DataFrame) -> int:
    """Tasks for what is small in bytes and long in work, which adaptive execution would put into one."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _marks(word: Column) -> Column:
    """A bit for each letter and each time that it comes, of 64; letters may fall on one bit, so words differ in as many letters as in bits or in more."""
    letters = F.array_sort(F.filter(F.split(F.when(F.length(word) <= LONG, word).otherwise(""), ""), lambda c: c != ""))
    bit = lambda of, c, i: F.pmod(F.hash(c, i - F.array_position(of, c)), F.lit(64))
    one = F.lit(1).cast("long")
    marked = lambda of: F.aggregate(
        F.transform(of, lambda c, i: F.call_function("shiftleft", one, bit(of, c, i))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y)
    )
    return F.get(F.transform(F.array(letters), marked), 0)  # sorted once a word


def _by_pieces(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Words up to ``LONG`` that share a piece, a pair once for each. The words ``q``, which are the more where names meet a vocabulary, are cut; of the words
    ``p`` all places of a piece are listed. Lengths that no ``p`` has are left out: there are ``LONG`` of them at most to broadcast."""
    n, m, keys = F.col("n"), F.col("m"), ["n", "m", "i", "piece"]
    a, b = a.where(n <= LONG), b.where(m <= LONG)
    b = b.withColumn("n", F.explode(_partners(m, threshold))).join(F.broadcast(a.select("n").distinct()), "n", "left_semi")
    b = b.withColumn("s", F.explode(_pieces(m, n, threshold)))
    b = b.select("q", "has_q", "n", "m", "s.i", F.substring("q", F.col("s.start") + 1, F.col("s.size")).alias("piece"))
    a = a.withColumn("m", F.explode(_partners(n, threshold))).withColumn("s", F.explode(_pieces(m, n, threshold)))
    start, size, least = F.col("s.start"), F.col("s.size"), _least(n, m, threshold)
    low, high = F.greatest(F.lit(0), start - (m - least)), F.least(n - size, start + (n - least))
    places = F.when(size == 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high))
    pieces = F.array_distinct(F.transform(places, lambda at: F.substring(F.col("p"), at + 1, size)))
    a = a.select("p", "has_p", "n", "m", "s.i", F.explode(pieces).alias("piece"))
    return a.repartition(_tasks(a), *keys).join(b.repartition(_tasks(a), *keys), keys).select("p", "q", "n", "m", "has_p", "has_q")


def _by_length(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Words of which one at least is longer than ``LONG``, in bands of length."""
    n, m, short = F.col("n"), F.col("m"), threshold / (2 - threshold)
    band = lambda x: F.floor(F.log(x) / F.log(F.lit(max(1 / short, 1.5) * 1.001)))
    a = a.where(n > LONG * short - 1).withColumn("band", band(n))
    b = b.where(m > LONG * short - 1).withColumn("band", F.explode(F.array(*(band(m) + i for i in (-1, 0, 1)))))
    near = (F.greatest("n", "m") > LONG) & (F.least("n", "m") >= F.greatest("n", "m") * short - _EPS)
    return a.join(b, "band").where(near).select("p", "q", "n", "m", F.lit(0).cast("long").alias("has_p"), F.lit(0).cast("long").alias("has_q"))


def _alike(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ratio = [SequenceMatcher(None, x, y).ratio() for x, y in zip(p, q, strict=True)]
            kept = pa.array([i for i, r in enumerate(ratio) if r >= threshold], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.take(kept).columns, pa.array(ratio, pa.float64()).take(kept)], names=["p", "q", "ratio"])

    return run


def similar_words(left: DataFrame, right: DataFrame, threshold: float, distinct_from: bool = False) -> DataFrame:
    """(p, q, ratio) of all words ``left.p`` and ``right.q`` whose similarity reaches the threshold."""
    ship(left.sparkSession)
    # Not a column function with a filter: Spark would compare each time that a pair meets, before pairs that come again are dropped.
    return candidates(left, right, threshold, distinct_from).mapInArrow(_alike(threshold), "p string, q string, ratio double")
