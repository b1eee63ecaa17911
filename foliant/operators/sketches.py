"""Profiles that merge: a load leaves sketches and sums of its rows, a question over any loads merges those and reads no row again.

Per group a load keeps the count of rows, and for each column its sum, least and greatest value, a HyperLogLog sketch of its distinct values and a KLL
sketch of its quantiles. ``exact_quantiles`` is the exact way: it narrows the range that holds a quantile by such sketches, pass by pass.

Nulls count as rows and as nothing else; NaN is no number here. A group or a load without rows leaves nothing; a column without values has null everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base-two logarithm of a HyperLogLog sketch's registers: a relative error of 0.8 % is one standard deviation.
LG_K = 14
#: Size of a KLL sketch: ranks are off by about 0.3 % of the rows.
KLL_K = 1000
#: Distinct values among which ``exact_quantiles`` ranks in one task.
FEW = 10_000


def sketched(rows: DataFrame, keys: Sequence[str], distinct: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """A row a group of ``keys``: ``n``, ``distinct_<c>`` for each of ``distinct``, and ``<c>_sum``, ``_least``, ``_most`` and ``_kll`` for each of ``numbers``."""
    made = [F.count("*").alias("n"), *(F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"distinct_{c}") for c in distinct)]
    for c in numbers:
        x = _number(F.col(c))
        made += [
            F.sum(x).alias(f"{c}_sum"),
            F.count(x).alias(f"{c}_n"),
            F.min(x).alias(f"{c}_least"),
            F.max(x).alias(f"{c}_most"),
            F.kll_sketch_agg_double(x, KLL_K).alias(f"{c}_kll")
        ]
    return rows.groupBy(*keys).agg(*made)


def _number(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def keep(sketches: DataFrame, path: str, load: str) -> None:
    """Writes the sketches of one load; a load that comes again takes the place of its own."""
    sketches.write.mode("overwrite").parquet(f"{path}/load={load}")


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all loads, with ``load``."""
    return spark.read.parquet(path)


def merged(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """What ``sketched`` would give of all rows behind ``sketches``, by ``keys``, which may be fewer than they were."""
    made = [F.sum("n").alias("n"), *(F.hll_union_agg(f"distinct_{c}").alias(f"distinct_{c}") for c in distinct)]
    for c in numbers:
        made += [F.sum(f"{c}_{x}").alias(f"{c}_{x}") for x in ("sum", "n")]
        made += [F.min(f"{c}_least").alias(f"{c}_least"), F.max(f"{c}_most").alias(f"{c}_most"), F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll")]
    return sketches.groupBy(*keys).agg(*made)


def estimates(sketches: DataFrame, keys: Sequence[str], distinct: Sequence[str], numbers: Sequence[str], quantile: float = 0.5) -> DataFrame:
    """Sketches as figures: ``distinct_<c>`` and ``<c>_quantile`` are estimates, ``n``, ``<c>_mean``, ``_least`` and ``_most`` are exact."""
    out = [F.hll_sketch_estimate(f"distinct_{c}").alias(f"distinct_{c}") for c in distinct]
    for c in numbers:
        some = F.col(f"{c}_n") > 0
        out += [
            F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")).alias(f"{c}_mean"),
            F.col(f"{c}_least"),
            F.col(f"{c}_most"),
            F.when(some, F.kll_sketch_get_quantile_double(F.when(some, F.col(f"{c}_kll")), F.lit(quantile))).alias(f"{c}_quantile")
        ]
    return sketches.select(*keys, "n", *out)


def exact_quantiles(rows: DataFrame, column: str, quantiles: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles as ``percentile`` gives them, without bringing all distinct values to one task: each pass reads the rows within a range,
    whose ends a sketch chooses and a count proves, until it holds ``FEW`` distinct values at most. A pass leaves some hundredth of the rows."""
    x = _number(F.col(column))
    values = rows.select(x.alias("x")).where("x IS NOT NULL")
    n, least, most = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if n == 0:
        return [None] * len(quantiles)

    def at(rank: int) -> float:
        """The value of a rank, from 0."""
        low, high, below = least, most, 0
        while low < high:
            inside = values.where((F.col("x") >= low) & (F.col("x") <= high))
            size, different, kll = inside.agg(F.count("*"), F.approx_count_distinct("x"), F.kll_sketch_agg_double("x", KLL_K)).first()
            if different <= FEW:
                # counted exactly: the sketch only says that they are few enough for one task
                counts = inside.groupBy("x").agg(F.count("*").alias("k"))
                upto = F.sum("k").over(Window.orderBy("x"))
                return counts.withColumn("upto", upto).where(F.col("upto") > rank - below).orderBy("x").first()["x"]
            share, one = (rank - below) / size, values.sparkSession.range(1)
            ends = [min(1.0, max(0.0, share + d)) for d in (-0.01, 0.01)]
            a, b = one.select(*(F.kll_sketch_get_quantile_double(F.lit(bytes(kll)), F.lit(e)) for e in ends)).first()
            under, upto = inside.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x") <= b)).first()
            if rank - below < under:
                high = inside.where(F.col("x") < a).agg(F.max("x")).first()[0]
            elif rank - below >= upto:
                low, below = inside.where(F.col("x") > b).agg(F.min("x")).first()[0], below + upto
            elif (a, b) == (low, high):  # both ends are so frequent that the sketch goes no further
                first, last = inside.agg(F.count_if(F.col("x") == low), F.count_if(F.col("x") == high)).first()
                if rank - below < first:
                    return low
                if rank - below >= size - last:
                    return high
                between = inside.where((F.col("x") > low) & (F.col("x") < high))
                low, high, below = *between.agg(F.min("x"), F.max("x")).first(), below + first
            else:
                low, high, below = a, b, below + under
        return low

    out = []
    for q in quantiles:
        place = q * (n - 1)
        down, up = int(place), min(n - 1, int(place) + (place > int(place)))
        v = at(down)
        w = v if up == down else at(up)
        out.append(v if v == w else (up - place) * v + (place - down) * w)
    return out
