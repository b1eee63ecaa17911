"""Consecutive numbers for rows in a total order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import fresh_path

_PART = 33  # bits of a row's place in its partition, as monotonically_increasing_id lays them out


def numbered(rows: DataFrame, order: Sequence[str], first: int = 1, name: str = "id", stage: str | None = None) -> DataFrame:
    """``rows`` with consecutive numbers from ``first`` in ``order``; rows that agree in it come in any order.

    Rows are dealt by ranges of ``order``, sorted in each and written once to ``stage`` (a fresh path of the shared folder where none is
    given); then each file's rows start where those of the ranges before end. Only a count a range meets in one task.
    """
    spark = rows.sparkSession
    path = stage or fresh_path(spark, "numbered")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    held = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("__at", _PART)
    counts = held.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a range
    own = F.col("__at") - F.shiftleft(part, _PART)
    joined = held.join(F.broadcast(starts), part == F.col("__part"))
    return joined.withColumn(name, (F.lit(first) + F.col("__before") + own).cast("long")).drop("__at", "__part", "__before")
