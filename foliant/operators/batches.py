"""Resumable batches: what is left to do, what is loaded, which results win."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J08, U05."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fully_loaded(files: DataFrame, chunks: DataFrame, name: str = "source_file", count: str = "n_chunks") -> DataFrame:
    """Files that are stored with as many chunks as they have."""
    stored = chunks.groupBy(name).agg(F.count("*").alias(count))
    return files.join(stored, [name, count], "left_semi")


def reusable(rows: DataFrame, earlier: DataFrame, keys: Sequence[str] = ("id", "question")) -> DataFrame:
    """J10."""
    return rows.join(earlier.select(*keys).distinct(), list(keys), "left_semi")


def diverted(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    failed = F.trim(F.coalesce(F.col(error), F.lit(""))) != ""
    return rows.where(~failed), rows.where(failed)


def status_counts(log: DataFrame, status: str = "status") -> DataFrame:
    """A17."""
    return log.groupBy(status).agg(F.count("*").alias("n"))


def is_usable(answer: Column, flag: Column) -> Column:
    """P12."""
    return (F.coalesce(answer, F.lit("")) != "") & ~F.coalesce(flag, F.lit("")).isin("pipeline_error", "generation_error")


def merged(backup: DataFrame, live: DataFrame, key: str = "id", answer: str = "answer", flag: str = "confidence_flag") -> DataFrame:
    """Usable rows of both; the live one wins."""
    both = backup.withColumn("__p", F.lit(0)).unionByName(live.withColumn("__p", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("__p").desc(), answer)
    return both.where(is_usable(F.col(answer), F.col(flag))).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__p")


def failed_ids(backup: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Ids that were seen but have no usable row."""
    return backup.select(key).unionByName(live.select(key)).distinct().join(merged(backup, live, key), key, "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upserted(stored: DataFrame, new: DataFrame, keys: Sequence[str], keep_when_null: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace those of equal key; a column of ``keep_when_null`` keeps the first value that isn't null.
    Of several new rows the one of greatest values wins, so that a second run gives the same."""
    old = stored.withColumn("__new", F.lit(0))
    both = old.unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).cast("string").desc_nulls_last() for c in both.columns if c not in (*keys, "__new")]
    last = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *rest)
    first = Window.partitionBy(*keys).orderBy(F.col("__new"), *rest).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = both.withColumns({f"__k_{c}": F.first(c, ignorenulls=True).over(first) for c in keep_when_null})
    rows = held.withColumn("__r", F.row_number().over(last)).where("__r = 1")
    return rows.withColumns({c: F.col(f"__k_{c}") for c in keep_when_null}).select(*(c for c in both.columns if c != "__new"))


def changed(before: DataFrame, after: DataFrame, key: str = "name") -> DataFrame:
    """Names that one list of definitions has and the other lacks, as (key, ``added`` or ``removed``)."""
    old, new = before.select(key).distinct(), after.select(key).distinct()
    return new.join(old, key, "left_anti").withColumn("change", F.lit("added")).unionByName(
        old.join(new, key, "left_anti").withColumn("change", F.lit("removed"))
    )


def progress(log: DataFrame, total: int, at: str = "at", width: str = "1 minute", status: str = "status") -> DataFrame:
    """By stretch of time the entries of a log, those that failed, and how many of ``total`` are done until then."""
    parts = log.groupBy(F.window(F.col(at).cast("timestamp"), width)["start"].alias("since")).agg(
        F.count("*").alias("n"), F.count_if(F.col(status) == "error").alias("errors")
    )
    so_far = Window.orderBy("since").rowsBetween(Window.unboundedPreceding, 0)  # a row a stretch
    return parts.select(
        "since",
        "n",
        "errors",
        F.sum("n").over(so_far).alias("done"),
        F.round(100.0 * F.sum("n").over(so_far) / F.lit(float(total)), 4).alias("pct")
    )
