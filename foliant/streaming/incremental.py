"""Incremental runs: each input is taken once, results are appended, and a second run adds nothing.

``ingest`` and ``process_new`` express resumable batches as file streams with a checkpoint. Windows over event time are an extension.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliant.sources.buckets import BucketTable


def process_new(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    transform: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str
) -> StreamingQuery:
    """Applies ``transform`` to the Parquet files that came since the last run, appends the result, and ends."""
    rows = spark.readStream.schema(schema).parquet(source)
    return transform(rows).writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()


def ingest(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    load: Callable[[DataFrame, int], None],
    checkpoint: str,
    files_per_batch: int = 100
) -> StreamingQuery:
    """Hands each batch of new files to ``load``, which must give the same store when a batch comes again; ``files_per_batch`` of 1 is
    for loads that an outside limit may stop."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class QuotaSpent(Exception):
    """An outside service takes no more for now: the run ends, and the next one goes on with the same batch."""


class TimedOut(Exception):
    """A batch took too long: it is left out, and the run goes on."""


#: What errors of services say when a quota is spent.
QUOTA_MARKERS = ("RESOURCE_EXHAUSTED", "429", "quota", "ResourceExhausted", "GenerateRequestsPerDayPerProjectPerModel")


def kind_of(error: BaseException) -> str:
    """``quota``, ``timeout`` or ``error``."""
    said = str(error).lower()
    if isinstance(error, QuotaSpent) or any(m.lower() in said for m in QUOTA_MARKERS):
        return "quota"
    if isinstance(error, (TimedOut, TimeoutError)) or "timeout" in type(error).__name__.lower() or "timeout" in said:
        return "timeout"
    return "error"


ATTEMPTS = "item STRING, at TIMESTAMP, outcome STRING"


def _attempts(spark: SparkSession, checkpoint: str) -> BucketTable:
    log = BucketTable(spark, f"{checkpoint}-attempts/log", ATTEMPTS, "item", ("at",), 8)
    log.create()
    return log


def attempts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(item, attempts, outcome) of every batch that has timed out: how often it was tried, and how that ended last (``timeout``, ``done`` or ``dead``)."""
    tried = F.count_if(F.col("outcome") != "dead").alias("attempts")
    # A batch that is given up is so for good, at whatever moment.
    last = F.max_by("outcome", F.struct(F.col("outcome") == "dead", "at", F.col("outcome") == "done")).alias("outcome")
    return _attempts(spark, checkpoint).read().groupBy("item").agg(tried, last)


def _held(spark: SparkSession, checkpoint: str, schema: StructType | str, items: list[str]) -> DataFrame:
    if not items:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{checkpoint}-attempts/held/{i}" for i in items))


def dead_letters(spark: SparkSession, checkpoint: str, schema: StructType | str) -> DataFrame:
    """Rows of the batches that were given up."""
    return _held(spark, checkpoint, schema, [r.item for r in attempts(spark, checkpoint).where("outcome = 'dead'").collect()])


def run_batches(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    load: Callable[[DataFrame, int], None],
    checkpoint: str,
    files_per_batch: int = 1,
    max_attempts: int = 3
) -> dict[str, int | bool]:
    """``ingest`` to its end, for loads that call a service with limits. A spent quota ends the run, and its batch comes first in the next
    one; a batch that times out is passed over and kept beside the checkpoint, with a log of its attempts, and comes first in the next run. One that has timed out
    ``max_attempts`` times is given up, and its rows are ``dead_letters``. ``source`` is only read. Any other error is raised. How many batches were
    done, passed over and given up, and whether a quota ended the run."""
    outcome: dict[str, int | bool] = {"done": 0, "skipped": 0, "dead": 0, "quota": False}
    log = _attempts(spark, checkpoint)

    def note(item: str, what: str) -> None:
        log.append(spark.createDataFrame([(item, datetime.now(timezone.utc).replace(tzinfo=None), what)], ATTEMPTS))

    def timed_out(error: Exception) -> bool:
        kind = kind_of(error)
        outcome["quota"] = kind == "quota"
        return kind == "timeout"

    waiting = attempts(spark, checkpoint).where("outcome = 'timeout'").collect()
    for r in sorted(waiting, key=lambda r: int(r.item)):  # one for each batch that has timed out
        if r.attempts >= max_attempts:
            note(r.item, "dead")  # a run that died before it could say so
            outcome["dead"] += 1
            continue
        try:
            load(_held(spark, checkpoint, schema, [r.item]), int(r.item))
        except Exception as e:
            if not timed_out(e):
                if outcome["quota"]:
                    return outcome
                raise
            note(r.item, "timeout")
            outcome["skipped"] += 1
            if r.attempts + 1 >= max_attempts:
                note(r.item, "dead")
                outcome["dead"] += 1
            continue
        note(r.item, "done")
        outcome["done"] += 1

    def guarded(batch: DataFrame, number: int) -> None:
        try:
            load(batch, number)
        except Exception as e:
            if not timed_out(e):
                raise
            batch.write.mode("overwrite").parquet(f"{checkpoint}-attempts/held/{number}")
            note(str(number), "timeout")
            outcome["skipped"] += 1
            return
        outcome["done"] += 1

    query = ingest(spark, source, schema, guarded, checkpoint, files_per_batch)
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not outcome["quota"]:
            raise
    return outcome


def event_windows(
    events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour", ts: str = "ts", key: str = "event_type"
) -> DataFrame:
    """Extension: counts and sums by event-time window; rows later than ``late`` are dropped when streaming."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    return timed.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total"
    )


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Extension: sessions of a user, ended by a gap."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )
