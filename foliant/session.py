"""What a session needs before Python code of this library runs on executors."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What Spark takes if nobody says otherwise, and what texts need: a worker and its task hold a few batches each.
DEFAULT_BATCH, TEXT_BATCH = "67108864b", "8388608b"


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that workers import what the driver imports; and, unless the session says
    otherwise, keeps batches to workers small."""
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH:
        spark.conf.set(BATCH_BYTES, TEXT_BATCH)
    context = spark.sparkContext
    if getattr(context, "_foliant_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="foliant-")) / "foliant.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._foliant_shipped = True
    return spark


#: Bytes of input up to which rows of few files are dealt out, and bytes that are worth a task.
SMALL_INPUT, TASK_INPUT = 256 << 20, 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt evenly over the cores if they come from a few small files. A file of one row group is one task however many cores there
    are; larger inputs have more of both, and are left as they are."""
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size > SMALL_INPUT:
        return rows
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_INPUT))
    return rows if len(rows._jdf.inputFiles()) >= tasks else rows.repartition(tasks)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where a session on one machine has none (tests), a temporary folder is set; on a cluster that is an error, as
    executors would write to their own disks and a read would find nothing.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = context._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@cache
def _trim() -> Callable[[int], int]:
    """The C library's call that gives free pages back, or nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a worker that lives on after the task: what the task no longer needs goes back to the system."""

    def over(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return over
