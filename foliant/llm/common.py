"""What the operators of this subpackage share: tables, the shared folder, and cut lineage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import fresh_path

#: Bytes of values up to which a table is sent to all executors.
BROADCAST_BYTES = 64 << 20
#: Bytes of values in a file of a written table of known size.
FILE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str, at: list[str] | None = None, size: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and lost with no executor. Its path is added to ``at``.

    Where the caller knows about how many bytes it has, ``size``, a table that comes out of a shuffle is written as files of ``FILE_BYTES``: small
    tables would else be a file for each shuffle partition.
    """
    path = fresh_path(df.sparkSession, what)
    (df if size is None else df.coalesce(max(1, -(-size // FILE_BYTES)))).write.parquet(path)
    if at is not None:
        at.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that no plan reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """A list for ``written``; its tables go when the block ends, well or not."""
    paths: list[str] = []
    try:
        yield paths
    finally:
        removed(spark, paths)


def fits(rows: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the values of a written table take at most ``most`` bytes, so that it may be sent to all executors."""
    each = F.lit(16)
    for f in rows.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            each = each + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind in ("array", "struct", "map"):
            each = each + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            each = each + 16
    return (rows.agg(F.sum(each.cast("long"))).first()[0] or 0) <= most


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest_of(text: Column) -> Column:
    """Sixteen bytes that tell a text; a missing one counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
