"""Sinks: staged table writes, chunk loads, deletes, logs and reports.

Documents, chunks and chat events are kept in buckets (``buckets``), where a change is one commit. The other tables are single folders: a table is
written to a folder of its own beside the old one and then takes its place by two renames. A run that dies before them leaves the old table; one that dies between them leaves it under its ``.old-`` name, from which
``recovered`` (called by each delete) brings it back. Repeating a load gives the same table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.vectors import checked
from foliant.operators.batches import latest
from foliant.operators.numbering import numbered
from foliant.session import fresh_path, ship
from foliant.sources.readers import listing, stored, to_download
from foliant.sources.schemas import BUCKETED, in_buckets


#: Quotes are doubled and spaces kept, as ``readers.csv`` and others read them.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def recovered(spark: SparkSession, path: str) -> bool:
    """Brings back the old table where a run died between the renames of ``replace_table``; whether it did."""
    at, store = _place(spark, path)
    if store.exists(at):
        return False
    old = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old-*"))
    if not old:
        return False
    return bool(store.rename(max((x for x in old), key=lambda x: x.getModificationTime()).getPath(), at))


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Writes beside ``path``, then swaps."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(new)
    at, store = _place(spark, path)
    if store.exists(at):
        store.rename(at, _place(spark, old)[0])
    store.rename(_place(spark, new)[0], at)
    store.delete(_place(spark, old)[0], True)


def load_chunks(spark: SparkSession, folder: str, chunks: DataFrame, dimension: int) -> list[int]:
    """Chunks of any number of documents. A document that comes again replaces its row and all its chunks. Numbers of documents and
    chunks follow the order of source file and place, after those that are kept. The buckets of chunks that were rewritten: those of documents that
    came again; where all are new both tables are appended to.

    Chunks are committed before documents, so a run that dies between them is one whose documents aren't loaded yet; loading them again replaces the chunks.
    """
    stages = [fresh_path(spark, what) for what in ("numbered", "numbered", "known")]
    good = chunks.withColumn("embedding", checked(F.col("embedding"), dimension))
    docs, old = stored(spark, folder, "documents"), stored(spark, folder, "rag_chunks")
    fields = ("source_file", "company", "ticker", "fiscal_year", "form_type", "accounting_standard")
    one = latest(good, ["source_file"], [F.col("chunk_index")]).select(*fields).withColumn("indexed_at", F.current_timestamp())
    one.join(docs.select("source_file", "id", "company_id"), "source_file", "left").write.parquet(stages[2])
    known = spark.read.parquet(stages[2])  # what is loaded may hang on the store, so it is settled before that changes
    top = docs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(known.where("id IS NULL").drop("id"), ["source_file"], top + 1, stage=stages[0])
    ids = known.where("id IS NOT NULL").unionByName(fresh)
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = good.join(ids.select("source_file", F.col("id").alias("document_id")), "source_file").withColumn("created_at", F.current_timestamp())
    rows = _filled(numbered(added, ["source_file", "chunk_index"], top + 1, stage=stages[1]), old)
    hit = in_buckets(spark, folder, "rag_chunks").upsert(rows)
    in_buckets(spark, folder, "documents").upsert(_filled(ids, docs))
    for path in stages:
        at, store = _place(spark, path)
        store.delete(at, True)
    return hit


def _filled(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``like``; missing ones are null."""
    return rows.select(
        *((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields)
    )


def delete_all(spark: SparkSession, folder: str) -> int:
    """Empties documents and chunks; the number of documents there were."""
    n = stored(spark, folder, "documents").count()
    for name in ("rag_chunks", "documents"):
        in_buckets(spark, folder, name).clear()
    return n


def delete_where(spark: SparkSession, folder: str, table: str, condition: Column) -> int:
    """Drops the rows for which the condition holds (a null keeps a row); how many. Of a table in buckets only those that hold such rows are rewritten."""
    if table in BUCKETED:
        return in_buckets(spark, folder, table).delete_where(condition)
    recovered(spark, f"{folder}/{table}")
    rows = stored(spark, folder, table)
    gone = F.coalesce(condition, F.lit(False))
    n = rows.where(gone).count()
    replace_table(rows.where(~gone), f"{folder}/{table}")
    return n


def append_log(rows: DataFrame, path: str) -> None:
    """Each run's rows as files of their own, each with a header."""
    rows.write.mode("append").options(**CSV).csv(path)


def write_json(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """S12."""
    rows.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    rows.coalesce(1).write.mode("overwrite").options(**CSV).csv(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a table of text; one of more than ``limit`` rows is an error."""
    head = rows.limit(limit + 1).collect()
    if len(head) > limit:
        raise ValueError(f"a result of over {limit} rows is no small one")
    line = lambda xs: "| " + " | ".join(str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(rows.columns), line("---" for _ in rows.columns), *(line(r) for r in head)])


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, wherever Spark can write; an old one is replaced."""
    at, store = _place(spark, path)
    out = store.create(at, True)
    try:
        out.write(content)
    finally:
        out.close()


def downloaded(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copies the files of ``source`` that ``target`` (a URI that all executors reach) lacks or has with another size, in parallel; (key, size, error)
    of what was to be copied, as a written table. A second run copies nothing."""
    ship(spark)
    todo = to_download(
        listing(spark, source),
        listing(spark, target) if _place(spark, target)[1].exists(_place(spark, target)[0]) else spark.createDataFrame(
            [], "key string, size long"
        )
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(target)
        for batch in batches:
            rows = []
            for key, size, content in zip(batch["key"], batch["size"], batch["content"], strict=True):
                try:
                    store.create_dir(f"{base}/{key}".rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(f"{base}/{key}") as out:
                        out.write(content)
                    rows.append((key, size, None))
                except Exception as e:  # a file's failure is a row of the result
                    rows.append((key, size, f"{type(e).__name__}: {str(e)[:500]}"))
            yield pd.DataFrame(rows, columns=["key", "size", "error"])

    path = fresh_path(spark, "downloaded")
    files = listing(spark, source, content=True).join(F.broadcast(todo) if todo.count() <= 100_000 else todo, ["key", "size"], "left_semi")
    files.select("key", "size", "content").mapInPandas(run, "key string, size long, error string").write.parquet(path)
    return spark.read.parquet(path)


def laid_out(chunks: DataFrame, path: str) -> None:
    """The layout that stands in for indexes: a folder a year, files sorted by company, so filters prune both."""
    chunks.repartitionByRange("fiscal_year", "company").sortWithinPartitions(
        "fiscal_year", "company", "ticker"
    ).write.mode("overwrite").partitionBy("fiscal_year").parquet(path)


def analyzed(spark: SparkSession, table: str, columns: Sequence[str] = ()) -> None:
    """Statistics of a catalogue table, for the optimizer: rows and bytes, and where asked for those of columns."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else ""))


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """A query's plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
