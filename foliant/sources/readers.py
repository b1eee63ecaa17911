"""Sources: PDF listings and pages, page caches, chunk files, CSV logs, tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import clean_int
from foliant.session import ship
from foliant.sources.schemas import BUCKETED, CHUNK_FILE, PAGES, TABLES, in_buckets


def pdf_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """PDF files under a folder with path and size (and content), by path. Endings in capitals don't count."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    return rows.select("path", "length", *(["content"] if content else [])).orderBy("path")


def pages_of(files: DataFrame, extract: Callable[[bytes], list[str]], first: int = 1, last: int | None = None) -> DataFrame:
    """(path, page_number, text, error) of files with content. ``extract`` turns a PDF into the texts of its pages; a file that
    fails gives one row with its error and stops nothing."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts = extract(bytes(content))
                    rows += [(path, i, t, None) for i, t in enumerate(texts, 1) if i >= first and (last is None or i <= last)]
                except Exception as e:  # a file's failure is a row of the result
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error"]).astype({"page_number": "Int32"})

    return files.select("path", "content").mapInPandas(run, f"{PAGES}, error STRING")


def page_cache(spark: SparkSession, path: str) -> DataFrame:
    """S03."""
    return spark.read.schema(PAGES).json(path).orderBy("path", "page_number")


def listing(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files under a folder of any store as (key, size), a key being the path below the folder; with their content if asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")
    prefix = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/") + "/"
    return rows.select(
        F.substring(below, len(prefix) + 1, 1 << 30).alias("key"), F.col("length").alias("size"), *(["content"] if content else [])
    )


def to_download(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote objects (key, size) without a local file of their size."""
    return remote.join(local.select("key", "size"), ["key", "size"], "left_anti")


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files as written, with the file each row came from. Files that can't be read are passed over."""
    return spark.read.schema(CHUNK_FILE).option("ignoreCorruptFiles", True).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file")
    )


def chunk_file_status(spark: SparkSession, path: str) -> DataFrame:
    """S05's isolation: (file, n_rows, error) of each chunk file, by file; a file that can't be read has its error and stops nothing."""
    files = ship(spark).read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        wanted = {"text", "source_file", "embedding"}
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    file = pq.ParquetFile(pa.BufferReader(content))
                    lacking = wanted - set(file.schema_arrow.names)
                    n = sum(b.num_rows for b in file.iter_batches(8192))  # a broken page shows only when it is read
                    rows.append((name, n, f"ValueError: no column {sorted(lacking)}" if lacking else None))
                except Exception as e:  # a file's failure is a row of the result
                    rows.append((name, None, f"{type(e).__name__}: {str(e)[:500]}"))
            yield pd.DataFrame(rows, columns=["file", "n_rows", "error"]).astype({"n_rows": "Int64"})

    return files.select("path", "content").mapInPandas(run, "file string, n_rows long, error string").orderBy("file")


def as_chunks(rows: DataFrame) -> DataFrame:
    """Chunk-file rows as store rows. NaN is null; a missing year is 0, a missing name empty; the mismatch keeps its null. Chunks
    are numbered by their stored number, then page and text, from 0 in each file."""
    m = "metadata"
    text = lambda c: F.coalesce(c, F.lit(""))
    place = F.row_number().over(
        Window.partitionBy("source_file").orderBy(F.col("chunk_index").try_cast("int").asc_nulls_last(), "page_start", "text")
    ) - 1
    return rows.select(
        text(F.col("source_file")).alias("source_file"),
        place.alias("chunk_index"),
        text(F.col("text")).alias("content"),
        F.length(text(F.col("text"))).alias("n_chars"),
        "embedding",
        text(F.col(f"{m}.ticker")).alias("ticker"),
        text(F.col(f"{m}.company")).alias("company"),
        F.coalesce(clean_int(F.col(f"{m}.fiscal_year")), F.lit(0)).alias("fiscal_year"),
        F.col(f"{m}.form_type").alias("form_type"),
        F.col(f"{m}.accounting_standard").alias("accounting_standard"),
        F.col(f"{m}.canonical_section").alias("canonical_section"),
        clean_int(F.col("page_start")).alias("page_start"),
        clean_int(F.col("page_end")).alias("page_end"),
        F.col(f"{m}.numeric_density").cast("float").alias("numeric_density"),
        F.col(f"{m}.company_name_mismatch").alias("company_name_mismatch"),
    )


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header, quoted newlines and a given schema; nothing is inferred, so an id stays a string."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the store."""
    if table in BUCKETED:
        return in_buckets(spark, folder, table).read()
    return spark.read.schema(TABLES[table]).parquet(f"{folder}/{table}")


def by_id(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """S07."""
    return rows.where(F.col(key) == value)


def companies(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (ticker, company), in order."""
    out = rows.select("ticker", "company").distinct().orderBy("company", "ticker")
    return out.limit(limit) if limit else out


def databases(spark: SparkSession) -> DataFrame:
    """Tables of the session's catalogue with their columns: (table, column, type, place)."""
    rows = [(t.name, c.name, c.dataType, i) for t in spark.catalog.listTables() for i, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table string, column string, type string, place int")


def catalog(rows: DataFrame) -> list[tuple[str, str, bool]]:
    """A table's columns with type and whether they may be null."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema.fields]
