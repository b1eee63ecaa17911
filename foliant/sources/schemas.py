"""Schemas of the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.buckets import BucketTable

_SOURCE = "chunk_id STRING, company STRING, ticker STRING, fiscal_year INT, form_type STRING, accounting_standard STRING, canonical_section STRING, source_file STRING, page_start INT, page_end INT, relevance_score DOUBLE, content STRING, text_snippet STRING, company_name_mismatch BOOLEAN"

TABLES = {
    "users": "id BIGINT, email STRING, username STRING, password_hash STRING, is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP",
    "conversations": "id STRING, user_id BIGINT, title STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "chat_messages": f"id BIGINT, conversation_id STRING, role STRING, content STRING, sources ARRAY<STRUCT<{_SOURCE}>>, confidence_flag STRING, retrieval_meta STRING, created_at TIMESTAMP",
    "message_feedback": "id BIGINT, message_id BIGINT, conversation_id STRING, rating STRING, reason STRING, user_id BIGINT, created_at TIMESTAMP",
    "companies": "id BIGINT, ticker STRING, company STRING",
    "documents": "id BIGINT, company_id BIGINT, source_file STRING, company STRING, ticker STRING, fiscal_year INT, form_type STRING, accounting_standard STRING, indexed_at TIMESTAMP",
    "rag_chunks": "id BIGINT, document_id BIGINT, chunk_index INT, content STRING, n_chars INT, embedding ARRAY<FLOAT>, ticker STRING, company STRING, fiscal_year INT, form_type STRING, accounting_standard STRING, canonical_section STRING, source_file STRING, page_start INT, page_end INT, numeric_density FLOAT, company_name_mismatch BOOLEAN, created_at TIMESTAMP",
}
#: One event a turn, feedback or message; ids are made by clients. The table is made by whoever keeps one.
CHAT_EVENTS = "event_id STRING, conversation_id STRING, kind STRING, at TIMESTAMP, user_id BIGINT, messages ARRAY<STRUCT<role: STRING, content: STRING, confidence_flag: STRING>>, message_id BIGINT, rating STRING, reason STRING"
#: Tables that documents and conversations are replaced in or added to: key, and what orders a key's rows.
BUCKETED = {"documents": ("source_file", ()), "rag_chunks": ("source_file", ("chunk_index",)), "chat_events": ("conversation_id", ("at",))}
CHUNK_FILE = "text STRING, source_file STRING, page_start DOUBLE, page_end DOUBLE, embedding ARRAY<FLOAT>, chunk_index STRING, metadata STRUCT<company: STRING, ticker: STRING, fiscal_year: DOUBLE, form_type: STRING, accounting_standard: STRING, canonical_section: STRING, company_name_mismatch: BOOLEAN, numeric_density: DOUBLE>"
PAGES = "path STRING, page_number INT, text STRING"
QUESTIONS = "id STRING, category STRING, question STRING, company STRING, ticker STRING, fiscal_year STRING, ground_truth_answer STRING, source STRING"


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def in_buckets(spark: SparkSession, folder: str, table: str) -> BucketTable:
    key, order = BUCKETED[table]
    return BucketTable(spark, f"{folder}/{table}", TABLES.get(table, CHAT_EVENTS), key, order)


def bootstrap(spark: SparkSession, folder: str) -> list[str]:
    """Makes each table that the folder lacks, and leaves those it has. Names of the tables made."""
    made = []
    for name, schema in TABLES.items():
        if name in BUCKETED:
            if in_buckets(spark, folder, name).create():
                made.append(name)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made
