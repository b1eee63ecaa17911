"""Pages of filings to chunk rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import filing
from foliant.functions import text as T
from foliant.operators import chunk, cleaning, sections


def chunk_pages(pages: DataFrame, deglue: Callable[[Column], Column] | None = None) -> DataFrame:
    """Cleaned, chunked, placed and described: ``pages(path, page_number, text)`` to a row a chunk, ready to embed.

    The order of steps is that of the page plan: cover, boilerplate, contents, text, then windows with pages and headings. Whole documents stay
    together after one shuffle by path, and a document's metadata, page places and headings are found once, before it is cut: its chunks carry those, not
    its cover, and nothing is joined to them but the table of sections.
    """
    docs = cleaning.clean_documents(cleaning.clean_pages(pages, "path", deglue=deglue), "path", spans=True)
    meta = cleaning.document_metadata(docs, "path", "cover_text", [
        "glued_flag", "few_words_flag", "spans", "full_text", sections.said(F.col("cover_text")).alias("__said"), chunk.boundaries(F.col("full_text")).alias("__heads")
    ])
    chunks = chunk.word_chunks(meta.withColumnRenamed("full_text", "text"))
    start, end, pages_ = F.col("char_start"), F.col("char_end"), F.col("spans")
    joined = chunks.withColumns({
        "page_start": chunk.page_of(pages_, start), "page_end": chunk.page_of(pages_, end - 1), "label": chunk.label_of(F.col("__heads"), start)
    }).withColumns({"item_number": chunk.item_number(F.col("label")), "part_number": chunk.part_number(F.col("label"))}).drop("spans", "__heads")
    named = sections.canonical_section(joined, "form_type", "item_number", named="__said").withColumnRenamed("section", "canonical_section")
    density = F.col("__density")
    return named.withColumn("__density", T.numeric_density(F.col("content"))).withColumns(
        {
            "source_file": T.slashes(F.col("path")),
            "chunk_id": chunk.chunk_id(F.col("company"), F.col("fiscal_year"), F.col("chunk_index")),
            "numeric_density": T.rounded(density),
            "numeric_dense": density >= 0.10,
            "n_chars": F.length("content"),
        }
    ).drop("__said", "__density")


def document_report(chunks: DataFrame) -> DataFrame:
    """Per document its chunks, dense chunks, and chunks with an item."""
    return chunks.groupBy("path").agg(
        F.count("*").alias("n_chunks"),
        F.count_if("numeric_dense").alias("n_dense"),
        F.count("item_number").alias("n_items"),
        F.count_if(F.coalesce("ticker", F.lit("")) == "").alias("n_ticker_missing")
    )


def registrant(path: Column, cover: Column) -> Column:
    """The mismatch of one document, for checks outside a full run."""
    return filing.name_mismatch(filing.company(path), cover)
