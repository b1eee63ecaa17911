"""Paged text: front matter, boilerplate, page types, and the cleaned body of each document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import filing, text as T
from foliant.functions.udfs import clean_unicode
from foliant.operators.chunk import JOINER
from foliant.session import spread

BOILERPLATE, REPORTED = 0.6, 0.3
GLUED_FLAG, FEW_WORDS = 20, 500


def _placed(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``pages`` with place ``__at`` and, of their document, ``cutoff`` and ``found``. Covers are told before the one shuffle by document."""
    own = Window.partitionBy(doc)
    rows = pages.withColumn("__cover", filing.is_cover(F.col(text))).withColumn("__at", F.row_number().over(own.orderBy(page)) - 1)
    return rows.withColumns({
        "cutoff": F.coalesce(F.min(F.when(F.col("__cover"), F.col("__at"))).over(own), F.lit(0)),
        "found": F.coalesce(F.bool_or("__cover").over(own), F.lit(False)),
        "__n": F.count("*").over(own)
    }).drop("__cover")


def front_matter(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """per document the first page (0-based place) that reads as a cover, and whether there is one; else (0, false)."""
    told = pages.select(doc, page, filing.is_cover(F.col(text)).alias("cover"))
    seen = told.select(doc, "cover", (F.row_number().over(Window.partitionBy(doc).orderBy(page)) - 1).alias("at"))
    return seen.groupBy(doc).agg(
        F.coalesce(F.min(F.when(F.col("cover"), F.col("at"))), F.lit(0)).alias("cutoff"),
        F.coalesce(F.bool_or("cover"), F.lit(False)).alias("found")
    )


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(T.lines(text), T.strip), lambda x: x != ""))


def line_shares(pages: DataFrame, doc: str = "doc_id", text: str = "text", least: float = REPORTED) -> DataFrame:
    """Lines that stand on at least ``least`` of their document's pages, once a page."""
    lines = _distinct_lines(F.coalesce(text, F.lit("")))
    totals = pages.groupBy(doc).agg(F.count("*").alias("pages"))
    counts = spread(pages.select(doc, text)).select(doc, F.explode(lines).alias("line")).groupBy(doc, "line").agg(F.count("*").alias("n"))
    return counts.join(totals, doc).withColumn("ratio", F.col("n") / F.col("pages")).where(F.col("ratio") >= least)


def without_lines(text: Column, dropped: Column) -> Column:
    """F08."""
    return F.array_join(F.filter(T.lines(text), lambda x: ~F.array_contains(dropped, T.strip(x))), "\n")


def clean_page(text: Column, deglue: Callable[[Column], Column] | None = None) -> Column:
    """A page's steps after boilerplate, in order: Unicode, hyphens, glued words, dot leaders, white space."""
    out = T.dehyphenate(clean_unicode(text))
    return T.normalize_space(T.collapse_dots(deglue(out) if deglue else out))


def clean_pages(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page_number",
    text: str = "text",
    deglue: Callable[[Column], Column] | None = None
) -> DataFrame:
    """F09, page by page: pages from the cutoff on with ``page_type`` (cover, toc, body) and ``clean``. The cover keeps its boilerplate; tables
    of contents are found before Unicode cleaning."""
    rows = _placed(pages.where(F.col(doc).isNotNull()), doc, page, text).withColumn("__t", F.coalesce(text, F.lit("")))
    kept = rows.where(F.col("__at") >= F.col("cutoff"))
    # Pages lie by document from here on, so lines are counted where they are.
    lines = kept.select(doc, (F.col("__n") - F.col("cutoff")).alias("pages"), F.explode(_distinct_lines(F.col("__t"))).alias("line"))
    often = lines.groupBy(doc, "line").agg(F.count("*").alias("n"), F.first("pages").alias("pages")).where(F.col("n") / F.col("pages") >= BOILERPLATE)
    repeated = often.groupBy(doc).agg(F.collect_set("line").alias("__drop"))
    joined = kept.join(repeated, doc, "left")
    cover = F.col("found") & (F.col("__at") == F.col("cutoff"))
    bare = F.when(cover | F.col("__drop").isNull(), F.col("__t")).otherwise(without_lines(F.col("__t"), F.col("__drop")))
    typed = joined.withColumn("__b", bare).withColumn(
        "page_type", F.when(cover, "cover").when(T.is_toc(F.col("__b")), "toc").otherwise("body")
    )
    return typed.select(
        doc,
        page,
        "cutoff",
        "found",
        "page_type",
        T.glued_count(F.col("__b")).alias("glued"),
        clean_page(F.col("__b"), deglue).alias("clean")
    )


def clean_documents(cleaned: DataFrame, doc: str = "doc_id", page: str = "page_number", spans: bool = False) -> DataFrame:
    """F09's report from ``clean_pages``: per document the body's text, the first eight pages' text as ``cover_text``, and flags; with ``spans`` also
    (start, end, page) of the body's pages in it."""

    def joined(pages: Column) -> Column:
        return F.array_join(F.transform(pages, lambda p: p["clean"]), "\n\n")

    fields, more = [F.col(page).alias("page"), "page_type", "clean"], []
    if spans:
        before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
        own = F.when(F.col("page_type") == "body", F.length("clean") + JOINER).otherwise(0)
        cleaned = cleaned.withColumn("start", F.coalesce(F.sum(own).over(before), F.lit(0)))
        fields.append("start")
        more = [F.transform(F.filter("p", lambda x: x["page_type"] == "body"), lambda x: F.struct(x["start"], (x["start"] + F.length(x["clean"])).alias("end"), x["page"])).alias("spans")]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    by_doc = cleaned.groupBy(doc).agg(
        ordered.alias("p"),
        F.first("found").alias("cover_found"),
        F.first("cutoff").alias("cutoff"),
        F.sum("glued").alias("glued_words"),
        F.count("*").alias("n_pages"),
        F.count_if(F.col("page_type") == "toc").alias("n_toc_pages")
    )
    full = joined(F.filter("p", lambda x: x["page_type"] == "body"))
    return by_doc.select(
        doc,
        full.alias("full_text"),
        joined(F.slice("p", 1, 8)).alias("cover_text"),
        "cover_found",
        "cutoff",
        "n_pages",
        "n_toc_pages",
        "glued_words",
        *more
    ).withColumn("word_count", T.word_count(F.col("full_text"))).withColumns({
        "glued_flag": F.col("glued_words") > GLUED_FLAG,
        "few_words_flag": F.col("word_count") < FEW_WORDS
    })


def mismatch_scan(pages: DataFrame, path: str = "path", page: str = "page_number", text: str = "text", first: int = 30) -> DataFrame:
    """name mismatches from the first pages alone."""
    docs = clean_documents(clean_pages(pages.where(F.col(page) <= first), path, page, text), path, page)
    told = docs.select(path, filing.registrant(filing.company(F.col(path)), F.col("cover_text")).alias("r"))
    return told.select(path, F.col("r.name").alias("registrant_name"), F.col("r.mismatch").alias("company_name_mismatch"))


def document_metadata(docs: DataFrame, path: str = "path", cover: str = "cover_text", more: Sequence[Column | str] = ()) -> DataFrame:
    """what path and cover say of a document, and ``more`` columns. Each pattern is looked for once in a cover."""
    own, page = F.col(path), F.col(cover)
    found = docs.select(
        path,
        filing.form_type(page).alias("form_type"),
        filing.cover_year(page).alias("cover_year"),
        filing.filename_year(own).alias("file_year"),
        filing.registrant(filing.company(own), page).alias("r"),
        page.alias("__cover"),
        *more
    )
    return found.select(
        path,
        filing.company(own).alias("company"),
        filing.ticker(own).alias("ticker"),
        "form_type",
        F.coalesce(F.nullif("cover_year", F.lit(0)), "file_year").alias("fiscal_year"),
        (F.col("cover_year") == F.col("file_year")).alias("year_matches_file"),
        filing.accounting_standard(F.col("form_type"), F.col("__cover")).alias("accounting_standard"),
        F.col("r.name").alias("registrant_name"),
        F.col("r.mismatch").alias("company_name_mismatch"),
        *found.columns[len(found.columns) - len(more):]
    )


def file_profile(pages: DataFrame, doc: str = "path", text: str = "text") -> DataFrame:
    """pages, words, paragraphs and windows of each file; a page without text counts as empty."""
    body = F.coalesce(text, F.lit(""))
    return pages.groupBy(doc).agg(
        F.count("*").alias("pages"),
        F.sum(T.word_count(body)).alias("words"),
        F.sum(T.paragraph_count(body)).alias("paragraphs")
    ).withColumn("windows", T.window_count(F.col("words")))
