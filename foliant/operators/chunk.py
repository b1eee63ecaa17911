"""Documents into overlapping word windows and structural sections, with offsets and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import once, strip
from foliant.session import spread

WINDOW, OVERLAP = 350, 50
LEAST_SECTION = 30
JOINER = 2  # characters between two pages
ITEM = r"(?imd)^\s*ITEM\s*(\d+[A-Z]?(?:\.\d+)?(?:\.[A-Z])?)\.?[\s—-]"
_WORD = r"[^\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"  # (?U)\S+
PART = r"(?imd)^\s*PART\s*([IVX]+)\b"


def window_starts(n: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Where windows over ``n`` units begin, from 0."""
    last = F.greatest(F.ceil((n - window) / (window - overlap)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * (window - overlap))


def word_chunks(docs: DataFrame, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """A row a window: ``chunk_index``, ``content``, ``char_start``, ``char_end``. Units end in one space each; a document of
    none but the empty unit has no chunk. Other columns are kept.

    Windows are cut before rows are made, so that no row carries its whole document, and their places are running sums."""
    kept, step = [c for c in docs.columns if c != text], window - overlap
    units = spread(docs).where(F.length(text) > 0).select(*kept, F.split(F.col(text), " ").alias("__u"))
    starts, n = window_starts(F.size("__u"), window, overlap), F.size("__u")

    def content(s: Column) -> Column:
        body = F.array_join(F.slice("__u", s + 1, F.lit(window)), " ")
        return F.when(s + window < n, F.concat(body, F.lit(" "))).otherwise(body)

    # From one window's start to the next: the units between, each with its space.
    steps = F.transform(starts, lambda s: F.aggregate(F.slice("__u", s + 1, F.lit(step)), F.lit(0), lambda a, u: a + F.length(u) + 1))
    places = F.aggregate(steps, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut = units.select(*kept, F.transform(starts, content).alias("__c"), places.alias("__p"))
    pairs = F.zip_with("__c", F.slice("__p", F.lit(1), F.size("__c")), lambda c, p: F.struct(c.alias("content"), p.alias("char_start")))
    rows = cut.select(*kept, F.posexplode(pairs).alias("chunk_index", "__w")).select(*kept, "chunk_index", "__w.content", "__w.char_start")
    return rows.withColumn("char_end", F.col("char_start") + F.length("content"))


def boundaries(text: Column) -> Column:
    """(start, label) of Item and Part headings, by start. A heading begins at its first character or at blank lines before it."""

    def placed(between: Column, heads: Column, names: Column, label: str) -> Column:
        lengths = F.zip_with(
            F.slice(between, F.lit(1), F.size(heads)),
            heads,
            lambda a, h: F.struct(F.length(a).alias("before"), F.length(h).alias("own"))
        )

        def starts(steps: Column) -> Column:
            ends = F.aggregate(steps, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["before"] + x["own"])))
            return F.zip_with(F.slice(ends, F.lit(1), F.size(steps)), steps, lambda e, x: e + x["before"])

        return F.zip_with(
            once(lengths, starts),
            names,
            lambda at, name: F.struct(at.alias("start"), F.concat(F.lit(label), F.lit(" "), F.upper(name)).alias("label"))
        )

    def found(pattern: str, label: str) -> Column:
        raw = F.struct(
            F.split(text, pattern).alias("between"),  # what is before, between and behind the headings
            *(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(("heads", "names")))
        )
        return once(raw, lambda r: placed(r["between"], r["heads"], r["names"], label))

    return F.array_sort(
        F.concat(found(ITEM, "Item"), found(PART, "Part")),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    )


def section_bodies(text: Column, least: int = LEAST_SECTION) -> Column:
    """(start, end, label, body) of each section of a text, cut before rows are made; sections of under ``least`` words are no sections, and the
    next raw heading ends one."""

    def cut(found: Column) -> Column:
        def section(b: Column, i: Column) -> Column:
            end = F.coalesce(F.get(found, i + 1)["start"], F.length(text))
            return F.struct(b["start"].alias("start"), end.alias("end"), b["label"].alias("label"), F.substring(text, b["start"] + 1, end - b["start"]).alias("body"))

        return F.filter(F.transform(found, section), lambda s: F.regexp_count(s["body"], F.lit(_WORD)) >= least)

    # An array of one, so that the headings are found once.
    return F.get(F.transform(F.array(boundaries(text)), cut), 0)


def sections(docs: DataFrame, key: str, text: str = "text", least: int = LEAST_SECTION) -> DataFrame:
    """A row a section (``start``, ``end``, ``label``), as ``section_bodies`` finds them."""
    spans = F.transform(section_bodies(F.col(text), least), lambda s: s.dropFields("body"))
    return spread(docs).select(key, F.explode(spans).alias("s")).select(key, "s.start", "s.end", "s.label")


def structure_chunks(docs: DataFrame, key: str, text: str = "text", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """sections cut into word windows; a document without sections is one without label. Each row of ``docs`` is cut by itself, so nothing is shuffled and a
    row carries its own section only."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("start"), F.col(text).alias("body")))
    own = F.transform(section_bodies(F.col(text)), lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["body"].alias("body")))
    parts = F.get(F.transform(F.array(own), lambda p: F.when(F.size(p) > 0, p).otherwise(whole)), 0)
    rows = spread(docs).select(key, F.explode(parts).alias("s"))
    return word_chunks(
        rows.select(key, "s.label", F.col("s.start").alias("section_start"), strip(F.col("s.body")).alias("__body")), "__body", window, overlap
    )


def item_number(label: Column) -> Column:
    """F14."""
    return F.when(label.startswith("Item"), F.trim(F.replace(label, F.lit("Item"), F.lit(""))))


def part_number(label: Column) -> Column:
    return F.when(label.startswith("Part"), F.trim(F.replace(label, F.lit("Part"), F.lit(""))))


def chunk_id(company: Column, year: Column, index: Column) -> Column:
    """F15."""
    return F.concat_ws("_", company, F.coalesce(year.cast("string"), F.lit("unk")), index.cast("string"))


def page_offsets(pages: DataFrame, doc: str, page: str = "page_number", text: str = "text") -> DataFrame:
    """(start, end) of each page in its document's joined text."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + JOINER).over(before), F.lit(0))
    return pages.select(doc, page, start.alias("start"), (start + F.length(text)).alias("end"))


def with_pages(chunks: DataFrame, offsets: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """``page_start`` and ``page_end``: null between two pages, the last page past the end."""
    spans = offsets.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col(page).alias("page")))).alias("__pages"))
    joined, pages = chunks.join(spans, doc, "left"), F.col("__pages")
    return joined.withColumn(
        "page_start", page_of(pages, F.col("char_start"))
    ).withColumn("page_end", page_of(pages, F.col("char_end") - 1)).drop("__pages")


def page_of(pages: Column, at: Column) -> Column:
    """J02 of one place, from (start, end, page) of a document's pages in order."""
    hit = F.get(F.filter(pages, lambda p: (p["start"] <= at) & (at < p["end"])), 0)["page"]
    last = F.try_element_at(pages, F.lit(-1))
    return F.when(at >= last["end"], last["page"]).otherwise(hit)


def label_of(heads: Column, at: Column) -> Column:
    """J03 of one place, from (start, label) of a document's headings in order."""
    return F.try_element_at(F.filter(heads, lambda h: h["start"] <= at), F.lit(-1))["label"]


def with_label(chunks: DataFrame, bounds: DataFrame, doc: str) -> DataFrame:
    """The label of the last boundary at or before each chunk's start: an as-of join by one sort of both."""
    marks = bounds.select(
        doc,
        F.col("start").alias("__at"),
        F.lit(0).alias("__kind"),
        "label",
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema if f.name not in (doc, "label"))
    )
    rows = chunks.select(
        doc,
        F.col("char_start").cast("int").alias("__at"),
        F.lit(1).alias("__kind"),
        F.lit(None).cast("string").alias("label"),
        *(c for c in chunks.columns if c not in (doc, "label"))
    )
    seen = Window.partitionBy(doc).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.unionByName(marks).withColumn(
        "label", F.last("label", ignorenulls=True).over(seen)
    ).where("__kind = 1").drop("__at", "__kind")
