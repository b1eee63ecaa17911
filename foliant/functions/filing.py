"""Metadata of a filing from its path and cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import once, slashes, strip, tokens

#: The wording of cover pages, with white space as ``{s}``.
_REPORT = r"REPORT{s}PURSUANT{s}TO{s}SECTION{s}13{s}OR{s}15\(d\)"
_FORM = r"FORM{s}(10-K|20-F).{{0,400}}?" + _REPORT
_COVER = r"UNITED{s}STATES{s}SECURITIES{s}AND{s}EXCHANGE{s}COMMISSION.{{0,400}}?" + _FORM
COVER_STRICT, COVER_LOOSE = (rf"(?is)(?U){_COVER}".format(s=s) for s in (r"\s+", r"\s*"))
FORM_STRICT, FORM_LOOSE = (rf"(?is)(?U){_FORM}".format(s=s) for s in (r"\s+", r"\s*"))
FISCAL_YEAR = r"(?i)(?:fiscal\s+year\s+ended|for\s+the\s+year\s+ended)\D{0,10}(?:\w+\s+\d{1,2},?\s+)?(\d{4})"
#: A whole line of three letters or more before the phrase; looked for at the beginnings of lines only, so that a text is read once.
REGISTRANT = r"(?i)(?<![^\n])([^\n]{3,}+)\n\(Exact\s*Name\s*of\s*Registrant\s*as\s*Specified\s*in\s*its\s*Charter\)"
LONGEST_NAME = 120
RENAMED = r"(?i)formerly\s+(?:known\s+as|named)\s+([^.,\n]{3,80})"
SUFFIX = r"(?i)\b(inc|incorporated|corp|corporation|co|company|ltd|limited|llc|lp|l\.p|plc|holdings|group|the)\b\.?"
PROSE = "and the of to by or in for from as other a an with".split()
MARKED = "[xX☒]"


def is_cover(text: Column) -> Column:
    """F01 of one page."""
    return text.rlike(COVER_STRICT) | text.rlike(COVER_LOOSE)


def company(path: Column) -> Column:
    """the folder that the file is in."""
    return F.coalesce(F.get(F.reverse(F.split(slashes(path), "/")), 1), F.lit(""))


def ticker(path: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(_file(path), r"(?i)NASDAQ_([A-Z]+)_(\d{4})", 1)), F.lit(""))


def filename_year(path: Column) -> Column:
    return F.regexp_extract(_file(path), r"(?i)NASDAQ_([A-Z]+)_(\d{4})", 2).try_cast("int")


def _file(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)$", 1)


def form_type(cover: Column) -> Column:
    """the strict wording, then the one without spaces."""
    found = (F.nullif(F.regexp_extract(cover, p, 1), F.lit("")) for p in (FORM_STRICT, FORM_LOOSE))
    return F.upper(F.coalesce(*found))


def cover_year(cover: Column) -> Column:
    """F20."""
    return F.regexp_extract(cover, FISCAL_YEAR, 1).try_cast("int")


def fiscal_year(cover: Column, path: Column) -> Column:
    """the cover's year, else (also for 0) the file name's."""
    return F.coalesce(F.nullif(cover_year(cover), F.lit(0)), filename_year(path))


def accounting_standard(form: Column, cover: Column) -> Column:
    """US GAAP for a 10-K; for a 20-F the one box that is marked, else null."""
    options = {
        "US GAAP": rf"{MARKED}\s*U\.?S\.?\s*GAAP",
        "IFRS": rf"{MARKED}\s*International\s+Financial\s+Reporting\s+Standards",
        "Other": rf"{MARKED}\s*Other"
    }

    def boxes(block: Column) -> Column:
        return F.filter(F.array(*(F.when(block.rlike(p), F.lit(k)) for k, p in options.items())), lambda x: x.isNotNull())

    marked = once(F.regexp_extract(cover, r"(?is)basis of accounting.{0,600}", 0), boxes)
    one = once(marked, lambda m: F.when(F.size(m) == 1, F.get(m, 0)))
    return once(form, lambda f: F.when(f == "10-K", "US GAAP").when(f == "20-F", one))


def registrant_name(cover: Column) -> Column:
    """the line before the charter phrase, if it can be a name; of a long line its last ``LONGEST_NAME`` letters."""

    def checked(name: Column, words: Column) -> Column:
        letters = F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w))
        broken = (F.size(words) >= 10) & (letters < 3.5 * F.size(words))
        prose = F.size(F.filter(words, lambda w: F.regexp_replace(F.lower(w), "^[,.]+|[,.]+$", "").isin(PROSE))) >= 2
        return F.when((F.size(words) > 0) & ~name.rlike(r"(?i)^commission\s+file\s+number") & ~broken & ~prose, name)

    found = strip(F.substring(F.regexp_extract(cover, REGISTRANT, 1), -LONGEST_NAME, LONGEST_NAME))
    return once(found, lambda name: once(tokens(name), lambda words: checked(name, words)))


def significant_tokens(name: Column) -> Column:
    """F23."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, SUFFIX, " ")), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.filter(F.split(bare, r"\s+"), lambda t: F.length(t) >= 3))


def collapsed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def name_mismatch(folder: Column, cover: Column, name: Column | None = None) -> Column:
    """Whether the registrant isn't the folder's company; null where that can't be told. ``name`` is the registrant's where it is known already."""

    def differs(name: Column, ours: Column, theirs: Column) -> Column:
        inside = once(
            F.struct(collapsed(folder).alias("a"), collapsed(name).alias("b")),
            lambda x: (x["a"] != "") & (x["b"] != "") & (x["b"].contains(x["a"]) | x["a"].contains(x["b"]))
        )
        renamed = F.exists(F.regexp_extract_all(cover, F.lit(RENAMED), F.lit(1)), lambda old: F.arrays_overlap(significant_tokens(old), ours))
        return F.when(
            name.isNull() | (F.size(ours) <= 0) | (F.size(theirs) <= 0), None
        ).otherwise(~(F.arrays_overlap(ours, theirs) | inside | renamed))

    def told(name: Column) -> Column:
        both = F.struct(significant_tokens(folder).alias("ours"), significant_tokens(name).alias("theirs"))
        return once(both, lambda t: differs(name, t["ours"], t["theirs"]))

    return once(registrant_name(cover) if name is None else name, told)


def registrant(folder: Column, cover: Column) -> Column:
    """F22 and F25 in one: (name, mismatch)."""
    return once(registrant_name(cover), lambda n: F.struct(n.alias("name"), name_mismatch(folder, cover, n).alias("mismatch")))
