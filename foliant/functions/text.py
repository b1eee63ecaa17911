"""Text expressions: cleaning, counting, numbers, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of company names.
CORPORATE = "inc incorporated corp corporation co company group holdings holding ltd limited plc llc lp sa nv ag as".split()
DISPLAY_DROPPED = "inc corp corporation incorporated company co ltd limited plc llc lp holdings holding group".split()
#: Statement-line labels and the name that each goes by.
LABELS = {
    "total assets": "total assets",
    "total liabilities": "total liabilities",
    "net income": "net income",
    "net income loss": "net income",
    "net loss": "net loss",
    "net loss income": "net loss",
    "total revenue": "total revenue",
    "total revenues": "total revenue",
    "total net revenue": "total revenue",
    "total net revenues": "total revenue",
    "net revenues": "total revenue",
    "total net sales": "total net sales",
    "net sales": "total net sales",
    "research and development": "research and development expense",
    "research and development expense": "research and development expense",
    "research and development expenses": "research and development expense",
    "cash and cash equivalents": "cash and cash equivalents",
    "total stockholders equity": "total stockholders' equity",
    "total shareholders equity": "total stockholders' equity",
    "total operating expenses": "total operating expenses",
    "gross profit": "gross profit",
}
#: Fixed value: a dot leader.
DOT_LEADER = r"\.(?:\s?\.){3,}"
#: White space of any script, as the insides of a character class: faster than ``(?U)\s``, and with the four separators of ASCII.
SPACES = r"\t-\r\x1C- \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Its part within Latin-1, which the regular expressions look up in one table if each letter is named, and the rest with one range around it.
LATIN_SPACES = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x85\xA0"
WIDE_RANGE, WIDE_SPACES = r"\u1680-\u3000", r"\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same, letter by letter.
SPACE_LETTERS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _changed(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts where a plain look says that it is ``needed``; most texts need none."""
    return once(text, lambda t: F.when(needed(t), change(t)).otherwise(t))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACE_LETTERS))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    """How many ``tokens`` there are. White space beyond Latin-1 is made plain first, where there is any: a class of ranges costs some ten times as much a letter."""
    plain = _changed(
        text, lambda t: t.rlike(f"[{WIDE_RANGE}]"), lambda t: F.regexp_replace(t, f"[{WIDE_RANGE}&&[{WIDE_SPACES}]]", " ")
    )
    return F.regexp_count(plain, F.lit(f"[^{LATIN_SPACES}]+"))


def is_toc(text: Column, least: int = 3) -> Column:
    """a table of contents: ``least`` lines or more of a label, a dot leader and one number."""
    pattern = rf"^.+?{DOT_LEADER}\s*\d+\s*$"
    several = F.size(F.filter(F.transform(lines(text), strip), lambda x: x.rlike(pattern))) >= least
    # Most texts have no leader before a number at all.
    return F.when(text.isNull() | text.rlike(rf"{DOT_LEADER}\s*\d"), several).otherwise(False)


def collapse_dots(text: Column) -> Column:
    """F03."""
    return F.regexp_replace(text, DOT_LEADER, " ... ")


def glued_count(text: Column, least: int = 15) -> Column:
    """F04's count: words of ``least`` characters or more."""
    return F.regexp_count(text, F.lit(rf"(?U)\b\w{{{least},}}\b"))


def dehyphenate(text: Column) -> Column:
    """F05."""
    return _changed(text, lambda t: t.contains("-\n"), lambda t: F.regexp_replace(t, r"([a-z])-\n([a-z])", "$1$2"))


def normalize_space(text: Column) -> Column:
    """F06."""
    single = _changed(text, lambda t: t.contains("  ") | t.contains("\t"), lambda t: F.regexp_replace(t, r"[ \t]{2,}|\t", " "))
    return strip(_changed(single, lambda t: t.contains("\n\n\n"), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n")))


def is_numeric(token: Column, ratio: float = 0.6) -> Column:
    """F16: digits make up ``ratio`` of what is left without money signs and the like."""
    core = F.regexp_replace(token, rf"[$,%()\-.{SPACES}]", "")
    return (F.length(core) > 0) & (F.length(F.regexp_replace(core, r"[^\p{Nd}]", "")) >= ratio * F.length(core))


def numeric_density(text: Column) -> Column:
    """the share of numeric tokens; 0 for no tokens. Only tokens with a digit are looked at closely."""

    def share(all_tokens: Column) -> Column:
        numeric = F.filter(all_tokens, lambda t: t.rlike(r"\p{Nd}") & is_numeric(t))
        return F.coalesce(F.try_divide(F.size(numeric).cast("double"), F.size(all_tokens)), F.lit(0.0))

    # An array of one, so that the text is split once.
    return F.when(text.isNotNull(), F.get(F.transform(F.array(tokens(text)), share), 0)).otherwise(F.lit(0.0))


def paragraph_count(text: Column) -> Column:
    """parts between blank lines, one at least."""
    return F.greatest(F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: strip(p) != "")), F.lit(1))


def window_count(n: Column, window: int = 100, overlap: int = 50) -> Column:
    """sliding windows over ``n`` words; none for no words."""
    return F.when(n <= 0, 0).when(n <= window, 1).otherwise(1 + F.ceil((n - window) / (window - overlap))).cast("int")


def display_name(slug: Column) -> Column:
    """a slug as a person would type it."""
    words = F.split(slug, "[-_]")
    core = F.filter(words, lambda w: ~F.lower(w).isin(DISPLAY_DROPPED))
    core = F.when(F.size(core) > 0, core).otherwise(words)

    def capital(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))

    short = F.array_join(F.transform(core, lambda w: F.when((F.upper(w) == w) & w.rlike("[A-Za-z]"), w).otherwise(capital(w))), " ")
    return F.when((F.length(short) < 4) | ~short.rlike("[A-Za-z]{3}"), F.array_join(F.transform(words, capital), " ")).otherwise(short)


def misspelt(name: Column) -> Column:
    """without the middle letter of the first longest word; a name of short words gets an ``e``."""
    words = tokens(name)
    longest = F.array_max(F.transform(words, F.length))
    word = F.get(F.filter(words, lambda w: F.length(w) == longest), 0)
    half = F.floor(longest / 2).cast("int")
    cut = F.position(word, name) + half
    return F.when(
        longest > 4, F.concat(F.substring(name, F.lit(1), cut - 1), F.substring(name, cut + 1, F.length(name)))
    ).otherwise(F.concat(name, F.lit("e")))


def normal_label(raw: Column) -> Column:
    """F31's normal form."""
    bare = F.regexp_replace(F.lower(raw), "[’']", "")
    return strip(F.regexp_replace(F.regexp_replace(bare, "[(),.&/-]", " "), r"\s+", " "))


def label_name(raw: Column) -> Column:
    """the name of a statement line, or null."""
    table = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.try_element_at(table, normal_label(raw))


def normal_name(text: Column) -> Column:
    """F33."""
    return strip(F.regexp_replace(F.lower(text), "[-_./,]+", " "))


def core_tokens(name: Column) -> Column:
    """tokens without the endings of company names, one at least."""
    ending = "|".join(CORPORATE)
    return tokens(F.regexp_replace(strip(name), rf"(?<=\S)(?:\s+(?:{ending}))+$", ""))


def first_year(text: Column) -> Column:
    """F36."""
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def names_ticker(question: Column, ticker: Column) -> Column:
    """the upper-cased question has the ticker, whatever signs are in it, as a whole word."""
    return (ticker != "") & F.rlike(F.upper(question), F.concat(F.lit(r"(?U)\b\Q"), F.upper(ticker), F.lit(r"\E\b")))


def slashes(path: Column) -> Column:
    """F38."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    """the file's name without folders and ``.pdf``."""
    return F.regexp_replace(F.regexp_extract(slashes(path), r"([^/]*)$", 1), r"\.pdf$", "")


def snippet(content: Column, n: int = 300) -> Column:
    """P17."""
    return F.substring(content, 1, n)


def title(*candidates: Column) -> Column:
    """The first that is neither null, empty nor ``unknown``."""
    return F.coalesce(*(F.when((c != "") & (F.lower(c) != "unknown"), c) for c in candidates), F.lit("Unknown source"))


def as_string(c: Column) -> Column:
    """Blank is null."""
    return F.when(strip(c) != "", strip(c))


def as_number(c: Column) -> Column:
    """Finite numbers only."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def source_record(source: Column, index: Column) -> Column:
    """A source as the page shows it: blank strings and numbers that aren't finite are null, a missing id is ``source-`` and its place, a
    missing title the file, the company or the id, a missing snippet the content."""

    def text(name: str) -> Column:
        return as_string(source[name])

    own = F.coalesce(text("chunk_id"), F.concat(F.lit("source-"), index.cast("string")))
    return F.struct(
        own.alias("chunk_id"),
        F.coalesce(text("title"), text("source_file"), text("company"), own).alias("title"),
        *(text(n).alias(n) for n in ("company", "ticker", "form_type")),
        *(as_number(source[n].cast("double")).alias(n) for n in ("fiscal_year", "page_start", "page_end", "relevance_score")),
        F.coalesce(text("text_snippet"), text("content")).alias("text_snippet"),
    )


def page_range(start: Column, end: Column) -> Column:
    """X03."""
    return F.when(start.isNull() & end.isNull(), None).when(
        end.isNull() | (start == end), start.cast("string")
    ).when(start.isNull(), end.cast("string")).otherwise(
        F.concat_ws("–", start.cast("string"), end.cast("string"))
    )


def dotted(*parts: Column) -> Column:
    """The non-empty parts."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " · ")


def rounded(c: Column, n: int = 4) -> Column:
    """To ``n`` places, at most four, as half-even rounding of the number itself, not of its shortest digits: 0.03125 is 0.0312, and 0.00625, which is a little more
    than it shows, is 0.0063."""
    x, twice = c.cast("double"), F.lit(2.0 * 10**n)
    k = F.rint(x * twice)
    # x * twice - k without error: a half of x's digits at a time.
    t = x * F.lit(134217729.0)
    high = t - (t - x)
    over = (high * twice - k) + (x - high) * twice
    low = F.floor(k / 2)
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    near = (F.pmod(k, F.lit(2.0)) == 1) & (F.abs(over) < 1e-3)
    return F.when((F.abs(x) < 1e8) & near, (low + up).cast("double") / F.lit(10.0**n)).otherwise(F.bround(x, n))


def clean_int(c: Column) -> Column:
    """NaN is null."""
    return F.when(~F.isnan(c), c).cast("int")


def token_estimate(chars: Column) -> Column:
    """M10."""
    return chars / 4.0


def stable_id(source: Column, index: Column, n: int = 8) -> Column:
    """An id that a second run gives again."""
    return F.substring(F.sha2(F.concat(source, F.lit("#"), index.cast("string")), 256), 1, n)


def iso_time(ts: Column) -> Column:
    """M02."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def canonical_uuid(c: Column) -> Column:
    """The canonical form of a UUID in any of its spellings, or null."""
    digits = F.lower(F.regexp_replace(F.regexp_replace(c, "^urn:uuid:|[{}-]", ""), "uuid:", ""))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
