"""Pieces of DuckDB SQL that several registered queries are checked with."""

from __future__ import annotations

from foliant.functions import text as T

SPACE = r"\s+"
#: The letters of SQL's own white space, for trim.
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def glued_sql(text: str) -> str:
    """F04's count, of words in any script."""
    return rf"len(list_filter(regexp_split_to_array({text}, '[^\pL\pM\pN_]+'), lambda x: length(x) >= 15))"


def uuid_sql(c: str) -> str:
    """C01."""
    bare = f"lower(replace(replace(replace(replace(replace({c}, 'urn:uuid:', ''), '{{', ''), '}}', ''), '-', ''), 'uuid:', ''))"
    return rf"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{32}}$') THEN regexp_replace({bare}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') END"


def normal_name_sql(c: str) -> str:
    """F33."""
    return f"trim(regexp_replace(lower({c}), '[-_./,]+', ' ', 'g'), {BLANKS})"


def label_key_sql(c: str) -> str:
    """F31's normal form."""
    bare = f"regexp_replace(lower({c}), '[’'']', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[(),.&/-]', ' ', 'g'), '\s+', ' ', 'g'))"


LABELS_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in T.LABELS.items()
) + ") AS t(name, label))"


def display_sql(slug: str) -> str:
    """F29."""
    words = f"regexp_split_to_array({slug}, '[-_]')"
    dropped = "[" + ", ".join(f"'{w}'" for w in T.DISPLAY_DROPPED) + "]"
    capital = "upper(w[1]) || lower(w[2:])"
    core = f"list_filter({words}, lambda w: NOT list_contains({dropped}, lower(w)))"
    core = f"CASE WHEN len({core}) > 0 THEN {core} ELSE {words} END"
    short = f"array_to_string(list_transform({core}, lambda w: CASE WHEN upper(w) = w AND regexp_matches(w, '[A-Za-z]') THEN w ELSE {capital} END), ' ')"
    return f"CASE WHEN length({short}) < 4 OR NOT regexp_matches({short}, '[A-Za-z]{{3}}') THEN array_to_string(list_transform({words}, lambda w: {capital}), ' ') ELSE {short} END"


def typo_sql(name: str) -> str:
    """F30, of a column."""
    longest = f"list_max(list_transform({words_sql(name)}, lambda w: length(w)))"
    cut = f"(strpos({name}, list_filter({words_sql(name)}, lambda w: length(w) = {longest})[1]) + {longest} // 2)"
    return f"CASE WHEN {longest} > 4 THEN left({name}, CAST({cut} - 1 AS BIGINT)) || substr({name}, {cut} + 1) ELSE {name} || 'e' END"


def core_tokens_sql(normal: str) -> str:
    """F34, of a normal name."""
    return words_sql(rf"regexp_replace(trim({normal}), '(\S)(?:\s+(?:{'|'.join(T.CORPORATE)}))+$', '\1')")


def ratios_sql(pairs: str) -> str:
    """F35 as CTEs that end in ``ratios(pa, pb, ratio)``, for ``pairs(pa, pb)``: the longest common block, the first of equals, and then the same to its
    left and to its right."""
    prefix = "len(list_filter(range(1, CAST(least(length(a) - i, length(b) - j) + 2 AS BIGINT)), lambda k: substr(a, i, k) = substr(b, j, k)))"
    blocks = f"flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: {{'k': {prefix}, 'i': -i, 'j': -j}})))"
    best = f"list_reverse_sort({blocks})[1]"
    return f"""parts(pa, pb, a, b, m) AS (
  SELECT pa, pb, pa, pb, {best.replace('length(a)', 'length(pa)').replace('length(b)', 'length(pb)').replace('substr(a,', 'substr(pa,').replace('substr(b,', 'substr(pb,')} FROM {pairs}
  UNION ALL
  SELECT pa, pb, a, b, {best} FROM (
    SELECT pa, pb, unnest([left(a, CAST(-m.i - 1 AS BIGINT)), substr(a, -m.i + m.k)]) AS a, unnest([left(b, CAST(-m.j - 1 AS BIGINT)), substr(b, -m.j + m.k)]) AS b FROM parts WHERE m.k > 0) WHERE a <> '' AND b <> ''),
ratios AS (SELECT pa, pb, coalesce(2.0 * sum(m.k) / nullif(length(pa) + length(pb), 0), 1.0) AS ratio FROM parts GROUP BY pa, pb)"""


SIGNIFICANT = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(regexp_replace({}, '(?i)\b(inc|incorporated|corp|corporation|co|company|ltd|limited|llc|lp|l\.p|plc|holdings|group|the)\b\.?', ' ', 'g')), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3))"
PROSE = "['and', 'the', 'of', 'to', 'by', 'or', 'in', 'for', 'from', 'as', 'other', 'a', 'an', 'with']"


def registrant_sql(rows: str) -> str:
    """F22 and F25 of ``rows(path, cover)``."""
    old = SIGNIFICANT.format(r"regexp_extract(cover, '(?i)formerly\s+(?:known\s+as|named)\s+([^.,\n]{3,80})', 1)")
    prose = f"len(list_filter(w, lambda x: list_contains({PROSE}, regexp_replace(lower(x), '^[,.]+|[,.]+$', '', 'g')))) >= 2"
    return rf"""WITH n AS (SELECT path, cover, list_reverse(string_split(replace(path, '\', '/'), '/'))[2] AS folder, trim(regexp_extract(cover, '(?i)([^\n]{{3,120}})\n\(Exact\s*Name\s*of\s*Registrant\s*as\s*Specified\s*in\s*its\s*Charter\)', 1)) AS raw FROM {rows}),
w AS (SELECT *, {words_sql('raw')} AS w FROM n),
k AS (SELECT *, CASE WHEN len(w) > 0 AND NOT regexp_matches(raw, '(?i)^commission\s+file\s+number') AND NOT (len(w) >= 10 AND length(array_to_string(w, '')) < 3.5 * len(w)) AND NOT {prose} THEN raw END AS registrant FROM w),
s AS (SELECT *, {SIGNIFICANT.format("folder")} AS ours, {SIGNIFICANT.format("registrant")} AS theirs, regexp_replace(lower(folder), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(registrant), '[^a-z0-9]', '', 'g') AS b, {old} AS old FROM k)
SELECT path, registrant, CASE WHEN registrant IS NULL OR coalesce(len(ours), 0) = 0 OR len(theirs) = 0 THEN NULL ELSE NOT (list_has_any(ours, theirs) OR (a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))) OR list_has_any(old, ours)) END AS mismatch FROM s"""
