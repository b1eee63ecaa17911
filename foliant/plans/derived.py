"""Rows that the registered queries make of the given tables, in SQL that Spark and DuckDB read alike: documents as filings with covers, pages, headings,
statement lines, questions, replies. They have what the tables' own texts lack; a query runs on them and on the few typed rows of its fixture."""

from __future__ import annotations

NL = "chr(10)"


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


_ID = "CAST(doc_id AS STRING)"
_YEAR = "CAST(2014 + doc_id % 9 AS STRING)"
_TEXT = "coalesce(text, '')"
_REGISTRANT = "(Exact Name of Registrant as Specified in its Charter)"
_COVER = (
    f"'UNITED STATES SECURITIES AND EXCHANGE COMMISSION' || {NL} || 'FORM 10-K' || {NL} || 'ANNUAL REPORT PURSUANT TO SECTION 13 OR 15(d)' || {NL}"
    f" || 'for the fiscal year ended December 31, ' || {_YEAR} || {NL} || upper(source) || ' Holdings, Inc.' || {NL} || '{_REGISTRANT}'"
)

TEXTS = f"""SELECT 1000 + doc_id, 'Item 1. ' || source || ' ........ ' || CAST(doc_id % 90 AS STRING) || {NL} || 'Item 2. ' || lang || ' . . . . . 7' || {NL}
  || CASE WHEN doc_id % 3 = 0 THEN 'Item 3. End.....12' || {NL} ELSE '' END || text || {NL} || 'glad-' || {NL} || 'handed' || chr(9) || ' $(' || CAST(n_chars AS STRING) || ') 5% 9x'
  || CASE WHEN doc_id % 4 = 0 THEN ' ' || source || 'internationalization' || repeat({NL}, 4) || 'end' ELSE '' END FROM {{documents}}"""

PATHS = f"""SELECT 'd' || {_ID} || CASE WHEN doc_id % 5 = 0 THEN chr(92) || source || '-inc' || chr(92) ELSE '/' || source || '-inc/' END
  || CASE WHEN doc_id % 7 = 0 THEN 'AMEX_' ELSE 'NASDAQ_' END || upper(lang) || '_' || CAST(2015 + doc_id % 8 AS STRING) || '.pdf',
  CASE doc_id % 4
    WHEN 0 THEN {_COVER}
    WHEN 1 THEN 'FORM 20-F ANNUAL REPORT PURSUANT TO SECTION 13 OR 15(d) for the year ended ' || {_YEAR} || {NL} || 'Other Things Ltd.' || {NL} || '{_REGISTRANT}' || {NL}
      || 'a company formerly named ' || source || ' Group' || {NL} || 'basis of accounting: ' || CASE WHEN doc_id % 8 = 1 THEN '[x] US GAAP' ELSE 'x International Financial Reporting Standards' END || ' [ ] Other'
    WHEN 2 THEN {_TEXT}
    ELSE 'FORM10-K' || {NL} || {_TEXT} || {NL} || 'Commission file number ' || {_ID} || {NL} || '{_REGISTRANT}' END FROM {{documents}}"""

ITEMS = f"""SELECT CASE doc_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '20-F' ELSE '8-K' END, ' ' || CAST(1 + doc_id % 20 AS STRING) || CASE WHEN doc_id % 5 = 0 THEN 'a' ELSE '' END,
  {_TEXT} || ' ' || {_ID} || CASE doc_id % 7 WHEN 0 THEN ' of Related Parties' WHEN 1 THEN ' a beneficial owner' ELSE '' END FROM {{documents}}"""

_PAGES = f"SELECT 1000 + doc_id AS doc, {_TEXT} AS text FROM {{documents}}"
PAGES = f"""SELECT doc, 1, substr(text, 1, 200) FROM ({_PAGES}) p UNION ALL SELECT doc, 2, substr(text, 201, 500) FROM ({_PAGES}) p
  UNION ALL SELECT doc, 3, substr(text, 701) FROM ({_PAGES}) p"""
SPOTS = """SELECT 1000 + doc_id, doc_id % 190, 150 + doc_id % 100 FROM {documents} UNION ALL SELECT 1000 + doc_id, 200 + doc_id % 9, 720 FROM {documents}
  UNION ALL SELECT 1000 + doc_id, 690 + doc_id % 30, 705 + n_chars FROM {documents}"""
BOUNDS = """SELECT 1000 + doc_id, 20 + doc_id % 40, 'Item 1' FROM {documents} UNION ALL SELECT 1000 + doc_id, 201 + doc_id % 7, 'Item 1A' FROM {documents}"""

STRUCTURED = f"""SELECT 1000 + doc_id, CASE WHEN doc_id % 5 = 0 THEN {_TEXT} ELSE 'PART I' || {NL} || {NL} || 'Item 1. Business' || {NL} || {_TEXT} || {NL}
  || '  ITEM ' || CAST(1 + doc_id % 9 AS STRING) || 'A. Risk' || {NL} || repeat(source || ' ', CAST(20 + doc_id % 30 AS INT)) || {NL} || 'Item 2. Short' || {NL} || lang || {NL}
  || 'PART II' || {NL} || 'Item 7. Results' || {NL} || {_TEXT} END FROM {{documents}}"""

NAMES = """SELECT source || CASE doc_id % 3 WHEN 0 THEN '-inc' WHEN 1 THEN '_' || upper(lang) || '_holdings' ELSE '-technologies-corp' END || CAST(doc_id AS STRING),
  CASE WHEN doc_id % 4 > 0 THEN 2014 + doc_id % 9 END, doc_id FROM {documents}"""

FILED = f"""SELECT source || '-inc', upper(source), 2014 + doc_id % 9, 'Total assets $ ' || CAST(1000 + doc_id AS STRING) || ' (1,100)' || {NL} || {_TEXT} || {NL} || 'Net income (loss) before taxes 55 44' || {NL}
  || 'Net  Sales ' || CAST(n_chars AS STRING) || ' n/a' || {NL} || 'Gross profit: — 500' || {NL} || 'Total Stockholders’ equity (' || CAST(doc_id % 2000 AS STRING) || ')' FROM {{documents}}"""

_FACT = """SELECT lower(substr('KLMNOPQRSTUVWXYZ', CAST(1 + doc_id % 16 AS INT), 1)) || CAST(doc_id AS STRING) || '-co' AS company,
  substr('KLMNOPQRSTUVWXYZ', CAST(1 + doc_id % 16 AS INT), 1) || CAST(doc_id AS STRING) AS ticker, {year} AS fiscal_year, 'net income' AS label,
  CAST(1000 + n_chars + {year} * (doc_id % 3) AS STRING) AS value FROM {{documents}}"""
FACTS = _FACT.replace("{year}", "2019").replace("{{", "{").replace("}}", "}") + " UNION ALL " + _FACT.replace("{year}", "2020").replace("{{", "{").replace("}}", "}")

SCORES_A = """SELECT 'd' || CAST(doc_id AS STRING), CAST(doc_id % 9 AS DOUBLE) / 8, CAST(CASE WHEN doc_id % 11 > 0 THEN length(text) % 17 END AS DOUBLE) / 16 FROM {documents}"""
SCORES_B = """SELECT 'd' || CAST(doc_id AS STRING), CAST(n_chars % 9 AS DOUBLE) / 8, CAST(length(text) % 9 AS DOUBLE) / 8 FROM {documents} WHERE lang <> 'fr'"""
RANKED = """SELECT 1000 + doc_id, 1, CAST(doc_id % 2 AS DOUBLE) FROM {documents} UNION ALL SELECT 1000 + doc_id, 2, CAST(length(text) % 2 AS DOUBLE) FROM {documents} WHERE text IS NOT NULL
  UNION ALL SELECT 1000 + doc_id, 3, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END FROM {documents}"""

ANSWERS = """SELECT 'd' || CAST(doc_id AS STRING), 'what does ' || source || ' say?', CASE WHEN doc_id % 5 = 0 THEN '' ELSE md5(text) END,
  CASE doc_id % 4 WHEN 0 THEN 'pipeline_error' WHEN 1 THEN ' ' WHEN 2 THEN 'ok' END FROM {documents}"""
LIVE = """SELECT CASE WHEN lang = 'en' THEN 'e' ELSE 'd' END || CAST(doc_id AS STRING), 'what does ' || CASE WHEN lang = 'de' THEN lang ELSE source END || ' say?', CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END,
  CASE doc_id % 7 WHEN 0 THEN 'generation_error' ELSE 'ok' END FROM {documents}"""
ELIGIBLE = """SELECT 1000 + doc_id, CASE WHEN lang = 'en' THEN 'off_topic' ELSE 'exact_fact' END, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END,
  CASE doc_id % 4 WHEN 0 THEN 'low_confidence' WHEN 1 THEN NULL ELSE 'ok' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END FROM {documents}"""

CHATS = """SELECT 100000 + 1000 * conv_id + turn, CASE conv_id % 4 WHEN 0 THEN 'Should I buy AAPL in 2019? ' WHEN 1 THEN 'Aplied Materials margins ' WHEN 2 THEN '¿Es la mejor de 1998? ' ELSE '' END || text
  FROM {conversations} WHERE role = 'user' AND text IS NOT NULL"""
NATIONS = "SELECT lower(n_name), upper(n_name) FROM {nation}"

_FOUND = f"SELECT 1000 + doc_id AS k, CASE WHEN doc_id % 6 = 0 THEN 'should i buy ' ELSE '' END || {_TEXT} AS q, source, lang, n_chars, doc_id FROM {{documents}}"
FOUND = f"""SELECT k, q, 0, source, CAST(n_chars % 16 AS DOUBLE) / 16, CASE doc_id % 3 WHEN 0 THEN NULL ELSE doc_id % 3 = 1 END FROM ({_FOUND}) f
  UNION ALL SELECT k, q, 1, CASE WHEN lang = 'en' THEN source ELSE lang END, CAST(doc_id % 15 AS DOUBLE) / 16, CASE WHEN doc_id % 2 = 0 THEN false END FROM ({_FOUND}) f"""
REPLIES = """SELECT 1000 + doc_id, CASE doc_id % 4 WHEN 0 THEN 'NOT_IN_CONTEXT: ' WHEN 1 THEN 'It cannot be determined: ' ELSE '' END || text FROM {documents}"""

IDS = f"""SELECT 1000 + doc_id, CASE doc_id % 6 WHEN 0 THEN upper(u) WHEN 1 THEN chr(123) || u || chr(125) WHEN 2 THEN 'urn:uuid:' || u WHEN 3 THEN md5({_ID}) WHEN 4 THEN substr(u, 2) ELSE source END
  FROM (SELECT doc_id, source, {_uuid(_ID)} AS u FROM {{documents}}) i"""
KNOWN_CHATS = f"SELECT {_uuid(_ID)}, CASE WHEN lang = 'en' THEN doc_id END, CASE WHEN doc_id % 3 > 0 THEN source END, doc_id, doc_id + 1 FROM {{documents}}"
ASKED = f"SELECT upper({_uuid(f'''CASE WHEN lang = 'fr' THEN 'new' ELSE '' END || {_ID}''')}), 7 + doc_id, lang, 1000000 + doc_id FROM {{documents}}"
FEEDBACK = f"""SELECT 1000 + doc_id, CASE WHEN doc_id % 5 > 0 THEN doc_id END, CASE WHEN lang = 'fr' THEN {_uuid(_ID)} ELSE '6f9619ff-8b86-d011-b42d-00c04fc964ff' END,
  CASE doc_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE source END FROM {{documents}}"""
TURNS = f"""SELECT CASE WHEN lang = 'fr' THEN source ELSE '6F9619FF8B86D011B42D00C04FC964FF' END, 100 + doc_id, 'what of ' || source || '?', {_TEXT}, CASE WHEN lang = 'en' THEN 'ok' END FROM {{documents}}"""

TITLES = """SELECT 1000 + doc_id, CASE doc_id % 4 WHEN 0 THEN replace(substr(text, 1, 40), chr(10), ' ') WHEN 1 THEN '' WHEN 2 THEN 'Unknown' END, CASE WHEN doc_id % 3 > 0 THEN source || '.pdf' ELSE '' END, lang,
  CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 END, CASE WHEN doc_id % 7 > 0 THEN 4 + doc_id % 5 END FROM {documents}"""

_FILING = f"SELECT 'd' || {_ID} || '/' || source || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-corp' END || '/NASDAQ_' || upper(lang) || '_' || {_YEAR} || '.pdf' AS path, source, lang, {_TEXT} AS text, doc_id FROM {{documents}}"
FILING = f"""SELECT path, 1, 'letter to holders' FROM ({_FILING}) f
  UNION ALL SELECT path, 2, CASE WHEN doc_id % 4 = 0 THEN 'no cover' ELSE {_COVER} END FROM ({_FILING}) f
  UNION ALL SELECT path, 3, source || ', Inc.' || {NL} || 'Item 1. Business ..... 4' || {NL} || 'Item 1A. Risk ..... 5' || {NL} || 'Item 7. Results ..... 6' FROM ({_FILING}) f
  UNION ALL SELECT path, 4, source || ', Inc.' || {NL} || 'Item 1. Business' || {NL} || text || 'account-' || {NL} || 'ants' FROM ({_FILING}) f
  UNION ALL SELECT path, 5, source || ', Inc.' || {NL} || 'Item 1A. Risk' || {NL} || repeat('risk is high ', CAST(10 + doc_id % 60 AS INT)) || {NL} || 'Total assets $ 1,234 1,100' FROM ({_FILING}) f"""

REMOTE = "SELECT CAST(doc_id AS STRING) || '.pdf', n_chars FROM {documents}"
LOCAL = "SELECT CAST(doc_id AS STRING) || '.pdf', CASE WHEN lang = 'fr' THEN n_chars - 1 ELSE n_chars END FROM {documents} WHERE source <> 'src1'"
FILES = f"""SELECT source, CASE WHEN doc_id % 9 = 0 AND doc_id % 5 > 0 THEN 'x' ELSE '' END || {_ID}, CASE WHEN doc_id % 8 > 0 THEN text END, CASE WHEN doc_id % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(doc_id AS DOUBLE) END,
  CASE WHEN doc_id % 6 > 0 THEN CAST(doc_id + 1 AS DOUBLE) END, upper(source), source, CAST(2014 + doc_id % 9 AS DOUBLE), CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 = 1 END FROM {{documents}}"""
LABELS = """SELECT 1000 + doc_id, CASE doc_id % 5 WHEN 0 THEN 'Total  Revenues' WHEN 1 THEN 'Net (loss) income' WHEN 2 THEN 'Research & Development' WHEN 3 THEN 'Gross profit.' ELSE source END,
  source || CASE doc_id % 3 WHEN 0 THEN '-Holdings, Inc.' WHEN 1 THEN '_ltd' ELSE '/' || lang END FROM {documents}"""
NUMBERS = """SELECT 1000 + doc_id, CASE doc_id % 10 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) / 7 END FROM {documents}"""
FILTERS = "SELECT CASE WHEN doc_id % 3 > 0 THEN source END, CASE WHEN doc_id % 4 > 0 THEN 2014 + doc_id % 9 END FROM {documents}"
SOURCES = """SELECT 1000 + doc_id, lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END, CASE WHEN doc_id % 3 > 0 THEN lang END,
  CASE WHEN doc_id % 7 > 0 THEN doc_id % 9 END, CASE WHEN doc_id % 4 > 0 THEN 4 + doc_id % 5 END FROM {documents}"""
SHOWN = """SELECT 1000 + doc_id, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN ' ' END, CASE WHEN doc_id % 4 = 0 THEN lang ELSE '' END, CASE WHEN doc_id % 5 > 1 THEN source || '.pdf' END,
  CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 6 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(2014 + doc_id % 9 AS DOUBLE) END, source || ' of ' || lang, CASE WHEN doc_id % 8 > 2 THEN md5(text) END FROM {documents}"""
