"""Registered queries over small fixtures, for what the shared tables never trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import filing, gate, udfs
from foliant.functions import text as T
from foliant.operators import batches, chatlog, chunk, cleaning, evals, facts, glued, resolve, sections
from foliant.plans import derived
from foliant.plans.registry import SQL, Fixture, query, table
from foliant.plans.sql_parts import LABELS_SQL, core_tokens_sql, display_sql, glued_sql, label_key_sql, normal_name_sql, ratios_sql, registrant_sql, typo_sql, uuid_sql, words_sql
from foliant.session import fresh_path

TEXTS = Fixture(
    "id long,text string",
    (
        (1, "Item 1. Business ........ 3\nItem 1A. Risk Factors . . . . . 9\nItem 2. Properties.......12\nEnd"),
        (2, "March 31, 2016 ...... $ 7.64 $ 5.32\nJune 30 ..... 1 2\nTotal ....... 5"),
        (3, "The account-\nants were glad-\nHanded.\n\n\n\nMore  \t text\n \n here. "),
        (4, ""),
        (5, "thequickbrownfoxjumps over internationalization a.b.c ... d"),
        (6, "Plain (1,234) 5% $6.0 -7 eight 9x"),
    ),
    derived.TEXTS
)


@query(rf"SELECT id, len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: regexp_matches(x, '^.+?\.(?:\s?\.){{3,}}\s*\d+\s*$'))) >= 3 AS toc FROM {TEXTS.sql}")
def f02_toc_pages(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", T.is_toc(F.col("text")).alias("toc"))


@query(rf"SELECT id, regexp_replace(text, '\.(?:\s?\.){{3,}}', ' ... ', 'g') AS text FROM {TEXTS.sql}")
def f03_dot_leaders(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", T.collapse_dots(F.col("text")).alias("text"))


@query(rf"SELECT id, {glued_sql('text')} AS n FROM {TEXTS.sql}")
def f04_glued_count(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", T.glued_count(F.col("text")).alias("n"))


@query()
def f04_deglue(spark, sf_dir):
    cut = udfs.deglue("the over a quick brown fox jumps nation international".split())
    return TEXTS.df(spark, sf_dir).select("id", cut(F.col("text")).alias("text"))


@query(rf"SELECT id, regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g') AS text FROM {TEXTS.sql}")
def f05_dehyphenate(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", T.dehyphenate(F.col("text")).alias("text"))


@query(rf"SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM {TEXTS.sql}")
def f06_whitespace(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", T.normalize_space(F.col("text")).alias("text"))


@query()
def f04_corpus_words(spark, sf_dir):
    """Four words of each document glued on purpose, cut by the words of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    words = F.filter(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.length(w).between(5, glued.GLUED - 1))
    made = docs.select("doc_id", F.array_join(F.slice(words, 1, 4), "").alias("glued")).withColumn("cut", F.col("glued"))
    return glued.deglued(made, glued.word_costs(docs), "doc_id", "cut")


@query()
def f07_nfkc(spark, sf_dir):
    """Documents with a ligature, a fraction and a control character before their texts."""
    odd = F.when(F.col("doc_id") % 3 == 0, F.lit("ﬁne ½\x00\x07\t")).otherwise(F.lit("plain\x0b "))
    return table(spark, sf_dir, "documents").select("doc_id", udfs.clean_unicode(F.concat(odd, "text")).alias("text"))


@query(rf"WITH t AS (SELECT id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM {TEXTS.sql}) SELECT id, w, length(regexp_replace(w, '[$,%()\-.\s]', '', 'g')) > 0 AND length(regexp_replace(regexp_replace(w, '[$,%()\-.\s]', '', 'g'), '[^0-9]', '', 'g')) >= 0.6 * length(regexp_replace(w, '[$,%()\-.\s]', '', 'g')) AS numeric FROM t")
def f16_numeric_tokens(spark, sf_dir):
    return TEXTS.df(spark, sf_dir).select("id", F.explode(T.tokens(F.col("text"))).alias("w")).select(
        "id", "w", T.is_numeric(F.col("w")).alias("numeric")
    )


PATHS = Fixture(
    "path string,cover string",
    (
        ("x/21vianet-group-inc/NASDAQ_VNET_2019.pdf", "FORM 20-F\nANNUAL REPORT PURSUANT TO SECTION 13 OR 15(d)\nfor the fiscal year ended December 31, 2018\nVNET Group, Inc.\n(Exact Name of Registrant as Specified in its Charter)\nbasis of accounting: [x] US GAAP [ ] International Financial Reporting Standards [ ] Other"),
        ("y/3d-systems-corp/NASDAQ_DDD_2021.pdf", "FORM 20-F the REPORT PURSUANT TO SECTION 13 OR 15(d)\n36Kr Holdings Inc.\n(Exact name of registrant as specified in its charter)\nbasis of accounting US GAAP ☒ International Financial Reporting Standards x Other"),
        ("z/acadia-pharmaceuticals-inc/AMEX_ACAD_2018.pdf", "FORM10-K ANNUALREPORTPURSUANTTOSECTION13OR15(d) For the year ended 2018\nACADIA PHARMACEUTICALS INC.\n(ExactNameofRegistrantasSpecifiedinItsCharter)"),
        ("w\\t2-biosystems\\nasdaq_ttoo_2016.pdf", "FORM 10-K REPORT PURSUANT TO SECTION 13 OR 15(d)\nT2 Biosys tems, Inc.\n(Exact Name of Registrant as Specified in its Charter)"),
        ("v/eldorado-resorts-inc/NASDAQ_ERI_2020.pdf", "FORM 10-K REPORT PURSUANT TO SECTION 13 OR 15(d)\nCAESARS ENTERTAINMENT, INC.\n(Exact Name of Registrant as Specified in its Charter)\na corporation formerly known as Eldorado Resorts, Inc."),
        ("u/none/file.pdf", "Commission file number: 1\n(Exact Name of Registrant as Specified in its Charter)"),
        ("lonely.pdf", ""),
    ),
    derived.PATHS
)


@query(rf"SELECT path, coalesce(list_reverse(string_split(replace(path, '\', '/'), '/'))[2], '') AS company, nullif(upper(regexp_extract(path, '(?i)NASDAQ_([A-Z]+)_(\d{{4}})', 1)), '') AS ticker, TRY_CAST(regexp_extract(path, '(?i)NASDAQ_([A-Z]+)_(\d{{4}})', 2) AS BIGINT) AS year, regexp_replace(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '\.pdf$', '') AS base FROM {PATHS.sql}")
def f18_filename_meta(spark, sf_dir):
    p = F.col("path")
    return PATHS.df(spark, sf_dir).select(
        "path",
        filing.company(p).alias("company"),
        filing.ticker(p).alias("ticker"),
        filing.filename_year(p).alias("year"),
        T.base_name(p).alias("base")
    )


_FORM_SQL = r"nullif(upper(regexp_extract(cover, '(?is)FORM\s*(10-K|20-F).{0,400}?REPORT\s*PURSUANT\s*TO\s*SECTION\s*13\s*OR\s*15\(d\)', 1)), '')"


@query(f"SELECT path, {_FORM_SQL} AS form_type FROM {PATHS.sql}")
def f19_form_type(spark, sf_dir):
    return PATHS.df(spark, sf_dir).select("path", filing.form_type(F.col("cover")).alias("form_type"))


_YEAR_SQL = r"TRY_CAST(regexp_extract(cover, '(?i)(?:fiscal\s+year\s+ended|for\s+the\s+year\s+ended)\D{0,10}(?:\w+\s+\d{1,2},?\s+)?(\d{4})', 1) AS BIGINT)"
_FILE_YEAR_SQL = r"TRY_CAST(regexp_extract(path, '(?i)NASDAQ_([A-Z]+)_(\d{4})', 2) AS BIGINT)"


@query(f"SELECT path, coalesce({_YEAR_SQL}, {_FILE_YEAR_SQL}) AS fiscal_year, {_YEAR_SQL} = {_FILE_YEAR_SQL} AS matches FROM {PATHS.sql}")
def f20_fiscal_year(spark, sf_dir):
    return PATHS.df(spark, sf_dir).select(
        "path",
        filing.fiscal_year(F.col("cover"), F.col("path")).alias("fiscal_year"),
        (filing.cover_year(F.col("cover")) == filing.filename_year(F.col("path"))).alias("matches")
    )


@query(rf"""WITH b AS (SELECT path, {_FORM_SQL} AS form, regexp_extract(cover, '(?is)basis of accounting.{{0,600}}') AS block FROM {PATHS.sql}),
m AS (SELECT path, form, list_filter([CASE WHEN regexp_matches(block, '[xX☒]\s*U\.?S\.?\s*GAAP') THEN 'US GAAP' END, CASE WHEN regexp_matches(block, '[xX☒]\s*International\s+Financial\s+Reporting\s+Standards') THEN 'IFRS' END, CASE WHEN regexp_matches(block, '[xX☒]\s*Other') THEN 'Other' END], lambda x: x IS NOT NULL) AS marked FROM b)
SELECT path, CASE WHEN form = '10-K' THEN 'US GAAP' WHEN form = '20-F' AND len(marked) = 1 THEN marked[1] END AS standard FROM m""")
def f21_accounting(spark, sf_dir):
    return PATHS.df(spark, sf_dir).select("path", filing.accounting_standard(filing.form_type(F.col("cover")), F.col("cover")).alias("standard"))


@query(registrant_sql(PATHS.sql))
def f25_mismatch(spark, sf_dir):
    told = PATHS.df(spark, sf_dir).select("path", filing.registrant(filing.company(F.col("path")), F.col("cover")).alias("r"))
    return told.select("path", F.col("r.name").alias("registrant"), "r.mismatch")


@query(f"""SELECT path, a.company, a.ticker, b.form_type, c.fiscal_year, c.matches AS year_matches_file, d.standard AS accounting_standard, e.registrant AS registrant_name, e.mismatch AS company_name_mismatch
FROM ({SQL["f18_filename_meta"]}) a JOIN ({SQL["f19_form_type"]}) b USING (path) JOIN ({SQL["f20_fiscal_year"]}) c USING (path) JOIN ({SQL["f21_accounting"]}) d USING (path) JOIN ({SQL["f25_mismatch"]}) e USING (path)""")
def f26_metadata(spark, sf_dir):
    return cleaning.document_metadata(PATHS.df(spark, sf_dir), "path", "cover")


ITEMS = Fixture(
    "form_type string,item string,text string",
    (
        ("10-K", "1A", ""),
        ("20-F", "3.d", None),
        ("20-F", "7", "the Beneficial Owner table"),
        ("20-F", "7", "related party deals"),
        ("20-F", "7", "filler"),
        ("20-F", " 4 ", "x"),
        ("10-K", "99", "x"),
        ("8-K", "1", "x"),
        (None, None, None)
    ),
    derived.ITEMS
)
_LOOKUP_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{form}', '{item.upper()}', '{name}', {i})" for i, (name, k, f) in enumerate(sections.SECTIONS) for form, items in (
        ("10-K", k), ("20-F", f)
    ) for item in items.split()
) + ") AS t(f, i, section, place))"


@query(f"""WITH c AS (SELECT form_type, item, text, list(section ORDER BY place) FILTER (section IS NOT NULL) AS s FROM {ITEMS.sql} x LEFT JOIN {_LOOKUP_SQL} ON form_type = f AND upper(trim(item)) = i GROUP BY 1, 2, 3)
SELECT form_type, item, text, CASE WHEN coalesce(len(s), 0) <= 1 THEN s[1] WHEN list_contains(s, 'security_ownership') AND (contains(lower(text), 'beneficial owner') OR contains(lower(text), 'share ownership') OR contains(lower(text), 'shares beneficially owned')) THEN 'security_ownership' WHEN list_contains(s, 'related_party_transactions') AND (contains(lower(text), 'related part') OR contains(lower(text), 'related-party') OR contains(lower(text), 'affiliated transaction')) THEN 'related_party_transactions' END AS section FROM c""")
def j05_canonical_section(spark, sf_dir):
    return sections.canonical_section(ITEMS.df(spark, sf_dir))


PAGES = Fixture(
    "doc long,page_number int,text string", tuple((d, p, f"page {p} of {d} " + "word " * (p * d)) for d in (1, 2) for p in (1, 2, 3)),
    derived.PAGES
)
SPOTS = Fixture("doc long,char_start int,char_end int", ((1, 0, 5), (1, 15, 40), (1, 22, 30), (1, 40, 500), (2, 3, 60), (3, 0, 4)), derived.SPOTS)
_OFFSETS_SQL = f"(SELECT doc, page_number, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(text) AS n FROM {PAGES.sql})"


@query(f"SELECT doc, page_number, s AS start, s + n AS \"end\" FROM {_OFFSETS_SQL}")
def w04_page_offsets(spark, sf_dir):
    return chunk.page_offsets(PAGES.df(spark, sf_dir), "doc")


def _page_sql(at: str) -> str:
    return f"CASE WHEN {at} >= (SELECT max(s + n) FROM {_OFFSETS_SQL} o WHERE o.doc = c.doc) THEN (SELECT max(page_number) FROM {_OFFSETS_SQL} o WHERE o.doc = c.doc) ELSE (SELECT min(page_number) FROM {_OFFSETS_SQL} o WHERE o.doc = c.doc AND s <= {at} AND {at} < s + n) END"


@query(f"SELECT doc, char_start, char_end, {_page_sql('char_start')} AS page_start, {_page_sql('(char_end - 1)')} AS page_end FROM {SPOTS.sql} c")
def j02_page_lookup(spark, sf_dir):
    return chunk.with_pages(SPOTS.df(spark, sf_dir), chunk.page_offsets(PAGES.df(spark, sf_dir), "doc"), "doc")


BOUNDS = Fixture("doc long,start int,label string", ((1, 10, "Item 1"), (1, 22, "Item 1A"), (2, 0, "Part I")), derived.BOUNDS)


@query(f"SELECT c.doc, c.char_start, c.char_end, b.label FROM {SPOTS.sql} c ASOF LEFT JOIN {BOUNDS.sql} b ON c.doc = b.doc AND c.char_start >= b.start")
def j03_section_asof(spark, sf_dir):
    return chunk.with_label(SPOTS.df(spark, sf_dir), BOUNDS.df(spark, sf_dir), "doc")


STRUCTURED = Fixture(
    "doc long,text string",
    (
        (
            1,
            "PART I\n\nItem 1. Business\n" + "word " * 500 + "\n  ITEM 1A. Risk\n" + "risk " * 40 + "\nItem 2. Short\nfew words\nPART II\nItem 7. Results\n" + "sum " * 60
        ),
        (2, "no headings " * 10),
        (3, "Items of note\nPART X marks\nItem 5 - end " + "tail " * 30)
    ),
    derived.STRUCTURED
)


def _heads_sql(pattern: str, label: str) -> str:
    """Starts and labels of headings: what is before, between and behind them, and the headings themselves, summed up."""
    return f"""SELECT doc, text, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, '{label} ' || upper(n[i]) AS label
FROM (SELECT doc, text, b, h, n, unnest(generate_series(1, len(h))) AS i FROM (SELECT doc, text, string_split_regex(text, '{pattern}') AS b, regexp_extract_all(text, '{pattern}') AS h, regexp_extract_all(text, '{pattern}', 1) AS n FROM {STRUCTURED.sql}))"""


_HEADS = _heads_sql(
    r"(?im)^\s*ITEM\s*(\d+[A-Z]?(?:\.\d+)?(?:\.[A-Z])?)\.?[\s—-]", "Item"
) + " UNION ALL " + _heads_sql(r"(?im)^\s*PART\s*([IVX]+)\b", "Part")
SECTIONS_CTE = f"""heads AS ({_HEADS}),
ended AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY doc ORDER BY start), length(text)) AS "end" FROM heads),
sections AS (SELECT doc, text, start, "end", label FROM ended WHERE len({words_sql('substr(text, start + 1, "end" - start)')}) >= 30)"""


@query(f"SELECT doc, start, label FROM ({_HEADS})")
def f11_boundaries(spark, sf_dir):
    return STRUCTURED.df(spark, sf_dir).select("doc", F.explode(chunk.boundaries(F.col("text"))).alias("b")).select("doc", "b.start", "b.label")


@query(rf"""WITH {SECTIONS_CTE},
bodies AS (SELECT d.doc, s.label, coalesce(s.start, 0) AS section_start, string_split(regexp_replace(CASE WHEN s.label IS NULL THEN d.text ELSE substr(d.text, s.start + 1, s."end" - s.start) END, '^\s+|\s+$', '', 'g'), ' ') AS u FROM {STRUCTURED.sql} d LEFT JOIN sections s USING (doc)),
w AS (SELECT *, unnest(generate_series(0, CAST(greatest(ceil((len(u) - 350) / 300.0), 0) AS BIGINT))) AS i FROM bodies)
SELECT doc, label, CASE WHEN label LIKE 'Item%' THEN trim(replace(label, 'Item', '')) END AS item, CASE WHEN label LIKE 'Part%' THEN trim(replace(label, 'Part', '')) END AS part, section_start, i AS chunk_index, length(array_to_string(u[i * 300 + 1:i * 300 + 350], ' ')) + CASE WHEN i * 300 + 350 < len(u) THEN 1 ELSE 0 END AS n FROM w""")
def f13_structure_chunks(spark, sf_dir):
    rows = chunk.structure_chunks(STRUCTURED.df(spark, sf_dir), "doc")
    return rows.select(
        "doc",
        "label",
        chunk.item_number(F.col("label")).alias("item"),
        chunk.part_number(F.col("label")).alias("part"),
        "section_start",
        "chunk_index",
        F.length("content").alias("n")
    )


NAMES = Fixture(
    "company string,year int,i long",
    (("apple-inc", 2020, 0), ("9f-inc", None, 1), ("AMD-corp", 2021, 2), ("group-holdings", 2022, 3)),
    derived.NAMES
)


@query(f"SELECT company, concat_ws('_', company, coalesce(CAST(year AS VARCHAR), 'unk'), CAST(i AS VARCHAR)) AS chunk_id FROM {NAMES.sql}")
def f15_chunk_id(spark, sf_dir):
    return NAMES.df(spark, sf_dir).select("company", chunk.chunk_id(F.col("company"), F.col("year"), F.col("i")).alias("chunk_id"))


@query(f"SELECT company, name, {typo_sql('name')} AS typo FROM (SELECT company, {display_sql('company')} AS name FROM {NAMES.sql})")
def f29_display_names(spark, sf_dir):
    name = T.display_name(F.col("company"))
    return NAMES.df(spark, sf_dir).select("company", name.alias("name"), T.misspelt(name).alias("typo"))


FILED = Fixture(
    "company string,ticker string,fiscal_year int,content string",
    (
        ("acme-inc", "ACME", 2020, "Total assets $ 1,234 1,100\nNet income (loss) before income taxes 55 44\nNet income per share 1.20\nNet income 246 2,367"),
        ("acme-inc", "ACME", 2021, "Total assets: $ 1,500 1,234\nGross profit — 500\nGross profit 12\nNet  Sales 999,999.5 (1) n/a"),
        ("acme-tools", "ACMT", 2020, "Research and development expenses (2,367) 1,000\nTotal Stockholders’ equity $(4,000)"),
        ("acme-tools", "ACMT", 2021, "Research and development (2,367) 2,367"),
        ("beta-corp", "", 2019, "Cash and cash equivalents ... nothing\nTotal liabilities 100 200 300 400 500 600 700"),
    ),
    derived.FILED
)


_NUM_SQL = r"\$?\s*\(?\s*\d[\d,]*(?:\.\d+)?\s*\)?"
_COL_SQL = rf"(?:{_NUM_SQL}|(?:[—–-]+|n/?a))"
_LINE_SQL = rf"^([A-Za-z][A-Za-z''’()&/,.\s-]{{2,60}}?)\s*[:.]?\s*({_COL_SQL}(?:\s+{_COL_SQL}){{0,7}})\s*$"


@query(rf"""WITH l AS (SELECT company, ticker, fiscal_year, trim(unnest(string_split(content, chr(10)))) AS line FROM {FILED.sql}),
p AS (SELECT company, ticker, fiscal_year, regexp_extract(line, '{_LINE_SQL}', 1) AS raw, regexp_extract_all(regexp_extract(line, '{_LINE_SQL}', 2), '{_COL_SQL}') AS c FROM l WHERE length(line) BETWEEN 10 AND 320 AND NOT regexp_matches(line, '(?i)per share|per diluted|%|percent') AND regexp_matches(line, '{_LINE_SQL}'))
SELECT company, ticker, fiscal_year, l.label, regexp_replace(trim(c[1]), '\s+', '', 'g') AS value, len(c) AS n_figures FROM p JOIN {LABELS_SQL} l ON l.name = {label_key_sql('p.raw')}
WHERE len(c) BETWEEN 1 AND 6 AND NOT regexp_matches(trim(c[1]), '^(?:[—–-]+|n/?a)$') AND length(regexp_replace(c[1], '[^0-9]', '', 'g')) >= 3""")
def f32_fact_lines(spark, sf_dir):
    return facts.fact_lines(FILED.df(spark, sf_dir)).drop("source_line")


FACTS = Fixture(
    "company string,ticker string,fiscal_year int,label string,value string",
    tuple(
        (
            f"{n}-co{i}", f"{n[0].upper()}{i}", y, "net income", str(1000 + i * 7 + y * (i % 3))
        ) for i, n in enumerate(
            ("alpha", "axis", "acorn", "apex", "beta", "bolt", "core", "crane", "delta", "dawn")
        ) for y in (2019, 2020)
    ),
    derived.FACTS
)


@query(f"SELECT * FROM {FACTS.sql} f WHERE NOT EXISTS (SELECT 1 FROM {FACTS.sql} g WHERE g.company = f.company AND g.label = f.label AND g.value = f.value AND g.fiscal_year <> f.fiscal_year)")
def a23_repeat_values(spark, sf_dir):
    return facts.year_specific(FACTS.df(spark, sf_dir))


@query("WITH c AS (SELECT DISTINCT source AS company, left(source, 4) AS head FROM documents), g AS (SELECT head, list_sort(list(company)) AS two FROM c GROUP BY head) SELECT head, two[1] AS first, two[2] AS second FROM g WHERE len(two) >= 2 AND length(head) >= 4")
def j13_confusable(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.substring("source", 1, 4), F.lit("-"), "source").alias("company")).distinct()
    found = facts.confusable(rows)
    cut = lambda c: F.substring(c, 6, 100)
    return found.select("head", cut("first").alias("first"), cut("second").alias("second"))


@query(f"SELECT a.company, a.label, a.fiscal_year AS first_year, a.value AS first_value, b.fiscal_year AS last_year, b.value AS last_value FROM {FACTS.sql} a JOIN {FACTS.sql} b ON a.company = b.company AND a.label = b.label AND a.fiscal_year = 2019 AND b.fiscal_year = 2020 AND a.value <> b.value")
def j14_year_pairs(spark, sf_dir):
    return facts.year_pairs(FACTS.df(spark, sf_dir))


@query(f"""WITH h AS (SELECT *, upper(left(coalesce(nullif(ticker, ''), company), 1)) AS letter, md5(company || label || '|{facts.SEED}') AS h FROM {FACTS.sql}),
one AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY company ORDER BY h, label, value) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY letter ORDER BY h, company) AS turn FROM one)
SELECT letter, turn, company, fiscal_year FROM t WHERE letter <> 'A' OR turn <= 2 ORDER BY turn, letter LIMIT 6""")
def w07_stratified(spark, sf_dir):
    return facts.stratified(FACTS.df(spark, sf_dir), 6, F.concat("company", "label")).select("letter", "turn", "company", "fiscal_year")


_KNOWN_SQL = "(VALUES " + ", ".join(f"({i}, '{t}', '{n}')" for i, (t, n) in enumerate(facts.KNOWN.items())) + ") AS k(place, ticker, name)"


@query(f"SELECT ticker, name FROM {_KNOWN_SQL} WHERE ticker NOT IN (SELECT upper(ticker) FROM {FACTS.sql}) ORDER BY place LIMIT 4")
def j12_absent(spark, sf_dir):
    return facts.absent(spark, FACTS.df(spark, sf_dir))


_MINED_SQL = f"(SELECT *, {display_sql('company')} AS name FROM {FACTS.sql})"


@query(f"""WITH q AS (SELECT 0 AS part, 'exact_fact' AS category, 'What was ' || ticker || '''s ' || label || ' in fiscal ' || fiscal_year || '?' AS question, * FROM {_MINED_SQL}
UNION ALL SELECT 1, 'typo_tolerance', 'What was ' || {typo_sql('name')} || '''s ' || label || ' in fiscal ' || fiscal_year || '?', * FROM {_MINED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY company, question) AS r FROM q)
SELECT row_number() OVER (ORDER BY part, company, question) AS id, category, question, company, ticker, fiscal_year, upper(left(label, 1)) || lower(substr(label, 2)) || ': ' || value || ' (' || name || ', FY' || fiscal_year || ')' AS ground_truth_answer, 'mined' AS source FROM r WHERE r <= CASE part WHEN 0 THEN 3 ELSE 2 END""")
def f42_questions(spark, sf_dir):
    rows = FACTS.df(spark, sf_dir)
    parts = [facts.questions(rows, "exact_fact", facts.ASKED_BY_TICKER), facts.questions(rows, "typo_tolerance", facts.ASKED_WITH_TYPO)]
    return facts.question_set(parts, [3, 2])


@query()
def f42_evaluation_set(spark, sf_dir):
    # A dozen categories are drawn from the facts, so they are written once.
    path = fresh_path(spark, "facts")
    FACTS.df(spark, sf_dir).write.parquet(path)
    kept = spark.read.parquet(path)
    rows = kept.withColumns(
        {"n_figures": (F.col("fiscal_year") - 2017).cast("int"), "source_line": F.concat("label", F.lit(" "), "value")}
    )
    return facts.evaluation_set(rows, kept.select("company", "ticker").distinct())


SCORES_A = Fixture("id string,m1 double,m2 double", (("1", 0.2, 0.9), ("2", 0.7, 0.4), ("3", 0.6, None), ("4", 1.0, 0.5), ("9", 0.1, 0.1)), derived.SCORES_A)
SCORES_B = Fixture("id string,m1 double,m2 double", (("1", 0.3, 0.8), ("2", 0.4, 0.6), ("3", 0.6, 0.3), ("4", 0.9, 0.5)), derived.SCORES_B)


@query(f"""WITH a AS (UNPIVOT {SCORES_A.sql} ON m1, m2 INTO NAME metric VALUE a), b AS (UNPIVOT {SCORES_B.sql} ON m1, m2 INTO NAME metric VALUE b)
SELECT metric, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b) - avg(a), 6) AS shift, round(avg(abs(a - b)), 6) AS mad, round(max(abs(a - b)), 6) AS max_diff, round(corr(a, b), 6) AS r, round(avg(CASE WHEN (a >= 0.5) <> (b >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS flip_rate FROM a JOIN b USING (id, metric) GROUP BY metric""")
def a19_test_retest(spark, sf_dir):
    out = evals.test_retest(SCORES_A.df(spark, sf_dir), SCORES_B.df(spark, sf_dir), ["m1", "m2"])
    return out.select("metric", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query(f"SELECT a.id, round(coalesce(abs(a.m1 - b.m1), 0) + coalesce(abs(a.m2 - b.m2), 0), 6) AS drift FROM {SCORES_A.sql} a JOIN {SCORES_B.sql} b USING (id) ORDER BY 2 DESC, 1 LIMIT 3")
def a20_row_drift(spark, sf_dir):
    return evals.row_drift(SCORES_A.df(spark, sf_dir), SCORES_B.df(spark, sf_dir), ["m1", "m2"], limit=3).withColumn("drift", F.round("drift", 6))


@query(f"SELECT round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2 FROM {SCORES_A.sql}")
def a18_metric_means(spark, sf_dir):
    return evals.means(SCORES_A.df(spark, sf_dir), ["m1", "m2"]).select(F.round("m1", 6).alias("m1"), F.round("m2", 6).alias("m2"))


@query(f"SELECT * FROM {SCORES_A.sql} WHERE m1 IS NOT NULL AND m2 IS NOT NULL")
def p14_complete(spark, sf_dir):
    return evals.complete(SCORES_A.df(spark, sf_dir), ["m1", "m2"])


RANKED = Fixture(
    "id long,rank int,v double",
    tuple(
        (i, r, v) for i, vs in enumerate(
            ([0.0, 0.0, 0.0, 1.0], [1.0, 1.0], [0.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0, 0.0, 1.0])
        ) for r, v in enumerate(vs, 1)
    ),
    derived.RANKED
)


@query(f"SELECT id, round(coalesce(sum(hits / rank) FILTER (v = 1), 0) / (sum(v) + 1e-10), 6) AS ap FROM (SELECT *, sum(v) OVER (PARTITION BY id ORDER BY rank) AS hits FROM {RANKED.sql}) GROUP BY id")
def a27_average_precision(spark, sf_dir):
    rows = RANKED.df(spark, sf_dir).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v"))), lambda x: x["v"]).alias("v"))
    return rows.select("id", F.round(evals.average_precision(F.col("v")), 6).alias("ap"))


ANSWERS = Fixture(
    "id string,question string,answer string,confidence_flag string",
    (("1", "q1", "a", "ok"), ("2", "q2", "", "ok"), ("3", "q3", "b", "pipeline_error"), ("4", "q4", "c", None)),
    derived.ANSWERS
)
LIVE = Fixture(
    "id string,question string,answer string,confidence_flag string",
    (("1", "q1", "A", "ok"), ("2", "q2x", "B", "low_confidence"), ("3", "q3", "", "ok")),
    derived.LIVE
)
_USABLE = "answer IS NOT NULL AND answer <> '' AND coalesce(confidence_flag, '') NOT IN ('pipeline_error', 'generation_error')"


@query(f"SELECT id, question, answer, confidence_flag FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS r FROM (SELECT *, 0 AS p FROM {ANSWERS.sql} UNION ALL SELECT *, 1 FROM {LIVE.sql}) WHERE {_USABLE}) WHERE r = 1")
def u01_merge_outputs(spark, sf_dir):
    return batches.merged(ANSWERS.df(spark, sf_dir), LIVE.df(spark, sf_dir))


@query(f"SELECT id FROM {ANSWERS.sql} UNION SELECT id FROM {LIVE.sql} EXCEPT (SELECT id FROM {ANSWERS.sql} WHERE {_USABLE} UNION SELECT id FROM {LIVE.sql} WHERE {_USABLE})")
def u02_failed_ids(spark, sf_dir):
    return batches.failed_ids(ANSWERS.df(spark, sf_dir), LIVE.df(spark, sf_dir))


@query(f"SELECT a.* FROM {ANSWERS.sql} a JOIN (SELECT DISTINCT id, question FROM {LIVE.sql}) USING (id, question)")
def j10_reusable(spark, sf_dir):
    return batches.reusable(ANSWERS.df(spark, sf_dir), LIVE.df(spark, sf_dir))


ELIGIBLE = Fixture(
    "id long,category string,ground_truth_answer string,confidence_flag string,resolved_company string",
    (
        (1, "exact_fact", "x", "ok", "a"),
        (2, "off_topic", "x", "ok", "a"),
        (3, "exact_fact", "", "ok", "a"),
        (4, "exact_fact", "x", "generation_error", "a"),
        (5, "exact_fact", "x", "low_confidence", ""),
        (6, "exact_fact", "x", "ok", None)
    ),
    derived.ELIGIBLE
)


@query(f"SELECT id FROM {ELIGIBLE.sql} WHERE category = 'exact_fact' AND ground_truth_answer <> '' AND confidence_flag = 'ok' AND coalesce(resolved_company, '') <> ''")
def p13_eligible(spark, sf_dir):
    return evals.eligible(ELIGIBLE.df(spark, sf_dir), only_ok=True, only_resolved=True).select("id")


QUESTIONS = Fixture(
    "question_id long,question string",
    (
        (1, "What was AAOI's revenue in fiscal 2022?"), (2, "How did AAL perform in 2022?"), (3, "¿Cuál fue el ingreso de Antares Pharma en 2014?"), (4, "American Airlines Group's fleet depreciation"), (5, "What is the capital of France?"),
        (6, "¿Cuál es la mejor acción este año?"), (7, "What happened in the market in 2022?"), (8, "What are general trends in the pharma industry?"), (9, "Applied Optoelectronics margins 2019"), (10, "Applied Materials margins"), (11, "Is AAPL a good buy?"), (12, "Should I invest in Aple?"), (13, None), (14, ""),
    ),
)
#: The same and what users ask in conversations.
CHATS = Fixture(QUESTIONS.schema, QUESTIONS.rows, derived.CHATS)
ENTITIES = Fixture(
    "company string,ticker string",
    (
        ("antares-pharma-inc", None),
        ("applied-optoelectronics-inc", "AAOI"),
        ("american-airlines-group-inc", "AAL"),
        ("apple-inc", "AAPL"),
        ("applied-materials-inc", "AMAT")
    )
)


@query(rf"WITH w AS (SELECT DISTINCT question_id, unnest(regexp_split_to_array(upper(question), '[^\w]+')) AS t FROM {CHATS.sql}) SELECT question_id, min(company) AS company FROM w JOIN {ENTITIES.sql} ON t = ticker GROUP BY 1")
def e01_resolve_ticker(spark, sf_dir):
    return resolve.by_ticker(CHATS.df(spark, sf_dir), ENTITIES.df(spark, sf_dir)).select("question_id", "company")


@query(rf"""WITH RECURSIVE q AS MATERIALIZED (SELECT question_id, question, list_distinct({words_sql(normal_name_sql('question'))}) AS w FROM {CHATS.sql}),
n AS MATERIALIZED (SELECT DISTINCT company, list_distinct({core_tokens_sql(normal_name_sql('company'))}) AS parts FROM {ENTITIES.sql}),
words AS MATERIALIZED (SELECT question_id, unnest(w) AS pb FROM q), named AS MATERIALIZED (SELECT company, len(parts) AS n, unnest(parts) AS pa FROM n),
pairs AS MATERIALIZED (SELECT DISTINCT pa, pb FROM named, words), {ratios_sql('pairs')},
best AS (SELECT question_id, company, n, pa, max(ratio) AS ratio FROM words JOIN named ON true JOIN ratios USING (pa, pb) GROUP BY ALL),
whole AS (SELECT question_id, company, min(ratio) AS score FROM best WHERE ratio >= 0.8 GROUP BY question_id, company, n HAVING count(*) = n),
tickers AS (SELECT question_id, min(company) AS company FROM (SELECT DISTINCT question_id, unnest(regexp_split_to_array(upper(question), '[^\w]+')) AS t FROM q) JOIN {ENTITIES.sql} ON t = ticker GROUP BY 1),
found AS (SELECT question_id, company, CAST(1 AS DOUBLE) AS score FROM tickers UNION ALL SELECT question_id, arg_min(company, {{'s': -score, 'c': company}}), max(score) FROM whole WHERE question_id NOT IN (SELECT question_id FROM tickers) GROUP BY 1),
dated AS (SELECT question_id, company, round(score, 6) AS score, CASE WHEN company IS NOT NULL THEN TRY_CAST(regexp_extract(question, '\b((?:19|20)\d{{2}})\b', 1) AS BIGINT) END AS fiscal_year FROM q LEFT JOIN found USING (question_id))
SELECT *, '{{' || concat_ws(',', '"company":"' || company || '"', '"fiscal_year":"' || fiscal_year || '"') || '}}' AS filters FROM dated""")
def e01_resolve_fuzzy(spark, sf_dir):
    return resolve.resolve(CHATS.df(spark, sf_dir), ENTITIES.df(spark, sf_dir)).select(
        "question_id",
        "company",
        "fiscal_year",
        F.round("score", 6).alias("score"),
        F.to_json(resolve.filters(F.col("company"), F.col("fiscal_year"))).alias("filters")
    )


@query(f"SELECT question_id, coalesce(list_any_value(list_filter([{', '.join(repr(m) for m in gate.SUBJECTIVE)}], lambda m: contains(lower(question), m))) IS NOT NULL, false) AS subjective FROM {CHATS.sql}")
def e03_subjective(spark, sf_dir):
    return CHATS.df(spark, sf_dir).select("question_id", gate.is_subjective(F.col("question")).alias("subjective"))


FOUND = Fixture(
    "case_id long,question string,rank int,company string,relevance_score double,company_name_mismatch boolean",
    (
        (1, "plain", None, None, None, None), (2, "plain", 0, None, 0.1, None), (3, "¿Cuál es la mejor acción?", 0, None, 0.8, False), (4, "plain", 0, None, 0.8, None), (5, "plain", 0, None, 0.8, False),
        (6, "plain", 0, "antares", 0.5281, False), (6, "plain", 1, "ascendis", 0.5264, None), (6, "plain", 2, "argenx", 0.5169, None), (7, "plain", 0, "antares", 0.53, False), (7, "plain", 1, "antares", 0.50, None), (8, "plain", 0, "x", 0.4, False), (9, "should i buy", None, None, None, None),
    ),
    derived.FOUND
)
SOURCE = "company string, ticker string, fiscal_year int, canonical_section string, relevance_score double, content string, text_snippet string, company_name_mismatch boolean"


def _cases(spark, sf_dir):
    s = F.struct(
        F.col("rank"),
        F.col("company"),
        F.lit("TICK").alias("ticker"),
        F.lit(2020).alias("fiscal_year"),
        F.lit(None).cast("string").alias("canonical_section"),
        F.col("relevance_score"),
        F.lit("").alias("content"),
        F.concat(F.lit("about "), F.coalesce("company", F.lit("nobody"))).alias("text_snippet"),
        F.col("company_name_mismatch")
    )
    return FOUND.df(spark, sf_dir).groupBy("case_id", "question").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), s))).alias("sources")
    )


_SUBJ = " OR ".join(f"contains(lower(question), '{m}')" for m in gate.SUBJECTIVE)
_FLAG_SQL = f"""WITH s AS (SELECT * FROM {FOUND.sql}), t AS (SELECT case_id, any_value(question) AS question, count(rank) AS n, max(relevance_score) AS top, arg_max(coalesce(company, '?'), relevance_score * 1000 - rank / 1000) AS company FROM s GROUP BY 1),
u AS (SELECT t.*, (SELECT count(*) FROM s WHERE s.case_id = t.case_id AND rank IS NOT NULL AND coalesce(s.company, '?') = t.company AND company_name_mismatch IS NULL) AS open FROM t),
f AS (SELECT *, CASE WHEN {_SUBJ} THEN 'subjective_no_verdict' WHEN n = 0 THEN 'entity_not_found' WHEN top < 0.4 THEN 'low_confidence' WHEN open > 0 THEN 'unverified_source' ELSE 'ok' END AS flag FROM u)"""


@query(_FLAG_SQL + " SELECT case_id, flag FROM f")
def e04_confidence_flag(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", gate.confidence_flag(F.col("question"), F.col("sources")).alias("flag"))


REPLIES = Fixture(
    "id long,answer string",
    (
        (1, "NOT_IN_CONTEXT"),
        (2, "  NOT_IN_CONTEXT: only FY2019 is there. "),
        (3, "Revenue was 5."),
        (4, "The context does NOT CONTAIN it"),
        (5, "x" * 401 + " cannot be determined"),
        (6, "No encontré nada"),
        (7, None)
    ),
    derived.REPLIES
)


@query(rf"""SELECT id, coalesce(contains(answer, 'NOT_IN_CONTEXT') OR list_any_value(list_filter([{', '.join(repr(m) for m in gate.REFUSALS)}], lambda m: contains(lower(left(trim(answer), 400)), m))) IS NOT NULL, false) AS refusal,
CASE WHEN contains(answer, 'NOT_IN_CONTEXT') THEN trim('{gate.NOT_IN_FILINGS}' || ltrim(regexp_replace(answer, 'NOT_IN_CONTEXT', ''), ' :.-' || chr(10))) ELSE answer END AS clean FROM {REPLIES.sql}""")
def e05_refusal(spark, sf_dir):
    return REPLIES.df(spark, sf_dir).select(
        "id", gate.is_refusal(F.col("answer")).alias("refusal"), gate.without_sentinel(F.col("answer")).alias("clean")
    )


@query(f"""SELECT case_id, 'CONTEXT' || chr(10) || coalesce(string_agg('[' || (rank + 1) || '] ' || coalesce(company, '?') || ' (TICK) FY2020 - ?' || chr(10) || 'about ' || coalesce(company, 'nobody'), chr(10) || chr(10) ORDER BY rank) FILTER (rank IS NOT NULL), '') || chr(10) || chr(10) || 'QUESTION' || chr(10) || any_value(question) AS prompt FROM {FOUND.sql} GROUP BY case_id""")
def e07_prompt(spark, sf_dir):
    return _cases(spark, sf_dir).select("case_id", gate.prompt(F.col("question"), F.col("sources"), F.lit("ok")).alias("prompt"))


@query(_FLAG_SQL + f" SELECT case_id, flag, CASE flag WHEN 'entity_not_found' THEN '{gate.NOT_FOUND_ANSWER}' WHEN 'subjective_no_verdict' THEN '{gate.NO_VERDICT_ANSWER}' WHEN 'low_confidence' THEN '{gate.WEAK_ANSWER}' || chr(10) || chr(10) || '{gate.LOW_NOTICE}' WHEN 'unverified_source' THEN '{gate.NO_PROVIDER_ANSWER}' || chr(10) || chr(10) || '{gate.UNVERIFIED_NOTICE}' ELSE '{gate.NO_PROVIDER_ANSWER}' END AS answer FROM f")
def e09_answers(spark, sf_dir):
    rows = _cases(spark, sf_dir).withColumn("flag", gate.confidence_flag(F.col("question"), F.col("sources")))
    return rows.select(
        "case_id", gate.answered(F.col("flag"), F.lit(None).cast("string")).alias("a")
    ).select("case_id", "a.flag", "a.answer")


IDS = Fixture(
    "id long,raw string",
    (
        (1, "6F9619FF-8B86-D011-B42D-00C04FC964FF"),
        (2, "{6f9619ff-8b86-d011-b42d-00c04fc964ff}"),
        (3, "urn:uuid:6f9619ff-8b86-d011-b42d-00c04fc964ff"),
        (4, "6f9619ff8b86d011b42d00c04fc964ff"),
        (5, "not-a-uuid"),
        (6, ""),
        (7, None)
    ),
    derived.IDS
)


@query(f"SELECT id, {uuid_sql('raw')} AS uuid FROM {IDS.sql}")
def c01_uuid(spark, sf_dir):
    return IDS.df(spark, sf_dir).select("id", T.canonical_uuid(F.col("raw")).alias("uuid"))


KNOWN_CHATS = Fixture(
    "id string,user_id long,title string,created_at long,updated_at long",
    (("6f9619ff-8b86-d011-b42d-00c04fc964ff", None, "old", 1, 1), ("00000000-0000-0000-0000-000000000001", 5, "kept", 2, 2)),
    derived.KNOWN_CHATS
)
ASKED = Fixture(
    "id string,user_id long,title string,at long",
    (
        ("6F9619FF-8B86-D011-B42D-00C04FC964FF", 7, "new", 10),
        ("00000000-0000-0000-0000-000000000001", 8, "new", 11),
        ("00000000-0000-0000-0000-000000000002", None, "fresh", 12),
        ("bad", 1, "x", 13)
    ),
    derived.ASKED
)


@query(f"""WITH a AS (SELECT {uuid_sql('id')} AS id, user_id, title, "at" AS t FROM {ASKED.sql}), n AS (SELECT id, arg_min(user_id, t) AS user_id, arg_min(title, t) AS title, min(t) AS first_at, max(t) AS last_at FROM a WHERE id IS NOT NULL GROUP BY id)
SELECT coalesce(k.id, n.id) AS id, coalesce(k.user_id, n.user_id) AS user_id, coalesce(k.title, n.title) AS title, coalesce(k.created_at, n.first_at) AS created_at, coalesce(n.last_at, k.updated_at) AS updated_at FROM {KNOWN_CHATS.sql} k FULL JOIN n ON k.id = n.id""")
def c02_ensure_conversation(spark, sf_dir):
    return chatlog.ensured(KNOWN_CHATS.df(spark, sf_dir), ASKED.df(spark, sf_dir))


FEEDBACK = Fixture(
    "id long,message_id long,conversation_id string,rating string",
    (
        (1, 1, "6f9619ff-8b86-d011-b42d-00c04fc964ff", "up"),
        (2, 1, "x", "up"),
        (3, 2, "6f9619ff-8b86-d011-b42d-00c04fc964ff", "meh"),
        (4, None, "6f9619ff-8b86-d011-b42d-00c04fc964ff", "down")
    ),
    derived.FEEDBACK
)


@query(f"SELECT * FROM {FEEDBACK.sql} WHERE rating IN ('up', 'down') AND message_id IS NOT NULL AND conversation_id = '6f9619ff-8b86-d011-b42d-00c04fc964ff'")
def c05_feedback(spark, sf_dir):
    return chatlog.feedback_of(chatlog.valid_feedback(FEEDBACK.df(spark, sf_dir)), "6f9619ff-8b86-d011-b42d-00c04fc964ff")


WANTED = Fixture("chunk_id string", (("0",), ("17",), ("abc",), (None,), ("99999999",)))


@query(f"SELECT chunk_id, left(text, 300) AS snippet FROM {WANTED.sql} LEFT JOIN documents ON doc_id = TRY_CAST(chunk_id AS BIGINT)")
def c08_source_detail(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chatlog.source_detail(chunks, WANTED.df(spark, sf_dir), "doc_id").select("chunk_id", T.snippet(F.col("text")).alias("snippet"))


TITLES = Fixture(
    "id long,title string,source_file string,company string,page_start int,page_end int",
    (
        (1, "A", "f.pdf", "c", 1, 3),
        (2, "", "f.pdf", "c", 2, 2),
        (3, "unknown", "", "c", None, 4),
        (4, None, "", "Unknown", None, None),
        (5, " ", None, "c", 7, None)
    ),
    derived.TITLES
)


@query(f"SELECT id, coalesce(CASE WHEN lower(title) <> 'unknown' THEN nullif(title, '') END, nullif(source_file, ''), CASE WHEN lower(company) <> 'unknown' THEN nullif(company, '') END, 'Unknown source') AS title, CASE WHEN page_start IS NULL THEN CAST(page_end AS VARCHAR) WHEN page_end IS NULL OR page_start = page_end THEN CAST(page_start AS VARCHAR) ELSE page_start || '–' || page_end END AS pages, nullif(trim(title), '') AS named FROM {TITLES.sql}")
def p18_titles(spark, sf_dir):
    c = F.col
    return TITLES.df(spark, sf_dir).select(
        "id",
        T.title(c("title"), c("source_file"), c("company")).alias("title"),
        T.page_range(c("page_start"), c("page_end")).alias("pages"),
        T.as_string(c("title")).alias("named")
    )


@query("SELECT doc_id, string_split(array_to_string([lang, source, CAST(n_chars AS VARCHAR)], chr(10) || '---CHUNK---' || chr(10)), chr(10) || '---CHUNK---' || chr(10))[2] AS second FROM documents")
def a26_joined_contexts(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.array("lang", "source", F.col("n_chars").cast("string"))).alias("i", "content")
    )
    return evals.joined_contexts(parts, "doc_id", "i", "content").select(
        "doc_id", F.get(evals.split_contexts(F.col("contexts")), F.lit(1)).alias("second")
    )


_COVER = "UNITED STATES SECURITIES AND EXCHANGE COMMISSION\nFORM 10-K\nANNUAL REPORT PURSUANT TO SECTION 13 OR 15(d)\nfor the fiscal year ended December 31, 2019\nAcme, Inc.\n(Exact Name of Registrant as Specified in its Charter)"
FILING = Fixture(
    "path string,page_number int,text string",
    (
        ("a/acme-inc/NASDAQ_ACME_2020.pdf", 1, "letter to holders\nAcme, Inc."),
        ("a/acme-inc/NASDAQ_ACME_2020.pdf", 2, _COVER),
        ("a/acme-inc/NASDAQ_ACME_2020.pdf", 3, "Acme, Inc.\nItem 1. Business ..... 4\nItem 1A. Risk ..... 5\nItem 7. Results ..... 6"),
        ("a/acme-inc/NASDAQ_ACME_2020.pdf", 4, "Acme, Inc.\nItem 1. Business\n" + "we make things " * 120 + "account-\nants"),
        ("a/acme-inc/NASDAQ_ACME_2020.pdf", 5, "Acme, Inc.\nItem 1A. Risk\n" + "risk is high " * 60 + "\nTotal assets $ 1,234 1,100"),
        ("b/other-corp/NASDAQ_OTH_2018.pdf", 1, None),
        ("b/other-corp/NASDAQ_OTH_2018.pdf", 2, "nothing of note"),
    ),
    derived.FILING
)


_COVER_SQL = "regexp_matches(coalesce(text, ''), '(?is)UNITED.{0,400}FORM.{0,400}REPORT')"
_KEPT_CTE = f"""placed AS (SELECT path, page_number, coalesce(text, '') AS text, row_number() OVER (PARTITION BY path ORDER BY page_number) - 1 AS place, {_COVER_SQL} AS cover FROM {FILING.sql}),
fronts AS (SELECT path, coalesce(min(place) FILTER (cover), 0) AS cutoff, bool_or(cover) AS found FROM placed GROUP BY path),
kept AS (SELECT p.*, cutoff, found, found AND place = cutoff AS is_cover FROM placed p JOIN fronts USING (path) WHERE place >= cutoff)"""
_DEHYPHENATED = r"regexp_replace(body, '([a-z])-\n([a-z])', '\1\2', 'g')"


@query(rf"""WITH {_KEPT_CTE},
lines AS (SELECT path, page_number, is_cover, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM kept),
counts AS (SELECT path, count(*) AS pages FROM kept GROUP BY path),
shares AS (SELECT path, line FROM (SELECT DISTINCT path, page_number, trim(line) AS line FROM lines) JOIN counts USING (path) WHERE line <> '' GROUP BY path, line, pages HAVING count(*) >= 0.6 * pages),
bare AS (SELECT l.* FROM lines l WHERE is_cover OR NOT EXISTS (SELECT 1 FROM shares s WHERE s.path = l.path AND s.line = trim(l.line))),
pages AS (SELECT k.path, k.page_number, k.is_cover, k.cutoff, k.found, coalesce(string_agg(b.line, chr(10) ORDER BY b.n), '') AS body, count(*) FILTER (regexp_matches(trim(b.line), '^.+?\.(?:\s?\.){{3,}}\s*\d+\s*$')) AS leaders FROM kept k LEFT JOIN bare b ON b.path = k.path AND b.page_number = k.page_number GROUP BY k.path, k.page_number, k.is_cover, k.cutoff, k.found),
typed AS (SELECT *, NOT is_cover AND leaders >= 3 AS toc, {glued_sql('body')} AS glued, len({words_sql(_DEHYPHENATED)}) AS words FROM pages)
SELECT path, any_value(found) AS cover_found, any_value(cutoff) AS cutoff, count(*) AS n_pages, count(*) FILTER (toc) AS n_toc_pages, CAST(sum(glued) AS BIGINT) AS glued_words, CAST(coalesce(sum(words) FILTER (NOT toc AND NOT is_cover), 0) AS BIGINT) AS word_count, sum(glued) > 20 AS glued_flag, coalesce(sum(words) FILTER (NOT toc AND NOT is_cover), 0) < 500 AS few_words_flag FROM typed GROUP BY path""")
def f09_clean_documents(spark, sf_dir):
    return cleaning.clean_documents(cleaning.clean_pages(FILING.df(spark, sf_dir), "path"), "path").drop("full_text", "cover_text")


@query(f"SELECT path, coalesce(min(page_number) FILTER (regexp_matches(text, '(?is)UNITED.{{0,400}}FORM.{{0,400}}REPORT')) - 1, 0) AS cutoff, coalesce(bool_or(regexp_matches(text, '(?is)UNITED.{{0,400}}FORM.{{0,400}}REPORT')), false) AS found FROM {FILING.sql} GROUP BY path")
def f01_front_matter(spark, sf_dir):
    return cleaning.front_matter(FILING.df(spark, sf_dir), "path")


@query(f"SELECT path, registrant AS registrant_name, mismatch AS company_name_mismatch FROM ({registrant_sql(f'(WITH {_KEPT_CTE} SELECT path, string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS cover FROM kept WHERE page_number <= 30 AND place < cutoff + 8 GROUP BY path)')})")
def f41_mismatch_scan(spark, sf_dir):
    return cleaning.mismatch_scan(FILING.df(spark, sf_dir))


@query(rf"SELECT path, count(*) AS pages, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM {FILING.sql} GROUP BY path")
def f40_file_profile(spark, sf_dir):
    return cleaning.file_profile(FILING.df(spark, sf_dir)).select("path", "pages", "words")


@query()
def p_ingest_filing(spark, sf_dir):
    from foliant.plans.ingest import chunk_pages

    return chunk_pages(FILING.df(spark, sf_dir)).drop("content")


def _statistics_sql(text: str) -> str:
    """V08 as a list."""
    words = words_sql(f"lower({text})")
    return f"[CAST(len({words}) AS DOUBLE), coalesce(list_sum(list_transform({words}, lambda x: length(x))), 0), coalesce(list_sum(list_transform(string_split(array_to_string({words}, ''), ''), lambda x: ord(x) % 1000)), 0)]"


@query(f"""WITH r AS MATERIALIZED ({SQL["e01_resolve_fuzzy"]}),
q AS MATERIALIZED (SELECT question_id, question, company, fiscal_year, {_statistics_sql('question')} AS qv FROM {QUESTIONS.sql} JOIN r USING (question_id) WHERE trim(coalesce(question, '')) <> ''),
d AS MATERIALIZED (SELECT CASE doc_id % 7 WHEN 0 THEN 'apple-inc' WHEN 1 THEN 'antares-pharma-inc' WHEN 2 THEN 'applied-materials-inc' ELSE source END AS company, {_statistics_sql('text')} AS dv FROM documents WHERE length(text) < 20000),
s AS (SELECT question_id, count(*) AS n, max(CASE WHEN dv[1] > 0 THEN list_cosine_similarity(dv, qv) END) AS top FROM q JOIN d ON q.company IS NULL OR (d.company = q.company AND coalesce(q.fiscal_year, 2022) = 2022) GROUP BY question_id),
f AS (SELECT q.question_id, company, fiscal_year, n, CASE WHEN {_SUBJ} THEN 'subjective_no_verdict' WHEN n IS NULL THEN 'entity_not_found' WHEN top < 0.4 THEN 'low_confidence' ELSE 'ok' END AS flag FROM q LEFT JOIN s ON s.question_id = q.question_id)
SELECT question_id, company, fiscal_year, flag, CASE flag WHEN 'entity_not_found' THEN '{gate.NOT_FOUND_ANSWER}' WHEN 'subjective_no_verdict' THEN '{gate.NO_VERDICT_ANSWER}' WHEN 'low_confidence' THEN '{gate.WEAK_ANSWER}' || chr(10) || chr(10) || '{gate.LOW_NOTICE}' ELSE '{gate.NO_PROVIDER_ANSWER}' END AS answer, CASE WHEN n IS NOT NULL THEN least(n, 5) END AS n_sources FROM f""")
def c07_answers(spark, sf_dir):
    """Questions against all documents, by an encoder that SQL can express; the years are all 2022."""
    from foliant.functions.vectors import token_statistics
    from foliant.plans.answer import answer

    return answer(QUESTIONS.df(spark, sf_dir), ENTITIES.df(spark, sf_dir), _answer_chunks(spark, sf_dir, token_statistics), token_statistics).select(
        "question_id", "company", "fiscal_year", "flag", "answer", F.size("sources").alias("n_sources")
    )


@query()
def c07_hashed_answers(spark, sf_dir):
    """The same with the hashing encoder."""
    from foliant.functions import vectors
    from foliant.plans.answer import answer

    embed = vectors.embed(lambda: vectors.hashing_encoder(64))
    return answer(QUESTIONS.df(spark, sf_dir), ENTITIES.df(spark, sf_dir), _answer_chunks(spark, sf_dir, embed), embed).select(
        "question_id", "company", "fiscal_year", "flag", "answer", F.size("sources").alias("n_sources")
    )


def _answer_chunks(spark, sf_dir, embed):
    """Documents as chunks: three sevenths belong to companies that questions name, the others to their source."""
    names = spark.createDataFrame([("apple-inc", 0), ("antares-pharma-inc", 1), ("applied-materials-inc", 2)], "company string, r int")
    docs = table(spark, sf_dir, "documents").withColumn(
        "r", (F.col("doc_id") % 7).cast("int")
    ).join(F.broadcast(names), "r", "left").withColumn(
        "company", F.coalesce("company", "source")
    )
    none = lambda t: F.lit(None).cast(t)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        "company",
        F.lit("").alias("ticker"),
        F.lit(2022).alias("fiscal_year"),
        none("string").alias("form_type"),
        none("string").alias("accounting_standard"),
        F.col("lang").alias("canonical_section"),
        F.col("source").alias("source_file"),
        none("int").alias("page_start"),
        none("int").alias("page_end"),
        F.lit(False).alias("company_name_mismatch"),
        embed(F.col("text")).alias("embedding")
    )

