"""Registered queries for the smaller operators: scalar functions, lookups, sinks' row logic, chat turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import filing, gate
from foliant.functions import text as T
from foliant.functions.udfs import sequence_ratio
from foliant.operators import batches, chatlog, chunk, evals, profile, resolve, search, sections, similar
from foliant.plans.corpus_queries import CHUNKS, chunks_of
from foliant.plans.fixture_queries import ANSWERS, CHATS, ENTITIES, ITEMS, _LOOKUP_SQL, PATHS, REPLIES, SECTIONS_CTE, STRUCTURED
from foliant.plans import derived
from foliant.plans.registry import Fixture, query, table
from foliant.plans.sql_parts import LABELS_SQL, SIGNIFICANT, label_key_sql, normal_name_sql, ratios_sql, registrant_sql, uuid_sql
from foliant.sources import readers

c = F.col


@query(f"SELECT (SELECT count(*) FROM {CHUNKS}) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS documents")
def a01_counts(spark, sf_dir):
    return chunks_of(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("company").alias("documents"))


@query("SELECT event_type AS category, upper(substr(event_type, 1, 1)) AS letter, count(*) AS n FROM events GROUP BY 1, 2")
def a25_category_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(
        c("event_type").alias("category"), F.upper(F.substring("event_type", 1, 1)).alias("letter")
    ).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id = 42")
def s07_point_lookup(spark, sf_dir):
    return readers.by_id(table(spark, sf_dir, "documents"), 42, "doc_id").select("doc_id", "lang")


@query("SELECT DISTINCT upper(source) AS ticker, source AS company FROM documents ORDER BY company LIMIT 10")
def s08_company_list(spark, sf_dir):
    return readers.companies(chunks_of(spark, sf_dir), 10)


REMOTE = Fixture("key string,size long", (("a.pdf", 10), ("b.pdf", 20), ("c.pdf", 30)), derived.REMOTE)
LOCAL = Fixture("key string,size long", (("a.pdf", 10), ("b.pdf", 19)), derived.LOCAL)


@query(f"SELECT * FROM {REMOTE.sql} EXCEPT SELECT * FROM {LOCAL.sql}")
def s04_to_download(spark, sf_dir):
    return readers.to_download(REMOTE.df(spark, sf_dir), LOCAL.df(spark, sf_dir))


FILES = Fixture(
    "source_file string,chunk_index string,text string,page_start double,page_end double,ticker string,company string,fiscal_year double,mismatch boolean",
    (
        ("f1", "0", "a", 1.0, 2.0, "T", "c", 2020.0, None),
        ("f1", "10", "c", float("nan"), None, None, None, None, False),
        ("f1", "9", "b", 3.0, 3.0, "T", "c", float("nan"), True),
        ("f2", "x", None, None, None, "", "d", 2021.0, None)
    ),
    derived.FILES
)


def _int_sql(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS BIGINT) END"


@query(f"SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY TRY_CAST(chunk_index AS INTEGER) NULLS LAST, page_start, text) - 1 AS chunk_index, coalesce(text, '') AS content, {_int_sql('page_start')} AS page_start, {_int_sql('page_end')} AS page_end, coalesce(ticker, '') AS ticker, coalesce(company, '') AS company, coalesce({_int_sql('fiscal_year')}, 0) AS fiscal_year, mismatch AS company_name_mismatch FROM {FILES.sql}")
def s05_chunk_files(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    meta = F.struct(
        "company",
        "ticker",
        "fiscal_year",
        none("string").alias("form_type"),
        none("string").alias("accounting_standard"),
        none("string").alias("canonical_section"),
        c("mismatch").alias("company_name_mismatch"),
        none("double").alias("numeric_density")
    )
    rows = FILES.df(spark, sf_dir).select(
        "text",
        "source_file",
        "page_start",
        "page_end",
        none("array<float>").alias("embedding"),
        "chunk_index",
        meta.alias("metadata")
    )
    return readers.as_chunks(rows).select(
        "source_file",
        "chunk_index",
        "content",
        "page_start",
        "page_end",
        "ticker",
        "company",
        "fiscal_year",
        "company_name_mismatch"
    )


@query(f"SELECT id FROM {ANSWERS.sql} WHERE trim(coalesce(confidence_flag, '')) <> ''")
def p11_diverted(spark, sf_dir):
    return batches.diverted(ANSWERS.df(spark, sf_dir), "confidence_flag")[1].select("id")


@query(f"SELECT id, coalesce(answer, '') <> '' AND coalesce(confidence_flag, '') NOT IN ('pipeline_error', 'generation_error') AS usable FROM {ANSWERS.sql}")
def p12_usable(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("id", batches.is_usable(c("answer"), c("confidence_flag")).alias("usable"))


@query("SELECT doc_id AS id, left(text, 300) AS snippet, length(text) / 4.0 AS tokens FROM documents")
def p17_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        c("doc_id").alias("id"), T.snippet(c("text")).alias("snippet"), T.token_estimate(F.length("text")).alias("tokens")
    )


@query("SELECT CAST(e.vec_id AS BIGINT) AS chunk_id, 'co3' AS company, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score, 'text ' || e.vec_id AS text_snippet, '{''company'': [''co3''], ''fiscal_year'': 2020}' AS filters FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.label = 3 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 3")
def v12_retrieve(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    rows = table(spark, sf_dir, "embeddings")
    chunks = rows.select(
        c("vec_id").alias("id"),
        "embedding",
        F.concat(F.lit("text "), c("vec_id").cast("string")).alias("content"),
        F.concat(F.lit("co"), c("label").cast("string")).alias("company"),
        F.lit("").alias("ticker"),
        F.lit(2020).alias("fiscal_year"),
        *(none("string").alias(n) for n in ("form_type", "accounting_standard", "canonical_section", "source_file")),
        none("int").alias("page_start"),
        none("int").alias("page_end"),
        F.lit(False).alias("company_name_mismatch")
    )
    q = [float(x) for x in rows.where("vec_id = 7").first()["embedding"]]
    hits, meta = search.retrieve(chunks, q, "m", 3, company=["co3"], fiscal_year=2020)
    return hits.select(
        "chunk_id",
        "company",
        F.round("relevance_score", 6).alias("score"),
        "text_snippet",
        F.lit(str(meta["filters_applied"])).alias("filters")
    )


@query(f"SELECT form_type, item, text, coalesce(string_agg(section, ',' ORDER BY place), '') AS sections FROM {ITEMS.sql} LEFT JOIN {_LOOKUP_SQL} ON form_type = f AND upper(trim(item)) = i GROUP BY 1, 2, 3")
def j04_section_candidates(spark, sf_dir):
    return sections.candidates(ITEMS.df(spark, sf_dir)).select("form_type", "item", "text", F.array_join("sections", ",").alias("sections"))


@query(f"WITH {SECTIONS_CTE} SELECT doc, label, start, \"end\" FROM sections")
def w03_section_spans(spark, sf_dir):
    return chunk.sections(STRUCTURED.df(spark, sf_dir), "doc").select("doc", "label", "start", "end")


LABELS = Fixture(
    "id long,raw string,name string",
    (
        (1, "Total Stockholders’ Equity", "Acme Holdings, Inc."),
        (2, "Net income (loss)", "group-holdings-inc"),
        (3, "Net income (loss) before taxes", "the_big/co.ltd"),
        (4, "NET  SALES", "inc"),
        (5, None, None)
    ),
    derived.LABELS
)


@query(rf"WITH n AS (SELECT *, {normal_name_sql('name')} AS normal FROM {LABELS.sql}) SELECT n.id, l.label, n.normal, array_to_string(list_filter(regexp_split_to_array(regexp_replace(trim(n.normal), '(\S)(?:\s+(?:{'|'.join(T.CORPORATE)}))+$', '\1'), '\s+'), lambda x: x <> ''), ' ') AS core FROM n LEFT JOIN {LABELS_SQL} l ON l.name = {label_key_sql('n.raw')}")
def f31_labels_and_names(spark, sf_dir):
    normal = T.normal_name(c("name"))
    return LABELS.df(spark, sf_dir).select(
        "id", T.label_name(c("raw")).alias("label"), normal.alias("normal"), F.array_join(T.core_tokens(normal), " ").alias("core")
    )


@query(rf"SELECT question_id, TRY_CAST(regexp_extract(question, '\b((?:19|20)\d{{2}})\b', 1) AS BIGINT) AS year FROM {CHATS.sql}")
def f36_first_year(spark, sf_dir):
    return CHATS.df(spark, sf_dir).select("question_id", T.first_year(c("question")).alias("year"))


SPELT = Fixture(ENTITIES.schema, ENTITIES.rows, derived.NATIONS)


@query(f"WITH RECURSIVE names AS (SELECT DISTINCT company FROM {SPELT.sql}), pairs AS (SELECT x.company AS pa, y.company AS pb FROM names x JOIN names y ON left(x.company, 1) = left(y.company, 1)), {ratios_sql('pairs')} SELECT pa AS a, pb AS b, round(ratio, 6) AS ratio FROM ratios")
def f35_sequence_ratio(spark, sf_dir):
    names = SPELT.df(spark, sf_dir).select("company")
    pairs = names.select(c("company").alias("a")).join(
        names.select(c("company").alias("b")), F.substring("a", 1, 1) == F.substring("b", 1, 1)
    )
    return pairs.select("a", "b", F.round(sequence_ratio("a", "b"), 6).alias("ratio"))


@query(f"""WITH RECURSIVE words AS MATERIALIZED (SELECT DISTINCT unnest(string_split(lower(name), ' ')) AS w FROM clients),
pairs AS MATERIALIZED (SELECT x.w AS pa, y.w AS pb FROM words x JOIN words y ON x.w < y.w AND length(x.w) * 3 >= length(y.w) * 2 AND length(y.w) * 3 >= length(x.w) * 2
WHERE x.w <> '' AND list_sum(list_transform(list_distinct(string_split(x.w, '')), lambda l: least(length(x.w) - length(replace(x.w, l, '')), length(y.w) - length(replace(y.w, l, ''))))) * 2 >= 0.8 * (length(x.w) + length(y.w))), {ratios_sql('pairs')}
SELECT pa AS a, pb AS b, round(ratio, 6) AS ratio FROM ratios WHERE ratio >= 0.8""")
def j01_similar_names(spark, sf_dir):
    """All two different words of the clients' names that are spelt alike."""
    words = table(spark, sf_dir, "clients").select(F.explode(F.split(F.lower("name"), " ")).alias("w")).where("w <> ''")
    found = similar.similar_words(words.select(c("w").alias("p")), words.select(c("w").alias("q")), resolve.THRESHOLD, distinct_from=True)
    return found.select(c("p").alias("a"), c("q").alias("b"), F.round("ratio", 6).alias("ratio"))


@query(rf"SELECT path, replace(path, '\', '/') AS slashed FROM {PATHS.sql}")
def f38_slashes(spark, sf_dir):
    return PATHS.df(spark, sf_dir).select("path", T.slashes(c("path")).alias("slashed"))


@query(f"SELECT path, registrant AS name, array_to_string(list_sort({SIGNIFICANT.format('registrant')}), ' ') AS tokens, regexp_replace(lower(registrant), '[^a-z0-9]', '', 'g') AS collapsed FROM ({registrant_sql(PATHS.sql)})")
def f22_registrant(spark, sf_dir):
    named = PATHS.df(spark, sf_dir).select("path", filing.registrant_name(c("cover")).alias("name"))
    return named.select(
        "path",
        "name",
        F.array_join(F.array_sort(filing.significant_tokens(c("name"))), " ").alias("tokens"),
        filing.collapsed(c("name")).alias("collapsed")
    )


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso, substr(sha256(event_type || '#' || user_id), 1, 8) AS stable FROM events")
def m02_iso_and_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id", T.iso_time(c("ts").cast("timestamp")).alias("iso"), T.stable_id(c("event_type"), c("user_id")).alias("stable")
    )


NUMBERS = Fixture("id long,x double", ((1, 2020.0), (2, float("nan")), (3, None), (4, float("inf")), (5, 1.23456)), derived.NUMBERS)


@query(f"SELECT id, CASE WHEN isfinite(x) THEN x END AS finite, round(CASE WHEN isfinite(x) THEN x END, 4) AS rounded FROM {NUMBERS.sql}")
def m04_numbers(spark, sf_dir):
    finite = T.as_number(c("x"))
    return NUMBERS.df(spark, sf_dir).select("id", finite.alias("finite"), T.rounded(finite).alias("rounded"))


@query(f"SELECT id, CASE WHEN contains(answer, '{gate.LOW_NOTICE}') THEN answer ELSE answer || chr(10) || chr(10) || '{gate.LOW_NOTICE}' END AS noted FROM {REPLIES.sql}")
def e08_notices(spark, sf_dir):
    return REPLIES.df(spark, sf_dir).select("id", gate.with_notice(gate.with_notice(c("answer"), gate.LOW_NOTICE), gate.LOW_NOTICE).alias("noted"))


FILTERS = Fixture("company string,fiscal_year int", (("a", 2020), ("b", None), (None, None), (None, 0)), derived.FILTERS)


@query(f"""SELECT company, fiscal_year, '{{' || concat_ws(',', '"company":"' || company || '"', '"fiscal_year":"' || fiscal_year || '"') || '}}' AS filters FROM {FILTERS.sql}""")
def e02_filters(spark, sf_dir):
    return FILTERS.df(spark, sf_dir).select("company", "fiscal_year", F.to_json(resolve.filters(c("company"), c("fiscal_year"))).alias("filters"))


@query(f"SELECT question_id, question, 'system_unavailable' AS flag, 0::BIGINT AS n_sources FROM {CHATS.sql}")
def e10_degraded(spark, sf_dir):
    from foliant.plans.answer import degraded

    return degraded(CHATS.df(spark, sf_dir)).select("question_id", "question", "flag", F.size("sources").alias("n_sources"))


@query("WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '') SELECT conv_id AS conversation_id, md5('HISTORY' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'CONTEXT' || chr(10) || 'none' || chr(10) || chr(10) || 'QUESTION' || chr(10) || 'why?') AS prompt FROM t WHERE r <= 6 GROUP BY 1")
def e11_chat_prompt(spark, sf_dir):
    from foliant.plans.answer import chat_prompt

    rows = table(spark, sf_dir, "conversations").select(
        c("turn").alias("id"), c("conv_id").alias("conversation_id"), "role", c("text").alias("content")
    )
    found = chatlog.history(chatlog.valid_messages(rows))
    return found.select("conversation_id", F.md5(chat_prompt(c("history"), F.lit("why?"), F.lit("none"))).alias("prompt"))


STORED = Fixture(
    "id long,conversation_id string,role string,content string,confidence_flag string,created_at long",
    ((4, "6f9619ff-8b86-d011-b42d-00c04fc964ff", "user", "old", None, 1),)
)
TURNS = Fixture(
    "conversation_id string,at long,question string,answer string,confidence_flag string",
    (
        ("6F9619FF8B86D011B42D00C04FC964FF", 9, "q2", "a2", "ok"),
        ("6f9619ff-8b86-d011-b42d-00c04fc964ff", 5, "q1", "a1", "low_confidence"),
        ("nope", 6, "x", "y", "ok")
    ),
    derived.TURNS
)


@query(f"""WITH t AS (SELECT *, {uuid_sql('conversation_id')} AS conv FROM {TURNS.sql}), two AS (SELECT conv, "at" AS t, 0 AS k, 'user' AS role, question AS content, NULL AS flag FROM t WHERE conv IS NOT NULL UNION ALL SELECT conv, "at", 1, 'assistant', answer, confidence_flag FROM t WHERE conv IS NOT NULL)
SELECT id, role, content, confidence_flag, created_at FROM {STORED.sql} UNION ALL SELECT (SELECT max(id) FROM {STORED.sql}) + row_number() OVER (ORDER BY t, conv, k), role, content, flag, t FROM two""")
def c04_save_turn(spark, sf_dir):
    return chatlog.turn(STORED.df(spark, sf_dir), TURNS.df(spark, sf_dir)).select("id", "role", "content", "confidence_flag", "created_at")


@query("SELECT coalesce(lang, '') AS run_tag, count(*) AS n FROM documents GROUP BY 1")
def p19_run_tags(spark, sf_dir):
    return evals.tagged(
        table(spark, sf_dir, "documents").select("doc_id", "lang"), c("lang")
    ).groupBy("run_tag").agg(F.count("*").alias("n"))


SOURCES = Fixture(
    "id long,title string,company string,section string,start int,stop int",
    ((1, "a/b/c.pdf", "Acme", "risk", 1, 3), (2, "x.pdf", "", None, 2, 2), (3, "", None, "mdna", None, None)),
    derived.SOURCES
)


@query(f"SELECT id, regexp_replace(list_reverse(string_split(title, '/'))[1], '\\.pdf$', '') AS file, concat_ws(' · ', nullif(company, ''), nullif(section, ''), CASE WHEN start IS NULL THEN CAST(stop AS VARCHAR) WHEN stop IS NULL OR start = stop THEN CAST(start AS VARCHAR) ELSE start || '–' || stop END) AS preview FROM {SOURCES.sql}")
def x03_source_previews(spark, sf_dir):
    return SOURCES.df(spark, sf_dir).select(
        "id",
        T.base_name(c("title")).alias("file"),
        T.dotted(c("company"), c("section"), T.page_range(c("start"), c("stop"))).alias("preview")
    )


@query("SELECT source AS company, lang, count(*) AS n FROM documents WHERE NOT contains(text, '(cid:') GROUP BY 1, 2")
def p04_without_cid(spark, sf_dir):
    rows = chunks_of(spark, sf_dir).where(~profile.has_cid(c("content")))
    return rows.groupBy("company", c("canonical_section").alias("lang")).agg(F.count("*").alias("n"))


SHOWN = Fixture(
    "place long,chunk_id string,title string,source_file string,company string,fiscal_year double,content string,text_snippet string",
    (
        (0, "7", "T", "f.pdf", "c", 2020.0, "body", "snip"),
        (1, " ", "", "f.pdf", "c", float("nan"), "body", " "),
        (2, None, None, " ", "", float("inf"), None, None),
        (3, "k", None, None, None, None, "", "s")
    ),
    derived.SHOWN
)


@query(f"""WITH s AS (SELECT place, nullif(trim(chunk_id), '') AS own, nullif(trim(title), '') AS title, nullif(trim(source_file), '') AS file, nullif(trim(company), '') AS company, fiscal_year, nullif(trim(content), '') AS content, nullif(trim(text_snippet), '') AS snip FROM {SHOWN.sql})
SELECT place, coalesce(own, 'source-' || place) AS chunk_id, coalesce(title, file, company, own, 'source-' || place) AS title, company, CASE WHEN isfinite(fiscal_year) THEN fiscal_year END AS fiscal_year, coalesce(snip, content) AS text_snippet FROM s""")
def x02_source_records(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = SHOWN.df(spark, sf_dir)
    source = F.struct(
        "chunk_id",
        "title",
        "source_file",
        "company",
        "fiscal_year",
        "content",
        "text_snippet",
        *(none.alias(n) for n in ("ticker", "form_type", "page_start", "page_end", "relevance_score"))
    )
    shown = rows.select("place", T.source_record(source, c("place")).alias("r"))
    return shown.select("place", "r.chunk_id", "r.title", "r.company", "r.fiscal_year", "r.text_snippet")


@query("SELECT vec_id AS query_id, unnest(CASE WHEN embedding[1] * 100 >= 7 THEN ['apple-annual-report-2025', 'apple-investor-relations-summary'] ELSE ['general-financial-market-overview'] END) AS id FROM embeddings")
def v09_mock_retriever(spark, sf_dir):
    asked = table(spark, sf_dir, "embeddings").select(
        c("vec_id").alias("query_id"), F.transform("embedding", lambda x: x * 100).alias("query_vector")
    )
    return search.mock_retrieve(asked).select("query_id", "id")
