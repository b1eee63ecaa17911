"""Registered queries over the shared tables: documents play chunks (source as company, language as section), embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import vectors as V
from foliant.operators import batches, chatlog, chunk, cleaning, profile, search, sketches, vector_index
from foliant.plans.registry import query, table
from foliant.session import fresh_path, spread
from foliant.streaming.incremental import event_sessions, event_windows


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; the year is made up from the id, and the mismatch is the label: absent is unchecked."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", (F.col("toxic") == 1).alias("company_name_mismatch")), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("company"),
        F.upper("source").alias("ticker"),
        F.col("lang").alias("canonical_section"),
        (F.col("doc_id") % 5 + 2018).cast("int").alias("fiscal_year"),
        "n_chars",
        "company_name_mismatch"
    )


CHUNKS = "(SELECT d.doc_id AS id, d.text AS content, d.source AS company, upper(d.source) AS ticker, d.lang AS canonical_section, d.doc_id % 5 + 2018 AS fiscal_year, d.n_chars, l.toxic = 1 AS company_name_mismatch FROM documents d LEFT JOIN labels l USING (doc_id))"
VECTOR = "CAST(embedding AS DOUBLE[])"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)"
BAD = "(contains(content, '(cid:') OR (length(content) > 1000 AND NOT contains(content, ' the ') AND NOT contains(content, ' and ') AND NOT contains(content, ' of ')))"


def _seventh(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()
    return [float(x) for x in row[0]]


def _hits(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_cosine_similarity({VECTOR}, q), 6) AS similarity FROM embeddings, {_Q} WHERE label = 3 ORDER BY list_cosine_similarity({VECTOR}, q) DESC, vec_id LIMIT 5")
def v02_filtered_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(F.col("label") == 3)
    return _hits(search.top_k(rows, _seventh(spark, sf_dir), 5, key="vec_id"))


@query(f"SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_cosine_similarity({VECTOR}, q), 6) AS similarity FROM embeddings, {_Q} ORDER BY list_cosine_similarity({VECTOR}, q) DESC, vec_id LIMIT 10")
def v03_unfiltered_topk(spark, sf_dir):
    return _hits(search.top_k_scan(table(spark, sf_dir, "embeddings"), _seventh(spark, sf_dir), 10, key="vec_id", columns=["label"]))


@query(f"SELECT vec_id, CAST(label AS BIGINT) AS label, round(list_cosine_similarity({VECTOR}, q), 6) AS similarity FROM embeddings, {_Q} ORDER BY list_cosine_similarity({VECTOR}, q) DESC, vec_id LIMIT 10")
def v03_lsh_topk(spark, sf_dir):
    return _hits(search.top_k_approximate(table(spark, sf_dir, "embeddings"), _seventh(spark, sf_dir), 10, key="vec_id"))


@query(f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e JOIN embeddings q USING (label) WHERE q.vec_id % 100 = 0)) WHERE rank <= 5")
def v02_batch_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("query_vector"))
    return search.batch_top_k(rows, asked, 5, key="vec_id", on=["label"]).select(
        "query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank"
    )


@query(f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10")
def v03_index_topk(spark, sf_dir):
    """An index over all embeddings, and what a full scan would find of each hundredth, from the cells that can hold it."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_index.build_index(rows, fresh_path(spark, "vector-index"), "vec_id")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_index.search_exact(index, asked, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"SELECT 'missing' AS asked, count(*) AS n FROM documents UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'one', count(*) FILTER (source = (SELECT min(source) FROM documents)) FROM documents")
def s09_list_filters(spark, sf_dir):
    """Lists as the store's function takes them: a missing one is no filter, an empty one matches nothing."""
    chunks = chunks_of(spark, sf_dir)
    one = [chunks.agg(F.min("company")).first()[0]]
    asked = (("missing", None), ("empty", []), ("one", one))
    counts = [
        search.filtered(chunks, company=given, length_cap=0, empty_matches_nothing=True).agg(F.lit(name).alias("asked"), F.count("*").alias("n"))
        for name, given in asked
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"SELECT count(*) FILTER (label = 3) AS matching_rows, CAST(least(count(*) FILTER (label = 3), 5) AS BIGINT) AS prefilter_rows, (SELECT count(*) FILTER (label = 3) FROM (SELECT label FROM embeddings, {_Q} ORDER BY list_cosine_similarity({VECTOR}, q) DESC, vec_id LIMIT 5)) AS postfilter_rows FROM embeddings")
def v11_filter_diagnosis(spark, sf_dir):
    return search.filter_diagnosis(table(spark, sf_dir, "embeddings"), F.col("label") == 3, _seventh(spark, sf_dir), 5, key="vec_id")


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dimension, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 5) AS squared, CAST(len(embedding) AS BIGINT) AS decoded FROM embeddings")
def v06_vector_codec(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.checked(F.col("embedding"), 64).alias("embedding"))
    decoded = rows.withColumn("back", V.from_text(V.to_text(F.col("embedding"))))
    return decoded.select(
        "vec_id",
        F.size("embedding").alias("dimension"),
        F.round(V.dot(F.col("back"), F.col("embedding")), 5).alias("squared"),
        F.size("back").alias("decoded")
    )


@query(r"WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark) SELECT item_id, CAST(len(w) AS DOUBLE) AS n, CAST(list_sum(list_transform(w, lambda x: length(x))) AS DOUBLE) AS letters, CAST(list_sum(list_transform(string_split(array_to_string(w, ''), ''), lambda c: ord(c) % 1000)) AS DOUBLE) AS codes FROM t")
def v08_token_statistics(spark, sf_dir):
    v = V.token_statistics(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", v.alias("v")).select(
        "item_id", F.get("v", F.lit(0)).alias("n"), F.get("v", F.lit(1)).alias("letters"), F.get("v", F.lit(2)).alias("codes")
    )


@query(r"SELECT item_id, 64 AS dimension, CASE WHEN regexp_matches(text, '\S') THEN 1.0 ELSE 0.0 END :: DOUBLE AS squared FROM benchmark")
def v07_embed(spark, sf_dir):
    encode = V.embed(lambda: V.hashing_encoder(64))
    rows = table(spark, sf_dir, "benchmark").select("item_id", encode(F.col("text")).alias("v"))
    return rows.select("item_id", F.size("v").alias("dimension"), F.round(V.dot(F.col("v"), F.col("v")), 5).alias("squared"))


@query("SELECT e.vec_id, e.vec_id // 10 AS document_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings e, embeddings a WHERE a.vec_id = 14 AND e.vec_id <> 14 AND e.vec_id // 10 = 1 AND e.vec_id % 10 BETWEEN 2 AND 6")
def j06_neighbors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "document_id", F.floor(F.col("vec_id") / 10)
    ).withColumn("chunk_index", F.col("vec_id") % 10)
    return search.neighbours(rows, 14, 2, key="vec_id").select("vec_id", "document_id", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT id, company, fiscal_year FROM {CHUNKS} WHERE ticker IN ('SRC1', 'SRC2') AND company IN ('src1', 'src3') AND fiscal_year = 2019 AND length(content) < 20000")
def p01_filters(spark, sf_dir):
    return search.filtered(chunks_of(spark, sf_dir), ["SRC1", "SRC2"], ["src1", "src3"], 2019).select("id", "company", "fiscal_year")


@query("""WITH u AS (SELECT doc_id, string_split(text, ' ') AS u FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, u, unnest(generate_series(0, CAST(greatest(ceil((len(u) - 350) / 300.0), 0) AS BIGINT))) AS i FROM u)
SELECT doc_id, i AS chunk_index, length(array_to_string(u[i * 300 + 1:i * 300 + 350], ' ')) + CASE WHEN i * 300 + 350 < len(u) THEN 1 ELSE 0 END AS n,
md5(array_to_string(u[i * 300 + 1:i * 300 + 350], ' ') || CASE WHEN i * 300 + 350 < len(u) THEN ' ' ELSE '' END) AS digest,
CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(u[1:i * 300], ' ')) + 1 END AS char_start FROM w""")
def f10_word_chunks(spark, sf_dir):
    rows = chunk.word_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "chunk_index", F.length("content").alias("n"), F.md5("content").alias("digest"), "char_start")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(list_transform(w, lambda x: regexp_replace(x, '[$,%()\-.\s]', '', 'g')), lambda x: length(x) > 0 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 0.6 * length(x))) AS k FROM t),
e AS (SELECT *, 10000 * k // n AS q, 2 * (10000 * k % n) AS r, k / n AS x, (k / n) * 134217729 AS t FROM c),
s AS (SELECT *, ((t - (t - x)) * 20000 - (2 * q + 1)) + (x - (t - (t - x))) * 20000 AS over FROM e)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE (q + CASE WHEN r < n OR (r = n AND (over < 0 OR (over = 0 AND q % 2 = 0))) THEN 0 ELSE 1 END) / 1e4 END AS density, CASE WHEN n = 0 THEN false ELSE k / n >= 0.1 END AS dense FROM s""")
def f17_numeric_density(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.numeric_density(F.col("text")).alias("d"))
    return rows.select("doc_id", T.rounded(F.col("d")).alias("density"), (F.col("d") >= 0.1).alias("dense"))


@query("SELECT doc_id, CAST(CASE WHEN n <= 0 THEN 0 WHEN n <= 100 THEN 1 ELSE 1 + ceil((n - 100) / 50.0) END AS BIGINT) AS windows FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)".replace("\\\\", "\\"))
def f28_window_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.window_count(F.size(T.tokens(F.col("text")))).alias("windows"))


@query(r"SELECT doc_id, greatest(len(list_filter(regexp_split_to_array(replace(text, '.' || chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: trim(p, ' ' || chr(10) || chr(9) || chr(13)) <> '')), 1) AS paragraphs FROM documents")
def f27_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit("\n\n")).alias("t"))
    return rows.select("doc_id", T.paragraph_count(F.col("t")).alias("paragraphs"))


@query(r"""WITH l AS (SELECT DISTINCT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line FROM documents),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source)
SELECT source, line, count(*) AS n, pages, round(count(*) / pages, 6) AS ratio FROM l JOIN n USING (source) WHERE line <> '' GROUP BY source, line, pages HAVING count(*) / pages >= 0.04""")
def a13_boilerplate(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select("source", "text")
    return cleaning.line_shares(pages, "source", "text", 0.04).select("source", "line", "n", "pages", F.round("ratio", 6).alias("ratio"))


@query("SELECT id FROM " + CHUNKS + " WHERE length(content) > 1000 AND NOT contains(content, ' the ') AND NOT contains(content, ' and ') AND NOT contains(content, ' of ')")
def p05_no_english(spark, sf_dir):
    return chunks_of(spark, sf_dir).where(profile.no_english(F.col("content"))).select("id")


@query("SELECT id FROM " + CHUNKS + " WHERE length(content) > 500 AND NOT contains(content, '(cid:') AND length(regexp_replace(content, '[^A-Za-z ]', '', 'g')) < 0.9 * length(content)")
def p07_letter_ratio(spark, sf_dir):
    return chunks_of(spark, sf_dir).where(profile.few_letters(F.col("content"), 0.9)).select("id")


@query("SELECT id FROM " + CHUNKS + " WHERE regexp_matches(content, '(?i)(total assets|net income|license)')")
def p08_regex(spark, sf_dir):
    return chunks_of(spark, sf_dir).where(F.col("content").rlike("(?i)(total assets|net income|license)")).select("id")


@query("SELECT count(*) AS n, count(DISTINCT ticker) AS distinct_ticker, count(DISTINCT company) AS distinct_company FROM " + CHUNKS)
def a02_distinct_counts(spark, sf_dir):
    return profile.distinct_counts(chunks_of(spark, sf_dir), ["ticker", "company"])


@query("SELECT DISTINCT ticker, company FROM " + CHUNKS)
def a03_companies(spark, sf_dir):
    return chunks_of(spark, sf_dir).select("ticker", "company").distinct()


@query("SELECT company, ticker, fiscal_year, count(*) AS n, max(canonical_section) AS max_canonical_section, bool_or(company_name_mismatch IS NULL) AS any_null_company_name_mismatch FROM " + CHUNKS + " GROUP BY ALL")
def a04_inventory(spark, sf_dir):
    return profile.inventory(chunks_of(spark, sf_dir), ["company", "ticker", "fiscal_year"], "canonical_section", "company_name_mismatch")


@query("SELECT fiscal_year, count(DISTINCT company) AS distinct_company FROM " + CHUNKS + " GROUP BY fiscal_year")
def a05_companies_per_year(spark, sf_dir):
    return profile.distinct_per(chunks_of(spark, sf_dir), "fiscal_year", "company")


@query("SELECT canonical_section, count(*) AS n FROM " + CHUNKS + " GROUP BY 1 ORDER BY n DESC, canonical_section LIMIT 12")
def a06_top_sections(spark, sf_dir):
    return profile.top_values(chunks_of(spark, sf_dir), "canonical_section")


@query("SELECT CAST(CASE WHEN length(content) >= 20000 THEN 11 ELSE floor(length(content) / 2000) + 1 END AS BIGINT) AS bucket, count(*) AS n, min(length(content)) AS shortest, max(length(content)) AS longest FROM " + CHUNKS + " GROUP BY 1")
def a07_length_histogram(spark, sf_dir):
    return profile.length_histogram(chunks_of(spark, sf_dir))


def _share_sql(name: str, p: str) -> str:
    return f"SELECT '{name}' AS name, count(*) FILTER ({p}) AS n, CAST(coalesce(sum(length(content)) FILTER ({p}), 0) AS BIGINT) AS n_chars, round(100.0 * count(*) FILTER ({p}) / count(*), 4) AS pct_rows, round(100.0 * coalesce(sum(length(content)) FILTER ({p}), 0) / sum(length(content)), 4) AS pct_chars FROM {CHUNKS}"


@query(_share_sql("bad", BAD) + " UNION ALL " + _share_sql("cid", "contains(content, '(cid:')") + " UNION ALL " + _share_sql("short", "length(content) < 300"))
def a08_bad_share(spark, sf_dir):
    c = F.col("content")
    return profile.shares(chunks_of(spark, sf_dir), {"bad": profile.is_bad(c), "cid": profile.has_cid(c), "short": F.length(c) < 300})


@query(f"SELECT ticker, company, fiscal_year, count(*) AS n_bad, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM {CHUNKS} WHERE {BAD} GROUP BY 1, 2, 3 ORDER BY n_bad DESC, ticker, company, fiscal_year LIMIT 25")
def a10_worst_docs(spark, sf_dir):
    return profile.worst_documents(chunks_of(spark, sf_dir), profile.is_bad(F.col("content")), ["ticker", "company", "fiscal_year"])


@query(f"SELECT company, canonical_section, fiscal_year, count(*) AS n FROM {CHUNKS} GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT {BAD}) = 0")
def a11_all_bad_docs(spark, sf_dir):
    return profile.all_bad_documents(
        chunks_of(spark, sf_dir), profile.is_bad(F.col("content")), ["company", "canonical_section", "fiscal_year"]
    )


@query(f"SELECT upper(substr(coalesce(nullif(canonical_section, ''), '?'), 1, 1)) AS letter, count(*) AS n FROM {CHUNKS} GROUP BY 1")
def a12_first_letters(spark, sf_dir):
    return profile.first_letters(chunks_of(spark, sf_dir), "canonical_section")


@query()
def a02_merged_profile(spark, sf_dir):
    """Sales lines a flag, from sketches a month: distinct sales are an estimate, as is the median amount. No SQL says what a sketch estimates."""
    path, lines = fresh_path(spark, "sketches"), table(spark, sf_dir, "sale_lines").withColumn("month", F.date_trunc("month", "shipped_at"))
    sketches.keep(sketches.sketched(lines, ["month", "flag"], ["sale_id"], ["amount"]), path, "lines")
    whole = sketches.merged(sketches.kept(spark, path), ["flag"], ["sale_id"], ["amount"])
    return sketches.estimates(whole, ["flag"], ["sale_id"], ["amount"])


@query("SELECT 'n_chars' AS name, CAST(sum(n_chars) AS DOUBLE) AS total, round(avg(n_chars), 6) AS mean, median(n_chars) AS median, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS most FROM documents")
def a14_corpus_stats(spark, sf_dir):
    return profile.statistics(table(spark, sf_dir, "documents"), ["n_chars"]).withColumn("mean", F.round("mean", 6))


@query(f"SELECT company, fiscal_year, CAST(sum(len) AS BIGINT) AS chars, sum(len) / 4.0 AS tokens, sum(len) > 60000 AS risky FROM (SELECT company, fiscal_year, length(content) AS len, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY length(content) DESC, id) AS r FROM {CHUNKS} WHERE company IN ('src0', 'src4', 'src9')) WHERE r <= 5 GROUP BY 1, 2")
def a24_token_risk(spark, sf_dir):
    rows = chunks_of(spark, sf_dir)
    wanted = rows.where(F.col("company").isin("src0", "src4", "src9")).select("company", "fiscal_year")
    return profile.token_risk(rows, wanted, ["company", "fiscal_year"])


@query(f"SELECT company, fiscal_year, id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY n_chars DESC NULLS LAST, id) AS r FROM {CHUNKS}) WHERE r = 1")
def w01_distinct_on(spark, sf_dir):
    return profile.densest(
        chunks_of(spark, sf_dir), ["company", "fiscal_year"], "n_chars", "id"
    ).select("company", "fiscal_year", "id", "n_chars")


@query(f"SELECT w.company, w.fiscal_year, coalesce(n_bad, 0) AS n_bad FROM (SELECT DISTINCT company, fiscal_year FROM {CHUNKS}) w LEFT JOIN (SELECT company, fiscal_year, count(*) AS n_bad FROM {CHUNKS} WHERE {BAD} GROUP BY 1, 2) b USING (company, fiscal_year)")
def j11_bad_by_company(spark, sf_dir):
    rows = chunks_of(spark, sf_dir)
    return profile.bad_by_key(
        rows.select("company", "fiscal_year").distinct(), rows, profile.is_bad(F.col("content")), ["company", "fiscal_year"]
    )


@query(f"SELECT company, count(*) AS n FROM {CHUNKS} WHERE NOT coalesce({BAD}, false) GROUP BY company")
def s17_quarantine(spark, sf_dir):
    return profile.quarantined(chunks_of(spark, sf_dir), profile.is_bad(F.col("content"))).groupBy("company").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) FILTER (company_name_mismatch IS NULL) AS null_company_name_mismatch, count(company_name_mismatch) AS set_company_name_mismatch FROM {CHUNKS}")
def p09_null_counts(spark, sf_dir):
    return profile.null_counts(chunks_of(spark, sf_dir), ["company_name_mismatch"])


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j08_resume_anti(spark, sf_dir):
    return batches.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT source AS source_file, count(*) AS n_chunks FROM documents WHERE source < 'src2' GROUP BY 1")
def j09_loaded_semi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.groupBy(F.col("source").alias("source_file")).agg(F.count("*").alias("n_chunks"))
    stored = docs.where((F.col("source") < "src2") | (F.col("doc_id") > 100)).select(F.col("source").alias("source_file"))
    return batches.fully_loaded(files, stored)


@query("SELECT 'a' AS k, lang AS status, count(*) AS n FROM documents GROUP BY lang")
def a17_status_counts(spark, sf_dir):
    return batches.status_counts(table(spark, sf_dir, "documents"), "lang").select(
        F.lit("a").alias("k"), F.col("lang").alias("status"), "n"
    )


@query("SELECT user_id AS id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY user_id")
def s11_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fresh = events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    old = events.where("user_id % 2 = 0").select(
        F.col("user_id").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("last_event")
    ).distinct()
    return batches.upserted(old, fresh, ["id"])


@query("SELECT conv_id AS conversation_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS turns FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' GROUP BY 1")
def c03_history(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content")
    )
    found = chatlog.history(chatlog.valid_messages(rows))
    return found.select(
        "conversation_id",
        F.array_join(
            F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ","
        ).alias("turns")
    )


@query("SELECT conv_id AS conversation_id, turn AS id, md5(text) AS digest FROM conversations WHERE role = 'user'")
def x04_user_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content")
    )
    return chatlog.user_questions(rows).select("conversation_id", "id", F.md5("content").alias("digest"))


@query("SELECT epoch(time_bucket(INTERVAL 1 DAY, ts)) :: BIGINT AS day_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t_event_windows(spark, sf_dir):
    rows = event_windows(table(spark, sf_dir, "events"))
    return rows.select(F.unix_timestamp("window_start").alias("day_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1")
def t_event_sessions(spark, sf_dir):
    return event_sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x_revenue_by_nation(spark, sf_dir):
    """Extension: a relational smoke test of joins and aggregates."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(
        t("orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        t("nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy("n_name").agg(
        F.count("*").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    )


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS since, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(count(*)) OVER (ORDER BY time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS done, round(100.0 * sum(count(*)) OVER (ORDER BY time_bucket(INTERVAL 1 DAY, ts)) / 1000000.0, 4) AS pct FROM events GROUP BY time_bucket(INTERVAL 1 DAY, ts)")
def w08_progress(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return batches.progress(rows, 1_000_000, width="1 day").withColumn("since", F.unix_timestamp("since"))


@query("SELECT coalesce(a.lang, b.lang) AS name, CASE WHEN b.lang IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT source || lang AS lang FROM documents WHERE doc_id % 2 = 0) a FULL JOIN (SELECT DISTINCT source || lang AS lang FROM documents WHERE doc_id % 2 = 1) b ON a.lang = b.lang WHERE a.lang IS NULL OR b.lang IS NULL")
def u06_changed(spark, sf_dir):
    """Two halves of the documents as two lists of definitions."""
    rows = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("name"), (F.col("doc_id") % 2).alias("half"))
    return batches.changed(rows.where("half = 1"), rows.where("half = 0"))
