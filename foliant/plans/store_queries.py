"""Registered queries that write, load, delete and stream in the session's shared folder, and read back what is there."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import batches, chat_events, evals
from foliant.plans.ingest import document_report
from foliant.plans.registry import query, table
from foliant.session import fresh_path
from foliant.sources import pdf, readers, schemas, sinks
from foliant.sources.buckets import BucketTable
from foliant.streaming import incremental

c = F.col
_SQL_CHUNKS = "(SELECT 'f' || label AS source_file, CAST(vec_id AS BIGINT) AS chunk_index, vec_id, label FROM embeddings)"


def _vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks to load: a file a label."""
    none = F.lit(None)
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.concat(F.lit("f"), c("label").cast("string")).alias("source_file"),
        c("vec_id").cast("int").alias("chunk_index"),
        F.concat(F.lit("text "), c("vec_id").cast("string")).alias("content"),
        F.lit(6).alias("n_chars"),
        "embedding",
        F.lit("T").alias("ticker"),
        F.concat(F.lit("co"), c("label").cast("string")).alias("company"),
        (c("label") % 3 + 2019).cast("int").alias("fiscal_year"),
        *(none.cast("string").alias(n) for n in ("form_type", "accounting_standard", "canonical_section")),
        *(none.cast("int").alias(n) for n in ("page_start", "page_end")),
        none.cast("float").alias("numeric_density"),
        none.cast("boolean").alias("company_name_mismatch"),
    )


def _store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A fresh store with the chunks loaded."""
    folder = fresh_path(spark, name)
    schemas.bootstrap(spark, folder)
    sinks.load_chunks(spark, folder, _vector_chunks(spark, sf_dir), 64)
    return folder


@query("SELECT 'b' || item_id || '.pdf' AS file, true AS has_size FROM benchmark WHERE length(text) > 300")
def s01_pdf_files(spark, sf_dir):
    folder = fresh_path(spark, "pdfs")
    for r in _long_items(spark, sf_dir):
        sinks.write_file(spark, f"{folder}/sub{len(r.item_id) % 2}/b{r.item_id}.pdf", b"%PDF-")
        sinks.write_file(spark, f"{folder}/b{r.item_id}.PDF", b"%PDF-")
    return readers.pdf_files(spark, folder).select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("file"), (c("length") == 5).alias("has_size")
    )


def _long_items(spark: SparkSession, sf_dir: str) -> list:
    """Benchmark items of over 300 letters: a few, as the benchmark doesn't grow with the corpus."""
    return table(spark, sf_dir, "benchmark").where("length(text) > 300").select(
        c("item_id").cast("string").alias("item_id"), "text"
    ).collect()


@query("SELECT CASE WHEN strlen(text) % 2 = 0 THEN 'even/' ELSE '' END || item_id || '.txt' AS key, strlen(text) AS size, strlen(text) % 3 <> 0 AS copied FROM benchmark WHERE length(text) > 300")
def s04_download(spark, sf_dir):
    """A folder of files, of which another has some already and some cut short; then both are alike, and a second run copies nothing."""
    base = fresh_path(spark, "mirror")
    for r in _long_items(spark, sf_dir):
        raw = r.text.encode()
        key = f"{'even/' if len(raw) % 2 == 0 else ''}{r.item_id}.txt"
        sinks.write_file(spark, f"{base}/remote/{key}", raw)
        if len(raw) % 3 != 1:
            sinks.write_file(spark, f"{base}/local/{key}", raw if len(raw) % 3 == 0 else raw[:9])
    done = sinks.downloaded(spark, f"{base}/remote", f"{base}/local").where("error IS NULL")
    if not sinks.downloaded(spark, f"{base}/remote", f"{base}/local").isEmpty():
        raise RuntimeError("a second run copied files again")
    return readers.listing(spark, f"{base}/local").join(
        done.select("key", F.lit(True).alias("copied")), "key", "left"
    ).withColumn("copied", F.coalesce("copied", F.lit(False)))


@query("SELECT 'b' || item_id || '.pdf' AS file, p AS page_number, regexp_replace(substr(text, (p - 1) * 100 + 1, 100), '[^ -~]', '', 'g') AS text FROM (SELECT *, unnest([1, 2, 3]) AS p FROM benchmark WHERE length(text) > 300) WHERE p >= 2")
def s02_pdf_pages(spark, sf_dir):
    """Three pages of each item, one PDF an item, from the second on."""
    folder = fresh_path(spark, "pdfs")
    for r in _long_items(spark, sf_dir):
        pages = ["".join(x for x in r.text[i * 100 : i * 100 + 100] if " " <= x <= "~") for i in range(3)]
        sinks.write_file(spark, f"{folder}/b{r.item_id}.pdf", pdf.simple_pdf(pages, packed=zlib.crc32(r.text.encode()) % 2 == 0))
    rows = readers.pages_of(readers.pdf_files(spark, folder, content=True), pdf.page_texts, first=2)
    return rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "page_number", "text")


@query("SELECT source AS path, doc_id AS page_number, md5(text) AS digest FROM documents")
def s03_page_cache(spark, sf_dir):
    path = fresh_path(spark, "pages")
    sinks.write_json(
        table(spark, sf_dir, "documents").select(c("source").alias("path"), c("doc_id").cast("int").alias("page_number"), "text"),
        path
    )
    return readers.page_cache(spark, path).select("path", "page_number", F.md5("text").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest FROM documents WHERE text <> '' UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL FROM labels")
def s06_csv_logs(spark, sf_dir):
    """Two runs append to one log, each file with its header; texts have quotes and newlines. CSV keeps no empty text."""
    path = fresh_path(spark, "log")
    sinks.append_log(table(spark, sf_dir, "documents").where("text <> ''").select(c("doc_id").cast("string").alias("id"), "text"), path)
    sinks.append_log(
        table(spark, sf_dir, "labels").select(c("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("text")),
        path
    )
    return readers.csv(spark, path, "id string, text string").select("id", F.md5("text").alias("digest"))


@query(f"""WITH ids AS (SELECT source_file, row_number() OVER (ORDER BY source_file) AS document_id FROM (SELECT DISTINCT source_file FROM {_SQL_CHUNKS})),
first AS (SELECT source_file, chunk_index, row_number() OVER (ORDER BY source_file, chunk_index) AS id FROM {_SQL_CHUNKS}),
again AS (SELECT source_file, chunk_index, (SELECT max(id) FROM first) + row_number() OVER (ORDER BY source_file, chunk_index) AS id FROM {_SQL_CHUNKS} WHERE label < 3 AND vec_id % 2 = 0)
SELECT id, document_id, source_file, chunk_index, true AS stamped FROM (SELECT * FROM first WHERE source_file NOT IN (SELECT source_file FROM again) UNION ALL SELECT * FROM again) JOIN ids USING (source_file)""")
def s10_load_chunks(spark, sf_dir):
    """A load, and one that brings three files again with half their chunks. Also M01: rows are stamped."""
    folder = _store(spark, sf_dir, "store")
    some = _vector_chunks(spark, sf_dir).where("source_file IN ('f0', 'f1', 'f2') AND chunk_index % 2 = 0")
    sinks.load_chunks(spark, folder, some, 64)
    docs = readers.stored(spark, folder, "documents").select(c("id").alias("document_id"), c("indexed_at").isNotNull().alias("known"))
    return readers.stored(spark, folder, "rag_chunks").join(docs, "document_id").select(
        "id", "document_id", "source_file", "chunk_index", (c("created_at").isNotNull() & c("known")).alias("stamped")
    )


def _chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of ``conversations`` as events, added in three lots, of which the last repeats what the first has; then tidied up."""
    log = BucketTable(spark, fresh_path(spark, "chat"), schemas.CHAT_EVENTS, *schemas.BUCKETED["chat_events"])
    log.create()
    at = F.timestamp_seconds("turn")
    said = F.array(F.struct("role", c("text").alias("content"), F.lit(None).cast("string").alias("confidence_flag")))
    id_ = F.concat_ws("-", "conv_id", "turn")
    rows = table(spark, sf_dir, "conversations").select(
        id_.alias("event_id"), c("conv_id").cast("string").alias("conversation_id"), F.lit("turn").alias("kind"), at.alias("at"),
        F.when(c("turn") % 2 == 1, c("turn")).alias("user_id"), said.alias("messages"), F.lit(None).cast("long").alias("message_id"),
        *(F.lit(None).cast("string").alias(n) for n in ("rating", "reason"))
    )
    for lot in (0, 1, 0):
        log.append(rows.where(F.pmod(F.hash("event_id"), F.lit(2)) == lot))
    log.compact(2)
    return log.read()


@query("SELECT CAST(conv_id AS VARCHAR) AS id, min(turn) FILTER (turn % 2 = 1) AS user_id, left(arg_min(text, turn), 80) AS title, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def c02_event_log(spark, sf_dir):
    return chat_events.conversations(_chat_log(spark, sf_dir)).select(
        "id", "user_id", "title", F.unix_seconds("created_at").alias("first_turn"), F.unix_seconds("updated_at").alias("last_turn"), "n_messages"
    )


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_id, role, md5(text) AS digest, turn FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> ''")
def c04_event_messages(spark, sf_dir):
    return chat_events.messages(_chat_log(spark, sf_dir)).select(
        "conversation_id", "message_id", "role", F.md5("content").alias("digest"), F.unix_seconds("created_at").alias("turn")
    )


@query("SELECT 'f' || label AS source_file, count(*) AS n_chunks FROM embeddings WHERE label <> 2 GROUP BY label UNION ALL SELECT 'f2', count(*) FILTER (vec_id % 2 = 0) FROM embeddings WHERE label = 2 HAVING count(*) FILTER (vec_id % 2 = 0) > 0")
def s11_one_document_again(spark, sf_dir):
    """A document that comes again with half its chunks: its bucket is rewritten, and no part of another bucket."""
    folder = _store(spark, sf_dir, "store")
    chunks = schemas.in_buckets(spark, folder, "rag_chunks")
    before = {*chunks.parts()}
    hit = sinks.load_chunks(spark, folder, _vector_chunks(spark, sf_dir).where("source_file = 'f2' AND chunk_index % 2 = 0"), 64)
    if hit != [chunks.bucket_of("f2")] or {p for p in before - {*chunks.parts()}} != {p for p in before if p.endswith(f"={hit[0]}")}:
        raise RuntimeError("other buckets were rewritten than that of the document")
    return chunks.read().groupBy("source_file").agg(F.count("*").alias("n_chunks"))


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang")
def s12_json_report(spark, sf_dir):
    path = fresh_path(spark, "report")
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))
    sinks.write_json(rows, path, ["lang"])
    return spark.read.schema("lang string, n long, n_chars long").json(path)


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def s14_reports(spark, sf_dir):
    """A CSV file and a markdown file of one small result; read back from the CSV file."""
    path = fresh_path(spark, "report")
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(c("n").desc(), "source").limit(5)
    sinks.write_report(rows, f"{path}/csv")
    sinks.write_file(spark, f"{path}/report.md", sinks.markdown(rows).encode())
    if spark.read.text(f"{path}/report.md").count() != 2 + rows.count():
        raise RuntimeError("the markdown file has other rows than the result")
    return readers.csv(spark, f"{path}/csv", "source string, n long")


@query("SELECT unnest(['users', 'conversations', 'chat_messages', 'message_feedback', 'companies', 'documents', 'rag_chunks']) AS name, 0 AS n_rows, false AS made_again")
def s15_bootstrap(spark, sf_dir):
    folder = fresh_path(spark, "store")
    made, again = schemas.bootstrap(spark, folder), schemas.bootstrap(spark, folder)
    rows = [(n, readers.stored(spark, folder, n).count(), n in again) for n in made]
    return spark.createDataFrame(rows, "name string, n_rows long, made_again boolean")


@query("SELECT count(DISTINCT label) AS deleted, 0 AS documents, 0 AS chunks FROM embeddings")
def s16_delete_all(spark, sf_dir):
    folder = _store(spark, sf_dir, "store")
    gone = sinks.delete_all(spark, folder)
    left = [readers.stored(spark, folder, n).count() for n in ("documents", "rag_chunks")]
    return spark.createDataFrame([(gone, *left)], "deleted long, documents long, chunks long")


@query("SELECT count(*) FILTER (label IN (1, 4)) AS deleted, count(*) FILTER (label NOT IN (1, 4)) AS kept FROM embeddings")
def s17_delete_where(spark, sf_dir):
    folder = _store(spark, sf_dir, "store")
    gone = sinks.delete_where(spark, folder, "rag_chunks", c("source_file").isin("f1", "f4") | c("form_type").isNotNull())
    return readers.stored(spark, folder, "rag_chunks").agg(F.lit(gone).cast("long").alias("deleted"), F.count("*").alias("kept"))


@query("SELECT column_name AS \"column\", CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' ELSE data_type END AS type, ordinal_position - 1 AS place FROM information_schema.columns WHERE table_name = 'documents'")
def s18_catalog(spark, sf_dir):
    rows = [(n, t, i) for i, (n, t, _) in enumerate(readers.catalog(table(spark, sf_dir, "documents")))]
    return spark.createDataFrame(rows, "column string, type string, place int")


@query(f"SELECT source_file, count(*) AS n FROM {_SQL_CHUNKS} WHERE label % 3 = 1 AND label < 5 GROUP BY 1")
def s19_layout(spark, sf_dir):
    """Chunks laid out by year and company; the filter reads one folder."""
    path = fresh_path(spark, "layout")
    sinks.laid_out(_vector_chunks(spark, sf_dir), path)
    rows = spark.read.parquet(path).where((c("fiscal_year") == 2020) & c("company").isin("co0", "co1", "co2", "co3", "co4"))
    if "fiscal_year" not in sinks.explained(rows).split("PartitionFilters")[1].split("\n")[0]:
        raise RuntimeError("the filter doesn't choose folders")
    return rows.groupBy("source_file").agg(F.count("*").alias("n"))


_DENSE = r"(len(list_filter(w, lambda x: length(regexp_replace(x, '[$,%()\-.]', '', 'g')) > 0 AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 0.6 * length(regexp_replace(x, '[$,%()\-.]', '', 'g')))) >= 0.1 * len(w) AND len(w) > 0)"


@query(rf"SELECT source AS path, count(*) AS n_chunks, count(*) FILTER ({_DENSE}) AS n_dense, count(*) FILTER (lang = 'en') AS n_items, count(*) FILTER (lang = 'fr') AS n_ticker_missing FROM (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) GROUP BY source")
def a15_document_report(spark, sf_dir):
    """A15, A16 over documents as chunks: English ones have an item, French ones lack a ticker."""
    rows = table(spark, sf_dir, "documents").select(
        c("source").alias("path"),
        (T.numeric_density(c("text")) >= 0.1).alias("numeric_dense"),
        F.when(c("lang") == "en", "1").alias("item_number"),
        F.when(c("lang") != "fr", "T").otherwise("").alias("ticker")
    )
    return document_report(rows)


@query("SELECT lang, count(*) AS n, CAST(sum(2 * length(text)) AS BIGINT) AS twice FROM documents GROUP BY lang")
def t01_process_new(spark, sf_dir):
    """Files that come in two lots, and a run without new ones: each is taken once."""
    base = fresh_path(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    for lot in (0, 1, 2):
        if lot < 2:
            docs.where(F.pmod(F.hash("doc_id"), F.lit(2)) == lot).write.mode("append").parquet(f"{base}/in")
        incremental.process_new(
            spark,
            f"{base}/in",
            docs.schema,
            lambda d: d.select("lang", (2 * F.length("text")).alias("twice")),
            f"{base}/out",
            f"{base}/mark"
        ).awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("lang").agg(F.count("*").alias("n"), F.sum("twice").alias("twice"))


@query(f"SELECT source_file, count(*) AS n_chunks FROM {_SQL_CHUNKS} GROUP BY 1")
def t02_resumed_load(spark, sf_dir):
    """A stream of chunk files into the store; the second run takes only files that aren't loaded with as many chunks as they have."""
    base = fresh_path(spark, "bulk")
    rows = _vector_chunks(spark, sf_dir)
    schemas.bootstrap(spark, f"{base}/store")
    rows.where("chunk_index % 2 = 0").coalesce(2).write.mode("append").parquet(f"{base}/in")
    incremental.ingest(
        spark, f"{base}/in", rows.schema, lambda d, _: sinks.load_chunks(spark, f"{base}/store", d, 64), f"{base}/mark"
    ).awaitTermination()
    counts = rows.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
    loaded = batches.fully_loaded(counts, readers.stored(spark, f"{base}/store", "rag_chunks"))
    todo = batches.remaining(counts, loaded, ["source_file"])
    sinks.load_chunks(spark, f"{base}/store", rows.join(todo.select("source_file"), "source_file", "left_semi").select(*rows.columns), 64)
    return batches.fully_loaded(counts, readers.stored(spark, f"{base}/store", "rag_chunks"))


@query("SELECT CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN l.quality = 1 THEN 'live' ELSE 'backup' END AS answer FROM documents d LEFT JOIN labels l USING (doc_id)")
def t03_backup_and_merge(spark, sf_dir):
    """Outputs are kept aside before they are written anew; of both the usable rows stay, the live one first."""
    path = fresh_path(spark, "outputs")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs.select(
        c("doc_id").cast("string").alias("id"), F.lit("backup").alias("answer"), F.lit("ok").alias("confidence_flag")
    ).write.parquet(f"{path}/prev")
    labels.select(
        c("doc_id").cast("string").alias("id"),
        F.when(c("quality") == 1, "live").otherwise("").alias("answer"),
        F.lit("ok").alias("confidence_flag")
    ).write.parquet(f"{path}/live")
    return batches.merged(spark.read.parquet(f"{path}/prev"), spark.read.parquet(f"{path}/live")).select("id", "answer")


@query("SELECT 1 AS run, 1 AS done, 1 AS skipped, true AS quota, CAST(0 AS BIGINT) AS missing UNION ALL SELECT 2, 3, 0, false, 0")
def t04_limited_batches(spark, sf_dir):
    """Four files against a service: the first is done, the second times out, at the third the quota is spent. The second run does the rest and
    the one that timed out, so no label is missing."""
    base = fresh_path(spark, "limited")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    for lot in range(4):
        labels.where(F.pmod(F.hash("doc_id"), F.lit(4)) == lot).coalesce(1).write.mode("append").parquet(f"{base}/in")
    calls, rows = [], []

    def load(batch: DataFrame, _: int) -> None:
        calls.append(1)
        if len(calls) == 2:
            raise incremental.TimedOut("no answer")
        if len(calls) == 3:
            raise incremental.QuotaSpent("429 for today")
        batch.write.mode("append").parquet(f"{base}/out")

    for run in (1, 2):
        o = incremental.run_batches(spark, f"{base}/in", "doc_id long", load, f"{base}/mark")
        rows.append((run, o["done"], o["skipped"], o["quota"]))
    missing = batches.remaining(labels, spark.read.parquet(f"{base}/out"), ["doc_id"]).count()
    return spark.createDataFrame(
        [(*r, missing if r[0] == 2 else 0) for r in rows], "run int, done int, skipped int, quota boolean, missing long"
    )


@query("SELECT doc_id % 4 AS lot, CASE doc_id % 4 WHEN 1 THEN 'dead' ELSE 'done' END AS outcome, count(*) AS n, count(DISTINCT doc_id) AS n_ids FROM labels GROUP BY 1, 2")
def t04_attempts(spark, sf_dir):
    """Files of ``labels`` in four lots against a service that never answers for one and not at first for another: in three runs the first is given up
    and all others are done, once each; the source has the rows that it had."""
    base = fresh_path(spark, "attempts")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    for lot in range(4):
        labels.where(F.pmod("doc_id", F.lit(4)) == lot).coalesce(1).write.mode("append").parquet(f"{base}/in")
    refused = []

    def load(batch: DataFrame, _: int) -> None:
        lot = batch.agg(F.min(F.pmod("doc_id", F.lit(4)))).first()[0]
        if lot == 1 or (lot == 2 and lot not in refused):
            refused.append(lot)
            raise incremental.TimedOut("no answer")
        batch.write.mode("append").parquet(f"{base}/out")

    before = spark.read.parquet(f"{base}/in").count()
    for _ in range(3):
        incremental.run_batches(spark, f"{base}/in", "doc_id long", load, f"{base}/mark")
    if spark.read.parquet(f"{base}/in").count() != before or refused.count(1) != 3:
        raise RuntimeError("the source was written, or a batch was tried more or less often than three times")
    dead = incremental.dead_letters(spark, f"{base}/mark", "doc_id long")
    ends = spark.read.parquet(f"{base}/out").withColumn("outcome", F.lit("done")).unionByName(dead.withColumn("outcome", F.lit("dead")))
    return ends.groupBy(F.pmod("doc_id", F.lit(4)).alias("lot"), "outcome").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@query("SELECT 'good.parquet' AS file, count(*) AS n_rows, false AS failed FROM embeddings UNION ALL SELECT 'broken.parquet', NULL, true UNION ALL SELECT 'other.parquet', count(*), true FROM labels")
def t05_file_status(spark, sf_dir):
    """A chunk file, one that is no Parquet, and one with other columns: two failures are two rows."""
    base = fresh_path(spark, "chunk-files")
    rows = _vector_chunks(spark, sf_dir).select(c("content").alias("text"), "source_file", "embedding")
    for name, df in (("good", rows), ("other", table(spark, sf_dir, "labels"))):
        df.coalesce(1).write.parquet(f"{base}/{name}")
        made = spark.read.parquet(f"{base}/{name}").inputFiles()[0]
        at, store = sinks._place(spark, made)
        store.rename(at, sinks._place(spark, f"{base}/{name}.parquet")[0])
        store.delete(sinks._place(spark, f"{base}/{name}")[0], True)
    sinks.write_file(spark, f"{base}/broken.parquet", b"PAR1 not really PAR1")
    return readers.chunk_file_status(spark, base).select(
        F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "n_rows", c("error").isNotNull().alias("failed")
    )


@query("SELECT lang AS run_tag, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def p19_stored_runs(spark, sf_dir):
    """Results stored by tag: a tag is a folder."""
    path = fresh_path(spark, "runs")
    evals.tagged(
        table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", "lang"), c("lang")
    ).drop("lang").write.partitionBy("run_tag").parquet(path)
    return spark.read.schema("doc_id long, run_tag string").parquet(path).groupBy("run_tag").agg(F.count("*").alias("n"))
