"""Search, store, resumable batches and streams."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import facts, search
from foliant.operators.numbering import numbered
from foliant.sources import pdf, readers, schemas, sinks
from foliant.streaming import incremental


def chunk_rows(spark, docs):
    rows = [
        (
            d, i, f"text {d} {i}", 6, [float(i + 1), 1.0], "T", "c", 2020 + n, None, None, None, None, None, 0.1, None
        ) for n, (d, k) in enumerate(docs) for i in range(k)
    ]
    return spark.createDataFrame(rows, "source_file string, chunk_index int, content string, n_chars int, embedding array<float>, ticker string, company string, fiscal_year int, form_type string, accounting_standard string, canonical_section string, page_start int, page_end int, numeric_density float, company_name_mismatch boolean")


def test_load_replaces_and_deletes(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert len(schemas.bootstrap(spark, folder)) == len(schemas.TABLES)
    assert schemas.bootstrap(spark, folder) == []
    sinks.load_chunks(spark, folder, chunk_rows(spark, [("a", 3), ("b", 2)]), 2)
    sinks.load_chunks(spark, folder, chunk_rows(spark, [("a", 2), ("c", 1)]), 2)
    chunks = readers.stored(spark, folder, "rag_chunks")
    assert {
        (r.source_file, r.n) for r in chunks.groupBy("source_file").agg(F.count("*").alias("n")).collect()
    } == {("a", 2), ("b", 2), ("c", 1)}
    assert chunks.select("id").distinct().count() == 5
    assert sinks.delete_where(spark, folder, "rag_chunks", F.col("company_name_mismatch")) == 0
    assert sinks.delete_where(spark, folder, "rag_chunks", F.col("source_file") == "b") == 2
    assert sinks.delete_all(spark, folder) == 3
    assert readers.stored(spark, folder, "rag_chunks").count() == 0


def test_a_service_answers_keeps_and_rates(spark, tmp_path):
    from foliant.functions import vectors
    from foliant.plans.service import Invalid, NotFound, Service

    embed = vectors.embed(lambda: vectors.hashing_encoder(16))
    service = Service(spark, f"file://{tmp_path}/store", embed, dimension=16)
    assert service.health()["status"] == "unavailable" and service.chat("hello there")["confidence_flag"] == "system_unavailable"
    assert service.start().health() == {"status": "ok", "chunks": 0} and service.welcome()
    rows = chunk_rows(spark, [("a", 3), ("b", 2)]).withColumn(
        "content", F.concat(F.lit("Revenue of apple inc in part "), F.col("chunk_index").cast("string"))
    )
    rows = rows.withColumns(
        {"company": F.lit("apple-inc"), "ticker": F.lit("AAPL"), "company_name_mismatch": F.lit(False)}
    ).withColumn("embedding", embed(F.col("content")))
    assert service.ingest(rows) == 5
    hits, meta = service.search("Revenue of apple inc in part 1", 2, company=["apple-inc"])
    assert hits.count() == 2 and meta["filters_applied"] == {"company": ["apple-inc"]}
    first = service.chat("What was the revenue of AAPL in 2020?", user_id=7)
    again = service.chat("And of AAPL in 2021?", first["conversation_id"].upper())
    assert first["sources"] and again["conversation_id"] == first["conversation_id"] and again["message_id"] == first["message_id"] + 2
    assert [r.role for r in service.history(first["conversation_id"]).collect()] == ["user", "assistant"] * 2
    assert service.save_feedback(first["conversation_id"], first["message_id"], "up", "good") == 1
    assert [r.rating for r in service.feedback(first["conversation_id"]).collect()] == ["up"]
    assert service.source(first["sources"][0]["chunk_id"])["company"] == "apple-inc"
    for wrong in (lambda: service.chat("  "), lambda: service.save_feedback(first["conversation_id"], first["message_id"], "meh")):
        with pytest.raises(Invalid):
            wrong()
    for wrong in (
        lambda: service.source("x"),
        lambda: service.source("999"),
        lambda: service.save_feedback(first["conversation_id"], 999, "up")
    ):
        with pytest.raises(NotFound):
            wrong()


def test_wrong_dimension_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    schemas.bootstrap(spark, folder)
    with pytest.raises(Exception, match="vector of 2 numbers"):
        sinks.load_chunks(spark, folder, chunk_rows(spark, [("a", 1)]), 3)


@pytest.mark.parametrize("parts", [1, 8])
def test_filter_comes_before_search(spark, parts):
    rows = spark.range(400).select(
        "id", (F.col("id") % 40).alias("company"), F.array(F.lit(1.0), (F.col("id") % 3).cast("double")).alias("embedding")
    ).repartition(parts)
    hits = search.top_k(rows.where("company = 39"), [1.0, 0.0], 5).collect()
    assert len(hits) == 5 and [h.id for h in hits] == sorted((h.id for h in hits), key=lambda i: (i % 3, i))
    assert [
        h.id for h in search.top_k_scan(rows, [1.0, 0.0], 5).collect()
    ] == [h.id for h in search.top_k(rows, [1.0, 0.0], 5).collect()] == [0, 3, 6, 9, 12]
    asked = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(7)], "query_id long, query_vector array<double>")
    assert search.batch_top_k(rows, asked, 2).count() == 14
    blocks = search.batch_scan(rows, asked, 2, block=3)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, search.batch_scan(rows, asked, 2).collect()))
    assert search.clamped(0) == 1 and search.clamped(99) == 20


def test_a_batch_of_questions_gets_what_each_gets_alone(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 8)).round(1)
    m[7] = 0
    rows = spark.createDataFrame(
        [(i, m[i].tolist() if i != 9 else None, f"text {i}") for i in range(300)], "id long, embedding array<float>, content string"
    ).repartition(5)
    q = [*rng.normal(size=(5, 8)).tolist(), [0.0] * 8]
    asked = spark.createDataFrame([(f"q{j}", v) for j, v in enumerate(q)] + [("none", None)], "query_id string, query_vector array<double>")
    got = search.batch_top_k(rows, asked, 4).collect()
    for j, v in enumerate(q[:5]):
        alone = [(r.id, round(r.similarity, 9)) for r in search.top_k(rows, v, 4).collect()]
        assert [(r.id, round(r.similarity, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == f"q{j}"] == alone
    assert all(r.content == f"text {r.id}" for r in got)
    scoped = search.batch_top_k(
        rows.withColumn("g", F.col("id") % 2), asked.withColumn("g", F.lit(1).cast("long")), 3, on=["g"]
    ).where("query_id = 'q0'").collect()
    assert len(scoped) == 3 and all(r.id % 2 for r in scoped)


def test_approximate_search_finds_nine_of_ten(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    m = np.concatenate([c + 0.25 * rng.normal(size=(50, 32)) for c in centres]) * rng.uniform(0.2, 5, size=(2000, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(4).cache()
    hits = 0
    for i in range(0, 2000, 200):
        q = m[i].tolist()
        hits += len(
            {
                r.id for r in search.top_k_approximate(rows, q, 10).collect()
            } & {r.id for r in search.top_k_scan(rows, q, 10).collect()}
        )
    assert hits >= 90, hits


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    keys = [(rng.randint(0, 50), rng.randint(0, 9)) for _ in range(2000)]
    got = numbered(spark.createDataFrame(keys, "a int, b int").repartition(7), ["a", "b"], 11).orderBy("id").collect()
    assert [r.id for r in got] == list(range(11, 2011)) and [(r.a, r.b) for r in got] == sorted(keys)
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_a_table_comes_back_after_a_run_that_died_between_renames(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}.old-abc")
    assert sinks.recovered(spark, path) and spark.read.parquet(path).count() == 3 and not sinks.recovered(spark, path)


def test_errors_of_services_are_told_apart():
    kinds = [
        (incremental.QuotaSpent("x"), "quota"),
        (ValueError("HTTP 429"), "quota"),
        (TimeoutError(), "timeout"),
        (ValueError("read timeout"), "timeout"),
        (ValueError("broken"), "error")
    ]
    assert [incremental.kind_of(e) for e, _ in kinds] == [k for _, k in kinds]


def test_other_errors_end_a_run(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")

    def load(batch, number):
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        incremental.run_batches(spark, f"{tmp_path}/in", "id long", load, f"{tmp_path}/mark")


def test_texts_of_pdf_pages():
    texts = ["Item 1. (Business) \\ now\nsecond line", "", "a  b"]
    for packed in (True, False):
        assert pdf.page_texts(pdf.simple_pdf(texts, packed)) == texts
    page = b"BT /F1 9 Tf [(Re) 20 (venue) -300 (grew)] TJ 0 -12 Td <0041> Tj (\\101\\(x\\)) ' ET"
    table = b"1 beginbfchar <0041> <00C9> endbfchar 1 beginbfrange <0100> <0102> <0061> endbfrange"
    raw = b"%%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R]/Resources<</Font<</F1 4 0 R>>>>>> endobj 3 0 obj <</Type/Page/Contents [5 0 R]>> endobj 4 0 obj <</Type/Font/Subtype/Type1>> endobj 5 0 obj <</Length %d>> stream\n%s\nendstream endobj" % (len(page), page)
    assert pdf.page_texts(raw) == ["Revenue grew\n\x00A\nA(x)"]
    wide = raw.replace(
        b"/Subtype/Type1>>", b"/Subtype/Type0/ToUnicode 6 0 R>>"
    ).replace(
        page, page.replace(b"(\\101\\(x\\)) '", b"<00410101> '")
    ) + b" 6 0 obj <</Length 9>> stream\n" + table + b"\nendstream endobj"
    assert pdf.page_texts(wide)[0].endswith("É\nÉb")
    for bad in (b"", b"plain", b"%PDF-1.4 /Encrypt 3 0 R"):
        with pytest.raises(ValueError):
            pdf.page_texts(bad)


def test_the_evaluation_set_has_all_categories(spark):
    names = ["acme", *(f"{chr(97 + i % 26)}{'orth' if i < 26 else 'elta'}" for i in range(45))]
    rows = [
        (
            f"{n}-tools-inc",
            n[:3].upper() if i % 4 else None,
            y,
            "net income",
            str(1000 * i + y),
            2,
            f"net income {1000 * i + y} {y}"
        ) for i, n in enumerate(names) for y in (2019, 2020)
    ]
    rows += [("acme-works", "ACW", 2020, "gross profit", "77", 1, "gross profit 77")]
    facts_ = spark.createDataFrame(rows, "company string, ticker string, fiscal_year int, label string, value string, n_figures int, source_line string")
    got = facts.evaluation_set(facts_, facts_.select("company", "ticker").distinct()).collect()
    by = collections.Counter(r.category for r in got)
    assert list(
        dict.fromkeys(r.category for r in sorted(got, key=lambda r: r.id))
    ) == list(facts.QUOTAS) and [r.id for r in sorted(got, key=lambda r: r.id)] == list(range(1, len(got) + 1))
    assert all(
        by[k] <= n for k, n in facts.QUOTAS.items()
    ) and by["exact_fact"] == 13 and by["off_topic"] == 4 and by["fiscal_year_discrimination"] == 8 and by["disambiguation"] == 2
    taken = [{r.company for r in got if r.category == k} for k in ("exact_fact", "fuzzy_no_ticker", "typo_tolerance", "language_parity")]
    assert all(not a & b for i, a in enumerate(taken) for b in taken[:i])


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(
        "id", (F.col("id") % 2).cast("string").alias("company"), F.lit(2020).alias("fiscal_year")
    ).write.parquet(f"{tmp_path}/t")
    plan = search.filtered(
        spark.read.parquet(f"{tmp_path}/t"), company=["1"], fiscal_year=2020
    )._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(fiscal_year,2020)" in plan and ("In(company, [1])" in plan or "EqualTo(company,1)" in plan)


def test_csv_keeps_ids_as_strings(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("007", 'a "b"\nc')], "id string, q string"), f"{tmp_path}/r")
    sinks.append_log(spark.createDataFrame([("1", "x")], "id string, q string"), f"{tmp_path}/log")
    sinks.append_log(spark.createDataFrame([("2", "y")], "id string, q string"), f"{tmp_path}/log")
    assert readers.csv(spark, f"{tmp_path}/log", "id string, q string").count() == 2
    assert "| id | q |" in sinks.markdown(spark.createDataFrame([("1", "x")], "id string, q string"))


def test_bad_files_are_rows(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "d" / "b.pdf").write_bytes(b"!")
    (tmp_path / "d" / "c.PDF").write_bytes(b"not listed")

    def extract(raw):
        if raw == b"!":
            raise ValueError("broken")
        return raw.decode().split("|")

    rows = readers.pages_of(readers.pdf_files(spark, str(tmp_path), content=True), extract).collect()
    assert sorted(
        (r.path.rsplit("/", 1)[1], r.page_number, r.text) for r in rows if not r.error
    ) == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    assert [r.error for r in rows if r.error] == ["ValueError: broken"]


def test_streams_take_each_file_once(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{n}" for n in ("src", "out", "mark"))
    spark.range(5).write.mode("append").parquet(src)
    for _ in range(2):
        incremental.process_new(spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), out, mark).awaitTermination()
        assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    incremental.process_new(spark, src, "id long", lambda d: d.withColumn("twice", F.col("id") * 2), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 8
    seen = []
    incremental.ingest(spark, src, "id long", lambda df, i: seen.append(df.count()), f"{tmp_path}/mark2", 1).awaitTermination()
    assert sum(seen) == 8 and len(seen) > 1


def test_ingest_reads_its_pages_once(spark):
    """no chunk is joined to its document's cover, and the cleaning is in the plan once."""
    from foliant.plans.ingest import chunk_pages

    said = "Acme, Inc.\n(Exact Name of Registrant as Specified in its Charter)"
    pages = [("a/acme-inc/NASDAQ_ACME_2020.pdf", i, t) for i, t in enumerate(("UNITED STATES SECURITIES AND EXCHANGE COMMISSION FORM 20-F REPORT PURSUANT TO SECTION 13 OR 15(d)\n" + said, "Item 7. Holders\n" + "beneficial owner " * 300, "Item 8. Figures\n" + "one two " * 300))]
    out = chunk_pages(spark.createDataFrame(pages, "path string, page_number int, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 2, plan  # repeated lines, and the table of sections
    rows = sorted(out.collect(), key=lambda r: r.chunk_index)
    assert [(r.label, r.page_start, r.canonical_section) for r in rows][:2] == [("Item 7", 1, "security_ownership"), ("Item 7", 1, "security_ownership")]
    assert rows[-1].label == "Item 8" and rows[-1].page_end == 2 and all(r.company == "acme-inc" and r.registrant_name == "Acme, Inc." for r in rows)
