"""The pipeline's stages against what each is for, and the registered queries with SQL against DuckDB."""

import random
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm import bpe, decontam, host_quality, jaccard, licenses, queries, secrets, sst, token_counts, toxicity
from foliant.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = table(spark, DATA, "documents"), {}
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out[name] = (before, docs)
    return out


def test_all_but_the_last_return_documents(spark, stages):
    columns = table(spark, DATA, "documents").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "bpe")
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]


def test_decisions_take_effect(spark, stages):
    before, after = stages["near_duplicates"]
    assert {r.doc_id for r in jaccard.classes(before).where("doc_id = class_id").collect()} == {r.doc_id for r in after.collect()}
    before, after = stages["decontamination"]
    bad = decontam.find_windows(before.select("doc_id", "text"), table(spark, DATA, "benchmark")).where(decontam.contaminated())
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in bad.collect()} == {r.doc_id for r in after.collect()}
    before, after = stages["secrets"]
    assert before.count() == after.count()
    assert all(not secrets.find(r.text)[0] and r.n_chars == len(r.text) for r in after.collect())
    before, after = stages["bpe"]
    assert before.count() == after.count() and after.where(F.size("bpe_ids") != F.col("n_tokens")).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in stages["bpe"][1].collect()}


def test_odd_documents_pass(spark, stages):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words here", "en", "s", 16)],
        "doc_id long, text string, lang string, source string, n_chars long"
    ).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert sorted(r.n_tokens for r in docs.collect()) == [0, 0, 0, 3]
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_no_row_goes_for_another_of_its_id(spark, few):
    a, b, bad = " ".join(
        f"a{i}" for i in range(50)
    ), " ".join(f"b{i}" for i in range(50)), table(spark, DATA, "benchmark").where("length(text) > 200").first().text
    rows = [
        (None, a),
        (7, a),
        (7, b + " tail"),
        (3, a + " x"),
        (None, None),
        (9, None),
        (9, b + " other words that end it"),
        (None, "alone of its kind here now")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(
        map(tuple, jaccard.keep_one(df, max_broadcast=few).collect()), key=repr
    ) == sorted([rows[2], *rows[3:6], rows[7]], key=repr)
    rows = [(None, a), (None, None), (None, bad), (4, bad), (4, b)]
    left = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[0], rows[1], rows[4]], key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_give_what_sql_gives(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        p = Path(DATA, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, DATA)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(names).collect()), key=repr) == sorted((tuple(r) for r in cursor.fetchall()), key=repr)


def test_contract_columns(spark):
    want = {
        "op1": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op2": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op3": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op4": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op6": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op7": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
        "op8": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op9": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
        "op10": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    }
    found = {n.split("_")[0]: f for n, f in queries.queries().items()}
    n_docs = table(spark, DATA, "documents").count()
    for op, columns in want.items():
        df = found[op](spark, DATA)
        assert columns.items() <= dict(df.dtypes).items(), op
        assert df.count() == (table(spark, DATA, "pages").count() if op == "op1" else n_docs), op


def test_very_long_texts_and_clashing_columns(spark, tmp_path):
    """A text of two hundred thousand words goes through each operator whole, beside short ones, with columns named like results and internals."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(200_000)) + " password=hunter2hunter2 Released under the MIT License."
    texts = [long, "short text", None, long + " end"]
    names = ["digest", "n_tokens", "key", "row", "words", "start", "score", "units", "sketch", "hits", "__text", "__key", "tie", "host"]
    docs = spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string"
    ).select("*", *(F.lit("clash").alias(n) for n in names))
    by = lambda df, c: [r[c] for r in df.orderBy("doc_id").collect()]
    assert by(bpe.encode_documents(docs, P.path("word_bpe_49k.json"), ids=False), "n_tokens")[1] == 2
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert by(
        bpe.encode_documents(docs, P.path("word_bpe_49k.json"), ids=False), "n_tokens"
    )[0] == len(library.encode(long, add_special_tokens=False).ids)
    counts = by(token_counts.count_tokens(docs, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"), "n_tokens")
    assert counts[2] == 0 and counts[3] > counts[0] > 200_000
    assert by(secrets.find_secrets(docs), "n_assign") == [1, 0, 0, 1]
    assert by(licenses.document_licences(docs), "licences") == ["mit", "", "", "mit"]
    assert by(jaccard.classes(docs), "class_id") == [0, 1, 2, 0]
    assert by(host_quality.measures(docs), "n_words") == [200_006, 2, 0, 200_007]
    found = decontam.find_windows(docs, spark.createDataFrame([("i", " ".join(long.split()[1000:1020]))], "item_id string, text string"))
    assert by(found, "n_hit") == [20, 0, 0, 20]
    folder = f"file://{tmp_path}/shards"
    sst.write_shards(docs, folder, P.path("byte_bpe_50k.json"), end_id=2)
    sizes = by(sst.read_documents(spark, folder), "n_tokens")
    assert sizes[2] == 1 and sizes[3] > sizes[0] > 200_000
    scored = toxicity.score_documents(docs, toxicity.Model({"w1": 2.0}, -1.0))
    assert [round(x, 3) for x in by(scored, "score")] == [0.731, 0.269, 0.269, 0.731]
