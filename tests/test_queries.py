"""Every registered query with SQL gives what DuckDB gives on the same tables; the others run."""

import math
from pathlib import Path

import duckdb
import pytest

from foliant.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clients sales sale_lines items".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = Path(DATA, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(same, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(((tuple(same(r[c]) for c in columns)) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(same(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_answers_search_every_document(spark, tmp_path):
    from foliant.functions.vectors import hashing_encoder

    encode = hashing_encoder(64)
    asked = {5: "What is the capital of France?", 7: "What happened in the market in 2022?"}
    texts = ["plain words", "of other things", "and more", asked[5] + " Paris", asked[7] + " nothing", "last"]
    spark.createDataFrame(
        [(i, t, "en", "src0" if i else None, len(t)) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.question_id: r for r in QUERIES["c07_hashed_answers"](spark, str(tmp_path)).collect()}
    for i, question in asked.items():
        best = (encode(texts) @ encode([question])[0]).max()
        assert got[i].n_sources == 5 and (got[i].flag != "low_confidence") == (best >= 0.4)


def test_answers_shuffle_no_text(spark, monkeypatch):
    """what the best of a few questions say is joined to them where it lies; many are joined by a shuffle, with the same result."""
    from foliant.plans import answer

    def got():
        df = QUERIES["c07_answers"](spark, DATA)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return sorted(map(tuple, df.collect())), "leftHint=(strategy=broadcast)" in plan

    few, sent = got()
    monkeypatch.setattr(answer, "BROADCAST_ROWS", 0)
    assert sent and got() == (few, False)
