"""The inverted-file index against a full scan: what it finds, what it reads, and rows that are odd."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import blocks, search, vector_index

VECTORS = "vec_id long, embedding array<float>"


def clustered(spark, n=3000, dimension=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, dimension))
    m = centres[rng.integers(0, 60, n)] + 0.2 * rng.normal(size=(n, dimension))
    m = m * rng.uniform(0.2, 5, size=(n, 1))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], VECTORS).repartition(4), m.astype(np.float32)


def hundredths(rows):
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def brute(m, asked, k):
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    return {i: np.lexsort((np.arange(len(u)), -(u @ u[i])))[:k].tolist() for i in asked}


def by_question(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_recall_and_what_is_read(spark, tmp_path):
    rows, m = clustered(spark)
    index = vector_index.build_index(rows, f"file://{tmp_path}/index", "vec_id")
    want = brute(m, range(0, 3000, 100), 10)
    exact = vector_index.search_exact(index, hundredths(rows), 10)
    assert by_question(exact) == want
    near = vector_index.search_index(index, hundredths(rows), 10)
    hits = sum(len({*by_question(near)[i]} & {*x}) for i, x in want.items())
    assert hits >= 0.9 * 10 * len(want), hits
    # The plan names the cells to read: few for one question, by either search.
    one = hundredths(rows).where("query_id = 700")
    for found in (vector_index.search_index(index, one, 10), vector_index.search_exact(index, one, 10)):
        plan = found._jdf.queryExecution().toString()
        listed = re.search(r"PartitionFilters: \[[^\]]*cell#\d+ (?:IN \(([^)]*)\)|= (\d+))", plan)
        assert listed, plan
        n_cells = len((listed[1] or listed[2]).split(","))
        assert n_cells <= 8 < len(index.centroids)
        assert by_question(found)[700] == want[700]


def test_recall_where_rows_are_noise(spark, tmp_path):
    """Without clusters the measured probes are many, and recall holds."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vector_index.build_index(rows, f"file://{tmp_path}/index", "vec_id")
    exact = by_question(search.batch_scan(rows, hundredths(rows), 10, key="vec_id"))
    found = by_question(vector_index.search_index(index, hundredths(rows), 10))
    assert sum(len({*found[i]} & {*x}) for i, x in exact.items()) >= 0.9 * 10 * len(exact)


def test_rows_are_added_and_the_index_opens_again(spark, tmp_path):
    rows, m = clustered(spark, 800)
    index = vector_index.build_index(rows.where("vec_id < 500"), f"file://{tmp_path}/index", "vec_id")
    again = vector_index.open_index(spark, index.path)
    assert (again.centroids == index.centroids).all() and (again.key, again.probes) == ("vec_id", index.probes)
    vector_index.add_rows(again, rows.where("vec_id >= 500"))
    assert again.rows(spark).agg(F.sum(F.size("keys"))).first()[0] == 800
    assert by_question(vector_index.search_exact(again, hundredths(rows), 5)) == brute(m, range(0, 800, 100), 5)


def test_odd_rows(spark, tmp_path):
    none = vector_index.build_index(spark.createDataFrame([], VECTORS), f"file://{tmp_path}/none", "vec_id")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    assert vector_index.search_index(none, one).count() == vector_index.search_exact(none, one).count() == 0
    same = [(i, [1.0, 1.0]) for i in range(1500)]  # one value with most of the rows is several blocks
    odd = spark.createDataFrame([*same, (2000, None), (2001, [0.0, 0.0]), (2002, [0.0, 2.0]), (2003, [1.0, 0.0]), (2003, [1.0, 0.0])], VECTORS)
    index = vector_index.build_index(odd, f"file://{tmp_path}/odd", "vec_id", cells=3)
    assert index.rows(spark).where("cell = 0 OR cell = 1 OR cell = 2").agg(F.sum(F.size("keys"))).first()[0] == 1503
    assert index.rows(spark).agg(F.max(F.size("keys"))).first()[0] == blocks.ROWS
    got = vector_index.search_exact(index, one, 4).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1, 2003), (1, 2003), (1, 0), (1, 1)]
    assert vector_index.search_exact(index, one, 2000).where("query_id = 1").count() == 1503


@pytest.mark.parametrize("size", [3, 1000])
def test_blocks_meet_by_value(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(0, 3, 2).tolist() if i % 7 else None, int(rng.integers(0, 3)) if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], g) for i, v, g in rows], "id long, v array<float>, g int")
    asked = df.where("id < 9").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"), "g")
    got = blocks.best_pairs(blocks.packed(df, ["g"], "id", "v", size), blocks.packed(asked, ["g"], "query_id", "query_vector", size), ["g"], 4)
    want = set()
    for q, a, g in rows[:9]:
        if a is not None and g is not None:
            sims = []
            for i, b, h in rows:
                if b is not None and h == g:
                    length = np.linalg.norm(a) * np.linalg.norm(b)
                    sims.append((-(np.dot(a, b) / length) if length else 2, i))
            sims = sorted((round(s, 9), i) for s, i in sims)[:4]
            want |= {(q, i, None if s == 2 else round(-s, 6)) for s, i in sims}
    assert {(r.query_id, r.id, None if r.similarity is None else round(r.similarity, 6)) for r in got.collect()} == want


def test_an_empty_list_can_match_nothing(spark):
    chunks = spark.createDataFrame([(1, "T", "a"), (2, None, "b")], "id long, ticker string, content string")
    assert search.filtered(chunks, ticker=[]).count() == 2
    assert search.filtered(chunks, ticker=[], empty_matches_nothing=True).count() == 0
    assert search.filtered(chunks, ticker=None, empty_matches_nothing=True).count() == 2
