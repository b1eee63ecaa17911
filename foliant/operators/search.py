"""Vector search over chunks: filters first, exact similarity, a deterministic top k."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.functions import vectors
from foliant.functions.text import snippet
from foliant.operators import blocks
from foliant.session import ship

LENGTH_CAP = 20_000
MAX_K = 20


def clamped(k: int) -> int:
    """V04."""
    return min(max(k, 1), MAX_K)


def filtered(
    chunks: DataFrame,
    ticker: Sequence[str] | None = None,
    company: Sequence[str] | None = None,
    fiscal_year: int | None = None,
    length_cap: int = LENGTH_CAP,
    content: str = "content",
    empty_matches_nothing: bool = False
) -> DataFrame:
    """An empty or missing list is no filter, year 0 is one; a cap of 0 is none. Where ``empty_matches_nothing``, as in the store's
    function (S09), only a missing list is no filter."""
    rows = chunks
    for name, wanted in (("ticker", ticker), ("company", company)):
        if wanted or (empty_matches_nothing and wanted is not None):
            rows = rows.where(F.col(name).isin(list(wanted)))
    if fiscal_year is not None:
        rows = rows.where(F.col("fiscal_year") == fiscal_year)
    if length_cap and content in chunks.columns:
        rows = rows.where(F.length(content) < length_cap)
    return rows


def top_k(rows: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "id") -> DataFrame:
    """Rows of ``rows`` (already filtered) with ``similarity``, best first, ties by key."""
    return rows.withColumn(
        "similarity", vectors.similarity_to(F.col(vector), query)
    ).orderBy(F.col("similarity").desc_nulls_last(), key).limit(clamped(k))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """Vectors as rows; a missing one is not a number."""
    if column.null_count == 0:
        return np.asarray(column.flatten(), float).reshape(-1, dimension)
    return np.array([v if v is not None else [np.nan] * dimension for v in column.to_pylist()], float).reshape(-1, dimension)


def _cosines(m: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Similarities of the rows of ``m`` to unit vectors, a column each; that of a zero vector is not a number."""
    size = np.linalg.norm(m, axis=1)[:, None]
    return np.divide(m @ unit.T, size, out=np.full((len(m), len(unit)), np.nan), where=size > 0)


def top_k_scan(
    rows: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "id", columns: Sequence[str] = ()
) -> DataFrame:
    """The same over a full scan, by matrix products: each batch keeps its best k, the last step the best of those."""
    n = clamped(k)
    q = np.array([query], float)
    q = q / (np.linalg.norm(q) or 1.0)
    kept = rows.select(key, *columns, vector)
    schema = kept.drop(vector).schema.add("similarity", "double")
    names = [*kept.columns[:-1], "similarity"]
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = _cosines(_matrix(batch.column(batch.num_columns - 1), q.shape[1]), q)[:, 0]
            best = np.lexsort((np.asarray(batch.column(0).to_pandas()), -np.nan_to_num(sim, nan=-2)))[:n]
            part = batch.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sim[best], from_pandas=True)], names=names)

    return kept.mapInArrow(run, schema).orderBy(F.col("similarity").desc_nulls_last(), key).limit(n)


def batch_scan(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    key: str = "id",
    query_key: str = "query_id",
    block: int = 2_000
) -> DataFrame:
    """V02 for a stated set of questions against all rows: (query_key, key, similarity, rank), ``block`` questions at a time.

    A block's vectors are sent to all executors, and each batch of rows keeps its best k for each question of the block, by one matrix product. So
    no pair of a row and a question is made that isn't among the best of its batch, and only keys and scores are shuffled.
    """
    n, spark = clamped(k), ship(rows.sparkSession)
    kept = rows.select(key, vector)
    found = StructType().add("__q", "long").add(kept.schema[key]).add("similarity", "double")
    asked_as, parts, total = queries.select(query_key).schema, [], queries.count()
    blocks = max(1, -(-total // block))
    for i in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == i)
        asked = own.select(query_key, F.col("query_vector").cast("array<double>")).where("query_vector IS NOT NULL").collect()
        if asked:
            ids = spark.createDataFrame([(j, r[0]) for j, r in enumerate(asked)], StructType().add("__q", "long").add(asked_as[0]))
            parts.append(kept.mapInArrow(_best_of([r[1] for r in asked], n, found.names), found).join(F.broadcast(ids), "__q").drop("__q"))
    if not parts:
        return spark.createDataFrame([], StructType([asked_as[0], *found.fields[1:]])).withColumn("rank", F.lit(0))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.select(query_key, key, "similarity")
    return every.withColumn("rank", F.row_number().over(_by(query_key, key))).where(F.col("rank") <= n)


def _best_of(vectors_: list[list[float]], n: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map from batches of (key, vector) to (place of the question, key, similarity) of each question's best ``n``."""
    q = np.array(vectors_, float)
    size = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, size, out=np.full_like(q, np.nan), where=size > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                sim = np.nan_to_num(_cosines(_matrix(part.column(1), q.shape[1]), q), nan=-2)
                keys = np.asarray(part.column(0).to_pandas())
                by_key = np.argsort(keys, kind="stable")  # ties go by key
                best = by_key[np.argsort(-sim[by_key], axis=0, kind="stable")[:n]]
                row, column = best.T.ravel(), np.repeat(np.arange(len(q)), min(n, part.num_rows))
                found = sim[row, column]
                scores = pa.array(found, pa.float64(), mask=found < -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()), part.column(0).take(pa.array(row)), scores], names=names)

    return run


def top_k_approximate(
    rows: DataFrame,
    query: Sequence[float],
    k: int = 5,
    vector: str = "embedding",
    key: str = "id",
    bucket: float = 1.0,
    tables: int = 16,
    candidates: int = 200
) -> DataFrame:
    """V03 by random projections: LSH proposes ``candidates`` of the filtered rows, exact similarity orders them. Vectors are hashed at unit length,
    where the nearest by distance are the nearest by angle."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    own = F.col(vector).cast("array<double>")
    size = vectors.norm(F.col(vector))
    unit = rows.where(size > 0).withColumn("__v", array_to_vector(F.transform(own, lambda x: x / size)))
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=bucket, numHashTables=tables, seed=7).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense(q.tolist()), candidates)
    return top_k(near.drop("__v", "__h", "distCol"), query, k, vector, key)


def batch_top_k(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 5,
    vector: str = "embedding",
    key: str = "id",
    query_key: str = "query_id",
    on: Sequence[str] = ()
) -> DataFrame:
    """V02 for many questions at once: ``queries(query_key, query_vector, *on)`` meet the chunks that agree on ``on``, or all chunks. The best k of
    each are found by key and score alone; their other columns are joined to them. Chunks without a vector, or null in ``on``, are no hits."""
    if on:
        asked = blocks.packed(queries, on, query_key, "query_vector", blocks.QUESTIONS)
        best = blocks.best_pairs(blocks.packed(chunks, on, key, vector), asked, on, clamped(k), key, query_key)
    else:
        best = batch_scan(chunks, queries, k, vector, key, query_key)
    return best.join(queries.drop(*on), query_key).join(chunks, key)


def _by(part: str, key: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(F.col("similarity").desc_nulls_last(), key)


def neighbours(chunks: DataFrame, anchor, window: int = 1, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Chunks of the anchor's document within ``window`` places, with their similarity to it; none for a missing anchor."""
    a = chunks.where(F.col(key) == anchor).select(
        F.col("document_id").alias("__doc"), F.col("chunk_index").alias("__at"), F.col(vector).alias("__v")
    )
    near = F.col("document_id").eqNullSafe(F.col("__doc")) & F.col("chunk_index").between(
        F.col("__at") - window, F.col("__at") + window
    ) & (F.col(key) != anchor)
    return chunks.join(F.broadcast(a), near).withColumn(
        "similarity", vectors.cosine_similarity(F.col(vector), F.col("__v"))
    ).drop("__doc", "__at", "__v").orderBy("chunk_index", key)


SOURCE_FIELDS = (
    "company",
    "ticker",
    "fiscal_year",
    "form_type",
    "accounting_standard",
    "canonical_section",
    "source_file",
    "page_start",
    "page_end"
)


def as_sources(hits: DataFrame, key: str = "id") -> DataFrame:
    """Hits in the form that the gate and the prompt take."""
    return hits.select(
        F.col(key).alias("chunk_id"),
        *SOURCE_FIELDS,
        F.col("similarity").alias("relevance_score"),
        "content",
        snippet(F.col("content")).alias("text_snippet"),
        "company_name_mismatch"
    )


def retrieve(chunks: DataFrame, query: Sequence[float], model: str, k: int = 5, **filters) -> tuple[DataFrame, dict]:
    """The sources, and what was asked for; ``filters_applied`` is None without filters, and ``chunks_considered`` the number of hits."""
    sources = as_sources(top_k(filtered(chunks, **filters), query, k))
    found = sources.collect()  # MAX_K rows at most
    applied = {
        n: v for n, v in filters.items() if n in ("ticker", "company", "fiscal_year") and (
            v is not None if n == "fiscal_year" else v
        )
    }
    meta = {"filters_applied": applied or None, "model": model, "k": clamped(k), "chunks_considered": len(found)}
    return chunks.sparkSession.createDataFrame(found, sources.schema), meta


#: What the stand-in of a store finds: id, content (our own wording), score, title, source, year; ids, scores, titles, sources and years are fixed values.
MOCK_FOUND = (
    ("apple-annual-report-2025", "Stand-in text about one company's cash, margins and main business.", 0.92, "Apple Annual Report 2025", "annual_report", 2025),
    ("apple-investor-relations-summary", "Stand-in text about the same company's products and what it pays its owners.", 0.84, "Apple Investor Relations Summary", "investor_relations", None),
)
MOCK_ELSE = (
    (
        "general-financial-market-overview",
        "Stand-in text for questions that name nothing that is known.",
        0.5,
        "General Financial Market Overview",
        "fallback",
        None
    ),
)


def mock_retrieve(queries: DataFrame, k: int = 4, query_key: str = "query_id") -> DataFrame:
    """A retriever without a store, for tests: a question whose vector begins with 7 or more gets two rows, any other gets one."""
    schema = "id string, content string, score double, title string, source string, year int, rank int, named boolean"
    rows = [(*r, i + 1, named) for named, found in ((True, MOCK_FOUND), (False, MOCK_ELSE)) for i, r in enumerate(found) if i < k]
    table = queries.sparkSession.createDataFrame(rows, schema)
    asked = queries.select(query_key, F.coalesce(F.get("query_vector", F.lit(0)) >= 7, F.lit(False)).alias("__named"))
    return asked.join(F.broadcast(table), F.col("__named") == F.col("named")).drop("__named", "named")


def filter_diagnosis(chunks: DataFrame, condition: Column, query: Sequence[float], k: int = 5, key: str = "id") -> DataFrame:
    """Rows that match a filter, and how many of them a search returns that filters before or after its top k."""
    before = top_k(chunks.where(condition), query, k, key=key).agg(F.count("*").alias("prefilter_rows"))
    after = top_k(chunks, query, k, key=key).where(condition).agg(F.count("*").alias("postfilter_rows"))
    matching = chunks.where(condition).agg(F.count("*").alias("matching_rows"))
    return matching.join(before).join(after)
