"""An inverted-file index of vectors, kept in a folder: cells around centroids, a folder a cell, and searches that read the cells they need.

Centroids are fitted on a bounded sample; every row is assigned. A search by probes reads the cells nearest to a question; how many is
measured on the sample when the index is built. An exact search reads the nearest cell first, and then those that can still hold something better: on the
sphere a row of a cell is no nearer to the question than the angle to the centroid less the cell's widest angle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators.blocks import QUESTIONS, ROWS, best_pairs, packed
from foliant.session import fresh_path, ship

#: Rows that centroids are fitted on at most, cells at most, and sample rows that measure the probes.
MAX_SAMPLE, MAX_CELLS, MEASURED = 20_000, 4096, 500
#: Rows without direction (no vector, or one of length zero): they are kept and never found.
NOWHERE = -1


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _centroids(sample: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means on unit vectors; a centroid that nothing is near to goes to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    found = sample[np.sort(rng.choice(len(sample), n, replace=False))].copy()
    for _ in range(rounds):
        sims = sample @ found.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(sims.max(axis=1), kind="stable")[: len(empty)]]
        found = _unit(sums)
    return found


def _probes(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """Cells to read so that a share of ``recall`` of the sample's nearest ``k`` is found. Neighbours in all rows are nearer than those in a sample, so this
    is rather too many than too few."""
    some = sample[:: max(1, len(sample) // MEASURED)]
    sims = some @ sample.T
    near = np.argsort(-sims, axis=1)[:, : k + 1]
    cells = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(some @ centroids.T), axis=1)
    place = np.argsort(order, axis=1)  # of each cell, in the order of each question
    return int(np.quantile(np.take_along_axis(place, cells[near], axis=1), recall, method="higher")) + 1


@dataclass(frozen=True)
class VectorIndex:
    """What is known of an index without reading its rows."""

    path: str
    key: str
    centroids: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def build_index(
    rows: DataFrame, path: str, key: str = "id", vector: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 10,
    max_sample: int = MAX_SAMPLE, seed: int = 7
) -> VectorIndex:
    """Fits centroids on at most ``max_sample`` rows, chosen by a hash of the key, and lays out all rows of ``rows`` by cell in ``path``. ``cells`` is about the square
    root of the number of rows where none is given; the default number of probes is measured for ``recall`` of the best ``k``."""
    spark = ship(rows.sparkSession)
    whole = rows.where(F.col(vector).isNotNull()).select(key, vector)
    n = whole.count()
    share = min(1.0, max_sample / max(n, 1))
    picked = whole.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64(key)).limit(max_sample)
    sample = np.array([r[0] for r in picked.select(vector).collect()], float)
    sample = _unit(sample)[np.abs(sample).sum(axis=1) > 0] if len(sample) else sample
    n_cells = min(cells or max(1, round(n**0.5)), MAX_CELLS, max(1, len(sample)))
    centroids = _centroids(sample, n_cells, seed) if len(sample) else np.zeros((0, 0))
    probes = _probes(sample, centroids, recall, k) if len(sample) else 1
    spark.createDataFrame(
        [(i, c.tolist(), probes) for i, c in enumerate(centroids)], "cell int, centroid array<double>, probes int"
    ).coalesce(1).write.parquet(f"{path}/centroids")
    rows.select(key).limit(0).write.parquet(f"{path}/keys")  # tells the key's name and type, whatever else is there
    index = VectorIndex(path, key, centroids, probes)
    add_rows(index, rows, vector)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    key = spark.read.parquet(f"{path}/keys").columns[0]
    return VectorIndex(path, key, np.array([r.centroid for r in found]), found[0].probes if found else 1)


def add_rows(index: VectorIndex, rows: DataFrame, vector: str = "embedding") -> None:
    """Appends rows to the cells of an index. A cell's folder gets a file or more for each load; nothing that is there is rewritten."""
    ship(rows.sparkSession)
    centroids = index.centroids
    own = rows.select(index.key, vector)
    schema = StructType(list(own.schema.fields)).add("cell", "integer").add("angle", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, angles = np.full(batch.num_rows, NOWHERE, np.int32), np.zeros(batch.num_rows)
            known = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
            if len(known) and len(centroids):
                m = np.asarray(batch.column(1).flatten(), float).reshape(len(known), -1)
                sims = _unit(m) @ centroids.T
                some = np.abs(m).sum(axis=1) > 0
                cells[known] = np.where(some, sims.argmax(axis=1), NOWHERE)
                angles[known] = np.arccos(np.clip(sims.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(angles)], names=schema.names)

    # Assigned rows are written: they are read for the angles and for the blocks.
    stage = fresh_path(rows.sparkSession, "assigned")
    own.mapInArrow(run, schema).write.parquet(stage)
    placed = rows.sparkSession.read.schema(schema).parquet(stage)
    packed(placed, ["cell"], index.key, vector, ROWS).write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")
    placed.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).coalesce(1).write.mode("append").parquet(f"{index.path}/cells")


def _routed(index: VectorIndex, questions: DataFrame, query_key: str, probes: int, angles: np.ndarray | None) -> DataFrame:
    """(query_key, query_vector, cell): the cells that each question has to meet. With ``angles`` (the widest of each cell, negative for none) these are the cells
    that can hold a row of ``floor`` similarity or more; else the ``probes`` nearest."""
    centroids = index.centroids
    columns = [query_key, "query_vector"] + (["floor"] if angles is not None else [])
    own = questions.where("query_vector IS NOT NULL").select(query_key, F.col("query_vector").cast("array<double>").alias("query_vector"), *columns[2:])
    schema = StructType(own.schema.fields[:2]).add("cell", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                q = _unit(np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1))
                sims = q @ centroids.T
                if angles is None:
                    wanted = np.zeros(sims.shape, bool)
                    np.put_along_axis(wanted, np.argsort(-sims, axis=1, kind="stable")[:, :probes], True, axis=1)
                else:
                    floor = np.asarray(part.column(2).to_pandas(), float)
                    best = np.cos(np.maximum(0, np.arccos(np.clip(sims, -1, 1)) - angles[None, :]))
                    wanted = (best + 1e-9 >= floor[:, None]) & (angles >= 0)[None, :]
                row, cell = np.nonzero(wanted)
                taken = part.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32))], names=schema.names)

    return own.mapInArrow(run, schema)


def _met(index: VectorIndex, questions: DataFrame, k: int, query_key: str, probes: int, angles: np.ndarray | None = None) -> DataFrame:
    """The best of the cells that questions are routed to; cells that no question needs are not read."""
    spark = questions.sparkSession
    if not len(index.centroids):
        kinds = StructType([questions.schema[query_key], spark.read.parquet(f"{index.path}/keys").schema[0]])
        return spark.createDataFrame([], kinds.add("similarity", "double").add("rank", "integer"))
    routed, stage = _routed(index, questions, query_key, probes, angles), fresh_path(spark, "routed")
    packed(routed, ["cell"], query_key, "query_vector", QUESTIONS).write.parquet(stage)
    asked = spark.read.parquet(stage)
    needed = [r.cell for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
    rows = index.rows(spark).where(F.col("cell").isin(needed))
    return best_pairs(rows, asked, ["cell"], k, index.key, query_key)


def search_index(index: VectorIndex, questions: DataFrame, k: int = 10, probes: int | None = None, query_key: str = "query_id") -> DataFrame:
    """(query_key, key, similarity, rank) of each question's best ``k`` rows in its ``probes`` nearest cells, for any number of
    ``questions(query_key, query_vector)``. Similarities are exact; rows in other cells are missed. A question without a vector, or an index without
    rows, finds nothing."""
    ship(questions.sparkSession)
    return _met(index, questions, k, query_key, probes or index.probes)


def search_exact(index: VectorIndex, questions: DataFrame, k: int = 10, query_key: str = "query_id") -> DataFrame:
    """What a full scan finds among rows with a direction, from the cells that can hold it: the nearest cell gives a similarity that ``k`` rows reach, and the
    cells whose bound is below it are not read. Where rows are spread evenly in many dimensions, bounds exclude little and most cells are read."""
    spark = ship(questions.sparkSession)
    first = fresh_path(spark, "nearest")
    search_index(index, questions, k, 1, query_key).where(F.col("rank") == k).select(query_key, F.col("similarity").alias("floor")).write.parquet(first)
    floors = spark.read.parquet(first)
    asked = questions.join(floors, query_key, "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    angles = np.full(len(index.centroids), -1.0)
    for r in spark.read.parquet(f"{index.path}/cells").where(F.col("cell") != NOWHERE).groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        angles[r.cell] = r.angle
    return _met(index, asked, k, query_key, 0, angles)
