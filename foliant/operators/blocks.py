"""Blocks of vectors: rows that agree in some columns are packed, blocks meet blocks, and each pair is one matrix product.

So no row is made for a pair of a vector and a question unless it is among the best of its block, and a group of any size is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from foliant.session import ship

#: Vectors of a block on either side; a product holds a number for each pair.
ROWS, QUESTIONS = 1024, 512


def matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(n, -1)


def packed(rows: DataFrame, by: Sequence[str], key: str, vector: str, size: int = ROWS) -> DataFrame:
    """Blocks (``by``, ``keys``, ``vectors``) of at most ``size`` rows that agree in ``by``. Rows are dealt by ranges of ``by`` and a hash of the key, so that a
    hot value is many tasks; those without a vector, or null in ``by``, are in no block."""
    ship(rows.sparkSession)
    whole = rows.where(F.col(vector).isNotNull()).dropna(subset=list(by)).select(*by, F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    dealt = whole.repartitionByRange(*by, F.xxhash64("__key")).sortWithinPartitions(*by, "__key")
    m = len(by)
    schema = StructType([rows.schema[c] for c in by]).add("keys", ArrayType(rows.schema[key].dataType)).add("vectors", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column(m).combine_chunks()
            ends = pa.array([0, len(keys)], pa.int32())
            lists = pa.ListArray.from_arrays(ends, keys)
            raw = np.asarray(t.column(m + 1).combine_chunks().flatten(), "<f8").tobytes()
            own = [t.column(i).combine_chunks().slice(0, 1) for i in range(m)]
            return pa.RecordBatch.from_arrays([*own, lists, pa.array([raw], pa.binary())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(m)), strict=True))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and marks[a] != last:
                    yield block()
                    held = []
                last = marks[a]
                while a < b:
                    step = min(b - a, size - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, step))
                    a += step
                    if sum(x.num_rows for x in held) == size:
                        yield block()
                        held = []
        if held:
            yield block()

    return dealt.mapInArrow(run, schema)


def best_pairs(
    rows: DataFrame, questions: DataFrame, by: Sequence[str], k: int, key: str = "id", query_key: str = "query_id"
) -> DataFrame:
    """(query_key, key, similarity, rank): of blocks of rows and of questions (``packed``) that agree in ``by``, each question's best ``k`` by cosine, ties by
    key. A vector of length zero is like nothing: its similarity is null, and it comes last."""
    ship(rows.sparkSession)
    keys, asked = rows.schema["keys"].dataType.elementType, questions.schema["keys"].dataType.elementType
    schema = StructType().add(query_key, asked).add(key, keys).add("similarity", "double")
    theirs = questions.select(*by, F.col("keys").alias("__asked"), F.col("vectors").alias("__questions"))
    met = rows.select(*by, "keys", "vectors").join(theirs, list(by)).select("keys", "vectors", "__asked", "__questions")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, wanted = batch.column(0)[i].values, batch.column(2)[i].values
                v, q = matrix(batch.column(1)[i].as_py(), len(own)), matrix(batch.column(3)[i].as_py(), len(wanted))
                sizes = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                sim = np.divide(v @ q.T, sizes, out=np.full(sizes.shape, -2.0), where=sizes > 0)
                order = np.argsort(np.asarray(own.to_pandas()), kind="stable")  # ties go by key
                best = order[np.argsort(-sim[order], axis=0, kind="stable")[:k]]
                row, column = best.T.ravel(), np.repeat(np.arange(len(q)), best.shape[0])
                found = sim[row, column]
                scores = pa.array(found, pa.float64(), mask=found < -1.5)
                yield pa.RecordBatch.from_arrays([wanted.take(pa.array(column)), own.take(pa.array(row)), scores], names=schema.names)

    every = met.mapInArrow(run, schema)
    best = Window.partitionBy(query_key).orderBy(F.col("similarity").desc_nulls_last(), key)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
