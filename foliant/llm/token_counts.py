"""Token counts by a digest cache.

A text's count is stored under the digest of its normalised content and the digest of the tokenizer's
version. ``count_tokens`` digests every row in the JVM, joins the digests to the stored counts, encodes
one text for each distinct digest that has none, appends those counts to the cache, and joins all rows to
it. Normalisation must not change a count; white space and case do under this tokenizer, so it only turns
a missing text into the empty one.

While the missing digests are few, as with a warm cache, they are sent to all executors and their texts are encoded where they are read:
no text is shuffled. Where they are too many for that, as with an empty cache, texts cross the network once, to be dealt
evenly. Digests are a small written table. A digest shared by a third of the rows is one row on the cache's side; its many rows on
the other side are split by adaptive execution. Of rows that repeat id and text one is encoded.

A null text counts as empty, with 0 tokens. Repeated rows each get a row. A null document id is kept. An
empty table leaves the cache as it is and returns no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_BYTES, fits, passing, text_of, written
from foliant.llm.pieces import in_parts
from foliant.session import fresh_path, released, ship, spread

CACHE = "tokenizer string, digest binary, n_tokens long"
_LOADED: dict[str, sentencepiece.SentencePieceProcessor] = {}


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file, read on the driver."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encoder(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _LOADED:
        _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def _counts(texts: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _encoder(path)
        for batch in batches:
            digests, found = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_parts(found, 1_000_000):
                counts = [len(x) for x in sp.encode(found[a:b], num_threads=1)]
                yield pa.RecordBatch.from_arrays([digests.slice(a, b - a), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.mapInArrow(released(run), "digest binary, n_tokens long")


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty table is made where there is none."""
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(
    docs: DataFrame, model: str, cache: str, key: str = "doc_id", text: str = "text", max_broadcast: int = BROADCAST_BYTES
) -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row; ``cache`` is the folder of stored counts. Up to ``max_broadcast`` bytes of
    missing digests and their keys are sent to all executors."""
    spark, version = ship(docs.sparkSession), tokenizer_version(model)
    content = text_of(text)
    digest = F.unhex(F.sha2(content, 256))
    rows = written(docs.select(F.col(key), digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")), "digests")
    with passing(spark) as at:
        stored = open_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
        # One row for each missing digest: the least key that has it (null keys stand last), and how many rows have both.
        same = rows.groupBy("digest", key).agg(F.count("*").alias("n"))
        least = same.groupBy("digest").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "n")).alias("least"))
        missing = written(
            least.join(stored, "digest", "left_anti").select(
                "digest", F.col("least.key").alias("__key"), (F.col("least.n") > 1).alias("__more")
            ),
            "missing",
            at
        )
        texts = spread(docs.select(F.col(key).alias("__key"), content.alias("__text"), digest.alias("digest")))
        # Where they aren't sent, the missing digests are the built side, so texts aren't sorted.
        sent = F.broadcast(missing) if fits(missing, max_broadcast) else missing.hint("shuffle_hash")
        wanted = texts.join(
            sent, texts["__key"].eqNullSafe(missing["__key"]) & (texts["digest"] == missing["digest"])
        ).select(texts["digest"], "__text", "__more")
        if missing.where("__more").isEmpty():
            dealt = wanted.select("digest", "__text")
        else:
            found = written(wanted, "wanted", at)
            once = found.where("__more").groupBy("digest").agg(F.first("__text").alias("__text"))
            dealt = found.where("NOT __more").select("digest", "__text").unionByName(once)
        new = _counts(dealt, model)
        new.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # A cache that two runs append to may hold a digest twice, with the same count.
    # They are written, so that a digest of many rows is split where the rows are joined.
    counts = written(
        spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(
            F.max("n_tokens").alias("n_tokens")
        ),
        "counts"
    )
    return rows.join(counts, "digest").select(key, "n_bytes", "n_tokens")


def run_cache(spark: SparkSession) -> str:
    """A cache that starts empty, for a run that shares its counts with no other."""
    return fresh_path(spark, "token-counts")
