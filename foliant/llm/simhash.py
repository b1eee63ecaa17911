"""Near duplicates by 64-bit SimHash: fingerprints within a few bits are linked, by balls of half the radius that meet.

Two fingerprints at most ``2 r`` bits apart have a value within ``r`` bits of both, and two that share such a value are at most ``2 r``
apart. So each distinct fingerprint sends out its ball of radius ``r`` (2,081 values for two bits), values are brought together by hash, and
fingerprints that share one are linked to the least of them, which links no two that aren't linked anyway and needs no list of pairs.

A ball is two thousand times its fingerprint, so it travels as sorted hashes cut to the bits that tell the values apart, a block of bytes for each part of the
hash range. What agrees there is sent back to the block's fingerprints, which send those values once more, whole and by themselves.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import passing, written
from foliant.llm.components import connected_components
from foliant.llm.shingles import by_group
from foliant.session import released, ship, spread

SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)
#: Fingerprints in a block, values of a part of the hash range that one group holds on average, and hash bits beyond those that number the values.
BLOCK, PART, SPARE = 4096, 1 << 22, 6
_STEP = 1 << 16


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many values have each of the 64 bits. Eight bits at a time are summed in the bytes of a word, 255 values before a byte could overflow."""
    rows = np.concatenate([h, np.zeros(-len(h) % 255, np.uint64)]).reshape(-1, 255)
    sums = np.empty((8, 8), np.int64)
    for b in range(8):
        bytes_of = ((rows >> np.uint64(b)) & _LANES).sum(axis=1, dtype=np.uint64).astype("<u8").view(np.uint8)
        sums[:, b] = bytes_of.reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sums.reshape(64)


def fingerprint(text: str | None, k: int = 4) -> int:
    """SimHash of a text's runs of ``k`` words; zero without words."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(k, len(words))
    n = len(words) - k + 1
    starts, stops = np.concatenate([[0], ends[: n - 1] + 1]), ends[k - 1 :]
    sums = np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        pairs = zip(starts[i : i + _STEP].tolist(), stops[i : i + _STEP].tolist(), strict=True)
        sums += _bit_sums(np.fromiter((hashed(line[a:b], SEED) for a, b in pairs), np.uint64, min(_STEP, n - i)))
    return int(sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long, of every row."""
    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    return rows.mapInArrow(released(run), rows.select("key").schema.add("fp", "long"))


def ball(radius: int) -> np.ndarray:
    """Masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)], np.uint64)


def spread_bits(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values, so that parts of the range are alike full."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """Sorted values as gaps of as few bytes as the largest takes; the first byte tells how many."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    gaps = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _balls(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Mixed values of the balls around fingerprints, a row each."""
    return spread_bits(fps[:, None] ^ masks[None, :])


def shared_values(prints: DataFrame, n: int, radius: int, at: list[str], block: int = BLOCK, part: int = PART) -> DataFrame:
    """``value`` and ``fp`` for what lies in the balls of two or more of the ``n`` distinct fingerprints ``prints(fp)``; a few values that only one has may be
    among them. Written; the path is added to ``at``.

    A value has at most as many fingerprints as a ball has values, so no part of the range is hot.
    """
    masks = ball(radius)
    n_parts = max(1, n * len(masks) // part)
    part_bits = max(0, (n_parts - 1).bit_length())
    # Bits that a hash keeps: enough that two of all values agree by chance in 2 ** -SPARE of the cases, and that gaps are short.
    kept_bits = min(64 - part_bits, max(8, (n * len(masks)).bit_length() + SPARE - part_bits))
    drop, low = np.uint64(64 - part_bits - kept_bits), np.uint64((1 << kept_bits) - 1)
    blocks = max(1, -(-n // block))
    # A block is long work for few bytes, so tasks are told by number: else they would be joined until they hold bytes enough.
    tasks = max(1, min(blocks, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # Blocks by a hash of the fingerprint, so a run that is repeated makes the same ones.
    dealt = written(
        prints.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(blocks))).repartition(tasks, "block").sortWithinPartitions("block", "fp"),
        "blocks",
        at
    )
    grouped = dealt.repartition(tasks, "block").sortWithinPartitions("block", "fp")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "block"):
            number = group.column("block")[0].as_py()
            fps = group.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), block):
                short = np.sort((_balls(fps[i : i + block], masks) >> drop).ravel())
                cuts = np.searchsorted(short, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(kept_bits))
                cuts[-1] = len(short)
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                for j in range(0, len(full), 256):
                    some = full[j : j + 256].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some, pa.int64()),
                            pa.array([number] * len(some), pa.int64()),
                            pa.array([packed(short[cuts[p] : cuts[p + 1]] & low) for p in some], pa.binary()),
                        ],
                        names=["part", "block", "held"]
                    )

    sent = grouped.mapInArrow(released(emit), "part long, block long, held binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "part"):
            here = np.uint64(group.column("part")[0].as_py()) << np.uint64(kept_bits)
            held = [unpacked(x.as_py()) for x in group.column("held")]
            every = np.sort(np.concatenate(held))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            if not len(twice):
                continue
            numbers, back = group.column("block").to_pylist(), []
            for own in held:
                places = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                back.append(np.unique(own[twice[places] == own]) | here)
            some = [i for i, x in enumerate(back) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([numbers[i] for i in some], pa.int64()),
                    pa.array([0] * len(some), pa.int64()),
                    pa.array([back[i].astype("<u8").tobytes() for i in some], pa.binary()),
                ],
                names=["block", "fp", "wanted"]
            )

    wanted = sent.repartition("part").sortWithinPartitions("part").mapInArrow(released(meet), "block long, fp long, wanted binary")
    wanted = written(wanted, "wanted", at)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_group(batches, "block"):
            asked = [np.frombuffer(x, "<u8") for x in group.column("wanted").to_pylist() if x is not None]
            if not asked:
                continue
            asked = np.unique(np.concatenate(asked))
            fps = group.column("fp").to_numpy()[np.array(group.column("wanted").is_null())].view(np.uint64)
            for i in range(0, len(fps), 256):
                short = _balls(fps[i : i + 256], masks) >> drop
                places = np.minimum(np.searchsorted(asked, short), len(asked) - 1)
                row, column = np.nonzero(asked[places] == short)
                if len(row):
                    own = fps[i : i + 256][row]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((own ^ masks[column]).view(np.int64)), pa.array(own.view(np.int64))], names=["value", "fp"]
                    )

    both = dealt.select("block", "fp", F.lit(None).cast("binary").alias("wanted")).unionByName(wanted)
    found = both.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(released(answer), "value long, fp long")
    return written(found, "shared", at)


def without_lowest(bits: Column, n: int) -> Column:
    """A long without its ``n`` lowest ones; the least long less one would be too small, and stands for the greatest."""
    for _ in range(n):
        bits = bits.bitwiseAND(F.coalesce(F.try_subtract(bits, F.lit(1)), F.lit((1 << 63) - 1)))
    return bits


def links(prints: DataFrame, n: int, radius: int, at: list[str], block: int = BLOCK, part: int = PART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints at most ``2 * radius`` bits apart, each once: of those that share a value, the others with the least, if the value
    is the one where this pair is judged, that is if the least differs from it in the pair's lowest bits.

    Two that are near are still linked by some path: where the pair (x, y), x < y, is judged, either x is the least, or there is a lesser z that is
    near to both, and the pairs (z, x) and (z, y) come before (x, y) in the order of the greater and then the lesser member.
    """
    shared = shared_values(prints, n, radius, at, block, part)
    least = shared.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("held")).where("held > 1").drop("held")
    apart = F.col("a").bitwiseXOR(F.col("fp"))
    judged = (F.col("fp") != F.col("a")) & (F.bit_count(apart) <= 2 * radius) & (
        F.col("value") == F.col("fp").bitwiseXOR(without_lowest(apart, radius))
    )
    return shared.join(least, "value").where(judged).select("a", F.col("fp").alias("b"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, radius: int = 2, block: int = BLOCK, part: int = PART
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row: the least key that can be reached over fingerprints at most
    ``2 * radius`` bits apart.

    A missing or empty text has fingerprint zero and is linked like any other. Rows that repeat a key keep a row each. A missing key names no
    component: where no row of a component has a key, its id is missing too. Copies share a fingerprint, so a group of any size is one
    fingerprint here. No rows: an empty result. Other columns of ``docs`` are not read.
    """
    spark = ship(docs.sparkSession)
    rows = written(fingerprints(docs, key, text, k), "fingerprints")
    with passing(spark) as at:
        prints = written(rows.groupBy("fp").agg(F.min("key").alias("least")), "prints", at)
        n = prints.count()
        edges = written(links(prints.select("fp"), n, radius, at, block, part), "links", at)
        parts = connected_components(edges, at=at, about=edges.count())
        named = prints.join(parts, prints["fp"] == parts["node"], "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        )
        named = written(named, "named", at)
        tops = named.groupBy("component").agg(F.min("least").alias("component_id"))
        # Written, so that a fingerprint of many rows is split where the rows are joined.
        names = written(named.join(tops.hint("rebalance"), "component").select("fp", "component_id"), "components", size=16 * n)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(names, "fp").select(F.col("key").alias(key), shown, "component_id")
