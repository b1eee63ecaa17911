"""N-gram Jaccard join by chosen paths.

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. Each distinct
text's set is sketched by ``SKETCH`` minima, its tokens. In each run a text chooses each token with a chance of
1 / (0.8 * SKETCH), by a hash that is the same for all texts; texts that chose one token share a bucket. Buckets
of more than ``small`` texts are split again by tokens chosen under the path so far, down to ``depth``; the others are
compared text by text on their sketches. ``runs_for`` repeats runs until a pair at the threshold is missed in all of
them with a chance of at most 1 - ``recall``, even if all its buckets are split to full depth; more similar pairs, and those in
buckets that were small at once, are missed far less often.

Texts whose sketches agree well enough (four standard errors below the threshold) are joined to clusters, and in each cluster
all pairs of shingle sets that can be linked by their sizes are compared exactly. So a link is never false, is counted once
however many paths found it, and is found too where only a chain of paths leads to it.

No pairs are written: a bucket or cluster gives each text its number of links and its least neighbour, and classes are
connected components of those. A bucket or cluster of any size is cut into blocks, and each two blocks are a task's
group, so a group with a third of all rows is spread over the cluster and nothing is capped. A large cluster is cut by
size first: texts of which one has under 0.8 of the other's shingles never meet. Exact copies of a text
are one text with a weight. Hot tokens are counted before they are joined.

Words are runs of letters and digits and all beyond ASCII, with A-Z in lower case. A text of fewer than five words has one shingle, of all
of them. Null and empty texts, and texts without words, have no links, a class each. A null id is kept; a class is named by the
least id in it (null only if all are). Repeated rows link to each other like other copies. An empty table gives an empty result; extra
columns aren't read by ``classes``, and are kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_BYTES, digest_of, fits, passing, text_of, written
from foliant.llm.components import connected_components
from foliant.llm.shingles import by_group, least_linked, mixed, shingle_hashes, sketch
from foliant.session import released, ship, spread

SHINGLE, THRESHOLD, SKETCH = 5, 0.8, 64
#: Texts in a block of a bucket, texts of a cluster that is one block, and shingles in a block of a cluster.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 1024, 512, 400_000


def missed(depth: int, runs: int, threshold: float = THRESHOLD, t: int = SKETCH) -> float:
    """The chance to miss a pair at the threshold in all runs if each of its buckets is split down to ``depth``.

    The pair's sketches agree in a binomial number of tokens, the same for all runs; each of those is chosen with a chance of
    1 / (threshold * t), and a pair that agrees in fewer than the screen asks for is missed for good.
    """
    need, out = math.ceil(screen(threshold, t) * t), 0.0
    for x in range(t + 1):
        share = math.comb(t, x) * threshold**x * (1 - threshold) ** (t - x)
        p = 1.0
        for _ in range(depth):
            p = 1 - (1 - p / (threshold * t)) ** x
        out += share * ((1 - p) ** runs if x >= need else 1.0)
    return out


def screen(threshold: float, t: int) -> float:
    """The share of sketch tokens in which a pair must agree: four standard errors below the threshold."""
    return threshold - 4 * math.sqrt(threshold * (1 - threshold) / t)


def runs_for(recall: float, depth: int, threshold: float = THRESHOLD, t: int = SKETCH, most: int = 1000) -> int:
    """The fewest runs after which a pair at the threshold is found with a chance of ``recall``."""
    for runs in range(1, most + 1):
        if missed(depth, runs, threshold, t) <= 1 - recall:
            return runs
    raise ValueError(f"no {most} runs reach a recall of {recall} with sketches of {t}")


def _chosen(sketches: np.ndarray, paths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and new paths: the tokens of each row of ``sketches`` that are chosen under its path."""
    t = sketches.shape[1]
    places = mixed(np.arange(1, t + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    h = mixed(mixed(sketches.astype(np.uint64) ^ places[None, :]) + paths[:, None])
    row, token = np.nonzero(h < np.uint64(int(2**64 / (threshold * t))))
    return row, mixed(h[row, token] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def _matrix(column: pa.ChunkedArray | pa.Array, t: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, t)


def _sketched(docs: DataFrame, key: str, text: str, t: int, k: int) -> DataFrame:
    """A row a row: ``key``, the text's digest, its sketch (empty without words), and the number ``n`` of its distinct shingles."""
    rows = spread(docs.select(F.col(key).alias("key"), digest_of(F.col(text)).alias("digest"), text_of(text).alias("text")))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for value in batch.column(2):
                hashes = np.unique(shingle_hashes(value.as_py(), k))
                out.append(sketch(hashes, t).astype("<u4").tobytes() if len(hashes) else b"")
                sizes.append(len(hashes))
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "sketch", "n"])

    return rows.mapInArrow(released(run), f"key {kind}, digest binary, sketch binary, n long")


def _paths(rows: DataFrame, t: int, threshold: float, runs: int) -> DataFrame:
    """(path, id) of ``rows(id, sketch)`` for all runs, or one step on for ``rows(id, sketch, path)``."""
    on = "path" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                ids, sketches = part.column("id").to_numpy(), _matrix(part.column("sketch"), t)
                for r in range(1 if on else runs):
                    before = part.column("path").to_numpy().view(np.uint64) if on else np.full(
                        len(ids), mixed(np.array([r + 1], np.uint64))[0]
                    )
                    row, new = _chosen(sketches, before, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(ids[row])], names=["path", "id"])

    return rows.mapInArrow(released(run), "path long, id long")


def _paired(rows: DataFrame, group: Column) -> DataFrame:
    """A row of ``rows(block, others)`` for each two blocks that it goes to: ``g`` names the two, ``cross`` says whether they differ.
    Two rows of a group meet in exactly one ``g``."""
    spread = rows.withColumn("other", F.explode("others"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return spread.withColumn("g", F.xxhash64(group, low, high)).withColumn(
        "cross", F.col("block") != F.col("other")
    ).drop("others", "other")


def _place(blocks: Column) -> Column:
    """A text's place among so many blocks."""
    return F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("long")


def _bucket_blocks(leaves: DataFrame) -> DataFrame:
    """Texts of buckets in blocks of about ``BUCKET_BLOCK``."""
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("long")
    rows = leaves.withColumn("block", _place(blocks)).withColumn("others", F.sequence(F.lit(0).cast("long"), blocks - 1))
    return _paired(rows, F.col("path")).drop("size")


def _layout(members: DataFrame, threshold: float) -> DataFrame:
    """For each cluster of ``members(cluster, n)`` that is more than one block: the number of blocks of each of its bands.

    Bands of size are each 1 / threshold as wide as the one before, so texts of a link are in one band or in two that follow each other.
    A cluster has some hundred bands at most, as sizes double in four. A row goes to as many groups as there are blocks that it meets, so
    blocks grow with their cluster, from an eighth of ``CLUSTER_BLOCK`` to twice that: a small one has groups for many tasks, a large one few copies.
    """
    sizes = members.groupBy("cluster", _band(threshold).alias("band")).agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    whole = sizes.groupBy(F.col("cluster").alias("__cluster")).agg(
        F.sum("texts").alias("texts"),
        F.sum("shingles").alias("shingles"),
        F.collect_list(F.struct("band", "texts", "shingles")).alias("bands")
    )
    block = F.least(F.lit(2 * CLUSTER_BLOCK), F.greatest(F.lit(max(1, CLUSTER_BLOCK // 8)), F.ceil(F.col("texts") / 32)))
    parts = F.transform(
        "bands",
        lambda b: F.struct(b["band"], F.greatest(F.ceil(b["texts"] / block), F.ceil(b["shingles"] / CLUSTER_SHINGLES)).cast("long"))
    )
    return whole.where(
        (F.col("texts") > CLUSTER_BLOCK) | (F.col("shingles") > CLUSTER_SHINGLES)
    ).select("__cluster", F.map_from_entries(parts).alias("bands"))


def _band(threshold: float) -> Column:
    return F.floor(F.log("n") / (math.log(1 / threshold) * (1 + 1e-6))).cast("int")


def _cluster_blocks(sets: DataFrame, layout: DataFrame, threshold: float) -> DataFrame:
    """Texts of clusters in blocks of their layout, with ``CLUSTER_SHINGLES`` shingles at most or so; blocks of bands that are not next
    to each other don't meet. A cluster without ``layout`` is one block."""

    def blocks(band: Column) -> Column:
        return F.coalesce(F.try_element_at("bands", band), F.lit(0).cast("long"))

    joined = sets.join(layout, F.col("cluster") == F.col("__cluster"), "left").withColumn("band", _band(threshold).cast("long"))
    own, zero, single = F.col("band"), F.lit(0).cast("long"), F.col("bands").isNull()
    block = F.when(single, zero).otherwise(own * 1_000_000_000 + _place(F.greatest(blocks(own.cast("int")), F.lit(1))))
    others = F.concat(*(_named(own + i, blocks) for i in (-1, 0, 1)))
    placed = joined.withColumn("block", block).withColumn("others", F.when(single, F.array(zero)).otherwise(others))
    return _paired(placed, F.col("cluster")).select("g", "id", "set", "copies", "block", "cross")


def _named(band: Column, blocks: Callable[[Column], Column]) -> Column:
    """The names of a band's blocks."""
    n = blocks(band.cast("int"))
    names = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), lambda i: band * 1_000_000_000 + i)
    return F.when(n > 0, names).otherwise(F.array().cast("array<bigint>"))


def _cross(blocks: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Only links between the two blocks, if there are two: those within are another group's."""
    if len(np.unique(blocks)) > 1:
        linked &= blocks[:, None] != blocks[None, :]
    return linked


def _bucket_edges(leaves: DataFrame, t: int, least: float) -> DataFrame:
    """(a, b): each text of a bucket and the least one that its sketch leads to."""
    need = math.ceil(least * t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for group in by_group(batches, "g"):
            ids, s = group["id"].to_numpy(), _matrix(group["sketch"], t)
            blocks, cross = group["block"].to_numpy(), bool(group["cross"][0].as_py())
            if cross and (blocks == blocks[0]).all():
                continue
            if len(ids) <= 32:
                same = (s[:, None, :] == s[None, :, :]).sum(axis=2)
            else:
                same = np.zeros((len(ids), len(ids)), np.uint8)
                for i in range(t):
                    same += s[:, None, i] == s[None, :, i]
            tops = least_linked(_cross(blocks, same >= need) if cross else same >= need, ids)
            moved = tops != ids
            a.append(ids[moved])
            b.append(tops[moved])
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = leaves.select("g", "id", "sketch", "block", "cross").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(released(run), "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(fresh) - 1
    often = np.bincount(number) > 1  # what one set alone has can't be shared
    keep = often[number]
    column = np.cumsum(often)[number[keep]] - 1
    owner, width = owner[keep], int(often.sum())
    out = np.zeros((m, m), np.float32)
    for a in range(0, width, 4096):
        inside = (column >= a) & (column < a + 4096) if width > 4096 else slice(None)
        has = np.zeros((m, min(4096, width - a)), np.float32)
        has[owner[inside], column[inside] - a] = 1
        out += has @ has.T
    return out


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links, top): per text and group of blocks the copies it is linked to and the least text that its links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["id", "links", "top"])

        for group in by_group(batches, "g", once="id"):  # a repeated row gives its set again, once a task
            ids = group["id"].to_numpy()
            ids, once = np.unique(ids, return_index=True)
            raw = group["set"].to_pylist()
            sets = [np.frombuffer(raw[i], "<u8") for i in once]
            weight, blocks, cross = group["copies"].to_numpy()[once], group["block"].to_numpy()[once], bool(group["cross"][0].as_py())
            if len(ids) < 2 or cross and (blocks == blocks[0]).all():
                continue
            size = np.array([len(s) for s in sets], float)
            both = _shared(sets)
            linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
            np.fill_diagonal(linked, False)
            if cross:
                linked = _cross(blocks, linked)
            links = linked @ weight
            some = links > 0
            held.append((ids[some], links[some].astype(np.int64), least_linked(linked, ids)[some]))
            if len(held) >= 1000:
                yield batch_of()
                held = []
        if held:
            yield batch_of()

    dealt = members.select("g", "id", "set", "copies", "block", "cross").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(released(run), "id long, links long, top long")


def _sets(rows: DataFrame, k: int) -> DataFrame:
    """``rows(..., id, copies, text)`` with the sorted hashes of its shingles in place of the text. Of rows that repeat id and text a task
    takes one."""
    fields = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, n in zip(batch.column("id").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                fresh.append(n == 1 or i not in seen)
                if n > 1:
                    seen.add(i)
            part = batch.filter(pa.array(fresh, pa.bool_()))
            found = pa.array([np.unique(shingle_hashes(v.as_py(), k)).astype("<u8").tobytes() for v in part.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), found], names=[*(f.name for f in fields), "set"])

    return rows.mapInArrow(released(run), rows.schema.__class__(list(fields)).add("set", "binary"))


def classes(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per row: ``key``, ``class_id`` (least key in its class) and ``n_links`` (other rows it is linked to); ``options`` are those of ``_classed``."""
    return _classed(docs, key=key, **options).select(key, "class_id", "n_links")


def _classed(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    k: int = SHINGLE,
    recall: float = 0.999,
    depth: int = 3,
    small: int = 512,
    t: int = SKETCH,
    key: str = "doc_id",
    text: str = "text",
    max_broadcast: int = BROADCAST_BYTES
) -> DataFrame:
    """``classes`` with the text's ``digest`` and ``top``, the digest of the text that stands for the class under its least key (null for a
    text without words). Tables of up to ``max_broadcast`` bytes are sent to all executors."""
    spark = ship(docs.sparkSession)
    n_rows = docs.count()
    with passing(spark) as at:
        grouped = _sketched(docs, key, text, t, k).groupBy("digest").agg(
            F.min("key").alias("first_key"),
            F.count("*").alias("copies"),
            F.first("sketch").alias("sketch"),
            F.first("n").alias("n")
        )
        # Numbers are given once, in a written table, so they stay.
        texts = written(grouped.withColumn("id", F.monotonically_increasing_id()), "texts", at, n_rows * (80 + 4 * t))
        worded = texts.where("n > 0")
        clusters = _clusters(worded.select("id", "sketch"), threshold, runs_for(recall, depth, threshold, t), depth, small, t, at)
        members = clusters.select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(
            texts.select("id", F.col("digest").alias("__digest"), "first_key", "copies", "n"), "id"
        )
        wanted = F.broadcast(members) if fits(members, max_broadcast) else members.hint("shuffle_hash")
        source = docs.select(F.col(key).alias("__key"), digest_of(F.col(text)).alias("digest"), text_of(text).alias("text"))
        found = source.join(
            wanted, (F.col("digest") == F.col("__digest")) & F.col("__key").eqNullSafe(F.col("first_key"))
        ).select("id", "cluster", "copies", "n", "text")
        layout = _layout(members, threshold)
        # Dealt anew where it isn't sent to all, so that a hot cluster is split.
        layout = F.broadcast(layout) if fits(layout, max_broadcast) else layout.hint("rebalance")
        links = _verified(_cluster_blocks(_sets(found, k), layout, threshold), threshold)
        links = written(
            links.groupBy("id").agg(F.sum("links").alias("links"), F.collect_set("top").alias("tops")), "links", at, n_rows * 40
        )
        tops = connected_components(links.select(F.col("id").alias("a"), F.explode("tops").alias("b")), at=at, about=n_rows)
        per_text = links.select("id", "links").join(tops.select(F.col("node").alias("id"), "component"), "id")
        full = written(
            texts.select("id", "digest", "first_key", "copies", (F.col("n") > 0).alias("worded")).join(per_text, "id", "left"),
            "members",
            size=n_rows * 80
        )

    # The class's least key, and the least digest that has it; nulls stand last.
    least = F.min(F.struct(F.col("first_key").isNull().alias("none"), F.col("first_key").alias("name"), F.col("digest").alias("top")))
    linked = full.where("component IS NOT NULL")
    names = linked.groupBy("component").agg(least.alias("least"))
    names = F.broadcast(names) if fits(names, max_broadcast) else names.hint("rebalance")
    # Texts without links are nearly all, and have no part in this join.
    of_class = linked.join(names, "component").select(
        "digest",
        "worded",
        F.col("least.name").alias("name"),
        F.col("least.top").alias("top"),
        (F.col("links") + F.col("copies") - 1).alias("n")
    )
    alone = full.where("component IS NULL").select(
        "digest", "worded", F.col("first_key").alias("name"), F.col("digest").alias("top"), (F.col("copies") - 1).alias("n")
    )
    rows = docs.select(F.col(key).alias("key"), digest_of(F.col(text)).alias("digest")).join(of_class.unionByName(alone), "digest")
    own = F.col("worded")
    return rows.select(
        F.col("key").alias(key),
        F.when(own, F.col("name")).otherwise(F.col("key")).alias("class_id"),
        F.when(own, F.col("n")).otherwise(0).cast("long").alias("n_links"),
        "digest",
        F.when(own, F.col("top")).alias("top"),
    )


def _clusters(worded: DataFrame, threshold: float, runs: int, depth: int, small: int, t: int, at: list[str]) -> DataFrame:
    """``node`` and ``component`` of the texts of ``worded(id, sketch)`` that share a bucket with one whose sketch is near."""
    n_texts, spark = worded.count(), worded.sparkSession
    with passing(spark) as mine:
        leaves, before = None, worded
        for level in range(1, depth + 1):
            # All texts' paths are made twice, as that costs less than to write them.
            paths = _paths(before, t, threshold, runs) if level == 1 else written(_paths(before, t, threshold, 1), "paths", mine)
            sizes = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
            shared = written(paths.join(sizes.hint("rebalance"), "path"), "buckets", mine, n_texts * runs * 24)  # dealt anew: a hot path is split
            more = shared.where(F.col("size") > small)
            last = level == depth or more.isEmpty()
            done = shared if last else shared.where(F.col("size") <= small)
            leaves = done if leaves is None else leaves.unionByName(done)
            if last:
                break
            before = more.join(worded, "id").select("id", "sketch", "path")
        edges = _bucket_edges(_bucket_blocks(leaves.join(worded, "id")), t, screen(threshold, t))
        return connected_components(edges, at=at, about=4 * n_texts)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", max_broadcast: int = BROADCAST_BYTES, **options) -> DataFrame:
    """One row of each class of ``docs``: one with the least key, of several texts with that key the one of least digest, of rows that agree in
    both one of least hash. Rows without words all stay. No row goes for another's key: a row is told by its key and its text."""
    judged = _classed(docs, key=key, text=text, max_broadcast=max_broadcast, **options)
    stands = F.col(key).eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("top"))
    marks = judged.where("top IS NOT NULL").groupBy(key, "digest").agg(F.count("*").alias("rows"), F.bool_and(stands).alias("stands"))
    # Rows that simply stay have no mark, and most do.
    marked = written(
        marks.where("NOT stands OR rows > 1").select(F.col(key).alias("__key"), F.col("digest").alias("__digest"), "stands"),
        "marks",
        size=48 * docs.count()
    )
    sent = F.broadcast if fits(marked, max_broadcast) else (lambda df: df)
    same = docs[key].eqNullSafe(marked["__key"]) & (digest_of(docs[text]) == marked["__digest"])
    kept = docs.join(sent(marked), same, "left_anti")
    repeated = marked.where("stands")
    if repeated.isEmpty():
        return kept
    whole = docs.join(sent(repeated), same, "left_semi")
    plain = [f"`{f.name}`" for f in docs.schema.fields if "map" not in f.dataType.simpleString()]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = whole.groupBy(
        F.col(f"`{key}`").alias("__key"), digest_of(F.col(f"`{text}`")).alias("__digest")
    ).agg(F.min_by(row, F.xxhash64(*plain)).alias("__row"))
    return kept.unionByName(one.select("__row.*"))
