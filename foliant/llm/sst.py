"""Token ids in sorted-string-table shards.

``write_shards`` encodes whole texts with a byte-level BPE of the ``tokenizers`` library, appends an end
id to each document, and writes documents in ascending order of their key. A shard file holds

* blocks of entries ``shared, unshared, size, key suffix, ids``: a key gives only the bytes after the prefix
  that it shares with the key before it in its block; each block is compressed on its own;
* an index with the first key, place, entries and ids of each block;
* a Bloom filter over the keys;
* a footer of fixed size that says where index and filter lie.

``lookup`` finds a document by a binary search over the shards, then over the index, then reads one block.
``read_documents`` reads all shards in parallel.

Rows are dealt by range of key and text digest, so shards follow each other in key order, and rows that share a key, or have none, are
dealt over as many shards as they need. Where documents before a shard end is summed from the manifest, which has one row of some
200 bytes a shard of 256 MB: the driver reads 50 MB of it for 60 TB of ids. A task names its files by itself and only those of the
attempt that Spark commits enter the manifest, so lost executors and second attempts do no harm.

A null text is empty: its document holds the end id only. A null key sorts before all others. Documents that
share a key keep a place each, next to each other, in the order of a hash of their texts. An empty table gives no shards. A text's special strings
become the tokenizer's special ids, as is its default. Texts of any length are taken whole; other columns aren't read.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe import UNCOMMON, is_common
from foliant.llm.common import text_of
from foliant.llm.pieces import PieceCache, flattened, in_parts, no_collector, unassigned
from foliant.session import released, ship

#: The pattern of the byte-level tokenizer, in the form for all of Unicode and in one for common letters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_COMMON = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

MAGIC = b"FOLSST01"
#: index at, index size, filter at, filter size, documents, ids, bytes an id, hashes of the filter, magic
FOOTER = struct.Struct("<QQQQQQBB6x8s")
MANIFEST = "part long, seq long, file string, n_docs long, n_ids long, first_key binary, last_key binary"
BITS, HASHES = 10, 7
#: New words that one call of the library encodes.
_AT_ONCE = 200
#: Pieces that a worker remembers, some 160 MB: most of the time goes into new pieces.
CACHED = 800_000


class ByteBpe:
    """The library's encoder behind a cache of pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self.special = [x.content for x in self._library.get_added_tokens_decoder().values()]
        self._marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._pieces, self._common = regex.compile(PIECES), re.compile(PIECES_COMMON)
        self.cache = PieceCache(self._encode_new, CACHED)
        vocab = self._library.get_vocab(with_added_tokens=False)
        self._bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a letter of a token stands for a byte
        for token, i in vocab.items():
            self._bytes[i] = len(token)

    def _encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with a space before them are encoded many in one call: a text of such words falls into just
        those pieces, and a token's bytes tell which of them it belongs to. Other pieces are encoded one by one."""
        joint = [i for i, p in enumerate(new) if p[0] == " " and p[1:].isalpha() and not UNCOMMON.search(p)]
        chunks = [joint[i : i + _AT_ONCE] for i in range(0, len(joint), _AT_ONCE)]
        found = [
            np.array(x.ids, np.uint32) for x in self._library.encode_batch_fast(
                ["".join([new[i] for i in c]) for c in chunks], add_special_tokens=False
            )
        ]
        alone = sorted(set(range(len(new))) - set(joint))
        lens, order = np.zeros(len(new), np.int64), np.array(joint + alone, np.int64)
        for chunk, ids in zip(chunks, found, strict=True):
            ends = np.cumsum(self._bytes[ids])
            wanted = np.cumsum([len(new[i].encode()) for i in chunk])
            at = np.searchsorted(ends, wanted)
            if not (ends[at] == wanted).all():
                raise ValueError("the tokenizer joins words")
            lens[chunk] = np.diff(at, prepend=-1)
        single, rest = flattened(x.ids for x in self._library.encode_batch_fast([new[i] for i in alone], add_special_tokens=False))
        lens[alone] = single
        flat = np.concatenate([*found, rest])
        # From the order of the calls to that of the pieces.
        sizes = lens[order]
        starts = np.zeros(len(new), np.int64)
        starts[order] = np.cumsum(sizes) - sizes
        ends = np.cumsum(lens)
        return lens, flat[np.repeat(starts - (ends - lens), lens) + np.arange(int(ends[-1]))]

    def _plain(self, text: str) -> list[str]:
        if is_common(text):
            return self._common.findall(text)
        if unassigned().search(text):
            return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        return self._pieces.findall(text)

    def pieces(self, text: str) -> list[str]:
        if self._marks is None or not any(x in text for x in self.special):
            return self._plain(text)
        return [y for i, x in enumerate(self._marks.split(text)) for y in ([x] if i % 2 else self._plain(x))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        with no_collector():
            return self.cache([self.pieces(x) for x in texts])


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def key_bytes(key: int | None) -> bytes:
    """Bytes that sort as the keys do; a null key comes first."""
    return b"\0" if key is None else b"\1" + struct.pack(">Q", key + (1 << 63))


def key_of(raw: bytes) -> int | None:
    return None if raw == b"\0" else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, block_bytes: int):
        self._out, self.width, self._block_bytes = out, width, block_bytes
        self._zip = zstandard.ZstdCompressor(level=1)
        self._block, self._index, self._keys = bytearray(), [], []
        self._first, self._last, self._at = b"", b"", 0
        self._n = self._ids = 0
        self.n_docs = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self._n:
            self._first, self._last = key, b""
        shared = len(os.path.commonprefix([self._last, key]))
        value = ids.astype(f"<u{self.width}").tobytes()
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + value
        self._keys.append(key)
        self._last, self._n, self._ids = key, self._n + 1, self._ids + len(ids)
        if len(self._block) >= self._block_bytes:
            self._flush()

    def _flush(self) -> None:
        raw = self._zip.compress(bytes(self._block))
        self._out.write(raw)
        self._index.append((self._first, self._at, len(raw), len(self._block), self._n, self._ids))
        self.n_docs, self.n_ids = self.n_docs + self._n, self.n_ids + self._ids
        self._at, self._block, self._n, self._ids = self._at + len(raw), bytearray(), 0, 0

    @property
    def size(self) -> int:
        return self._at + len(self._block)

    def close(self) -> tuple[bytes, bytes]:
        """The first and last key."""
        if self._n:
            self._flush()
        index = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self._index)
        bits = max(64, BITS * len(self._keys))
        bloom = np.zeros(bits // 8 + 1, np.uint8)
        for key in self._keys:
            for p in _probes(key, bits, HASHES):
                bloom[p >> 3] |= 1 << (p & 7)
        filled = struct.pack("<Q", bits) + bloom.tobytes()
        self._out.write(index + filled)
        self._out.write(
            FOOTER.pack(
                self._at, len(index), self._at + len(index), len(filled), self.n_docs, self.n_ids, self.width, HASHES, MAGIC
            )
        )
        self._out.close()
        return self._keys[0], self._keys[-1]


class ShardReader:
    """Reads one shard: all of it in order, or one key."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        ia, il, ba, bl, self.n_docs, self.n_ids, self.width, self._hashes, magic = FOOTER.unpack(
            file.read_at(FOOTER.size, size - FOOTER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a shard file")
        raw, at, self.index = file.read_at(il, ia), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            rest = []
            for _ in range(5):
                x, at = _read_varint(raw, at)
                rest.append(x)
            self.index.append((key, *rest))
        self._bloom_at = (ba, bl)
        self._zip = zstandard.ZstdDecompressor()

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, full, n, _ = self.index[i]
        raw, at, key = self._zip.decompress(self._file.read_at(size, at), max_output_size=full), 0, b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            own, at = _read_varint(raw, at)
            count, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, np.frombuffer(raw, f"<u{self.width}", count, at)
            at += count * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        raw = self._file.read_at(self._bloom_at[1], self._bloom_at[0])
        bits = struct.unpack_from("<Q", raw)[0]
        return all(raw[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits, self._hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every document that has the key."""
        if not self.may_hold(key):
            return []
        firsts = [x[0] for x in self.index]
        i, found = max(0, bisect.bisect_left(firsts, key) - 1), []
        while i < len(firsts) and firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    width: int = 2,
    block_bytes: int = 64 << 10,
    shard_bytes: int = 256 << 20
) -> DataFrame:
    """Writes ``docs`` as shards under ``folder`` (a URI that all executors reach) and returns the manifest,
    which is also written there. ``width``: bytes an id; an id that doesn't fit raises."""
    ship(docs.sparkSession)
    limit = 1 << 8 * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seq = loaded(tokenizer), TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        out = name = None

        def closed() -> pa.RecordBatch:
            first, last = out.close()
            row = {"part": part, "seq": seq, "file": name, "n_docs": out.n_docs, "n_ids": out.n_ids, "first_key": first, "last_key": last}
            return pa.RecordBatch.from_pylist(
                [row],
                pa.schema(
                    [
                        ("part", pa.int64()),
                        ("seq", pa.int64()),
                        ("file", pa.string()),
                        ("n_docs", pa.int64()),
                        ("n_ids", pa.int64()),
                        ("first_key", pa.binary()),
                        ("last_key", pa.binary())
                    ]
                )
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_parts(texts):
                ids, at = bpe.encode(texts[a:b])
                if len(ids) and int(ids.max()) >= limit or end_id >= limit:
                    raise ValueError(f"an id does not fit into {width} bytes")
                for i in range(b - a):
                    if out is None:
                        name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.sst"
                        out = ShardWriter(store.open_output_stream(f"{base}/{name}"), width, block_bytes)
                    out.add(key_bytes(keys[a + i]), np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
                    if out.size >= shard_bytes:
                        yield closed()
                        out, seq = None, seq + 1
        if out is not None:
            yield closed()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"), text_of(f"`{text}`").alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    ordered.mapInArrow(released(run), MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _shards(spark: SparkSession, folder: str) -> list:
    """The manifest's rows in key order, each with the ids before its shard: one row a shard file."""
    rows, start = sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: (r.part, r.seq)), 0
    out = []
    for r in rows:
        out.append((r.file, start, bytes(r.first_key), bytes(r.last_key)))
        start += r.n_ids
    return out


def read_documents(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` of the ids as little-endian 32-bit integers, and the ids themselves where asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as file:
                    shard = ShardReader(file)
                    for i in range(len(shard.index)):
                        keys, starts, sizes, crcs, all_ids = [], [], [], [], []
                        for key, found in shard.block(i):
                            keys.append(key_of(key))
                            starts.append(start)
                            sizes.append(len(found))
                            crcs.append(zlib.crc32(found.astype("<u4").tobytes()))
                            all_ids.append(found)
                            start += len(found)
                        columns = [pa.array(x, pa.int64()) for x in (keys, starts, sizes, crcs)]
                        if ids:
                            columns.append(pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    shards = [x[:2] for x in _shards(ship(spark), folder)]
    files = spark.createDataFrame(shards, "file string, start long").repartition(max(1, len(shards)))
    return files.mapInArrow(released(run), schema)


def lookup(spark: SparkSession, folder: str, key: int | None) -> list[list[int]]:
    """The ids of the documents with a key: a binary search over shards, then within one."""
    raw, (store, base) = key_bytes(key), fs.FileSystem.from_uri(folder)
    shards = _shards(spark, folder)
    i, found = bisect.bisect_left([x[3] for x in shards], raw), []
    while i < len(shards) and shards[i][2] <= raw:
        with store.open_input_file(f"{base}/{shards[i][0]}") as file:
            found += [x.tolist() for x in ShardReader(file).get(raw)]
        i += 1
    return found
