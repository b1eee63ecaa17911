"""BPE encoding and decoding with a contiguous rank array.

``encode_documents`` turns texts into the ids of a word-level BPE (a ``tokenizers`` JSON file whose
pieces end in a suffix) and decodes them again; a file whose steps aren't those of this module is refused. Merging is done here, not by the library: each short
word holds its part boundaries and the rank of each adjacent pair in contiguous arrays; the smallest
rank is found by a scan, its boundary deleted, and the two neighbouring ranks refreshed, until no pair
has a rank. Words of more than ``LONG`` parts take a heap with the same order of merges, as a scan
costs the square of their length.

Distinct pieces are merged once a worker (``pieces.PieceCache``); work is a narrow map over rows, so
nothing is shuffled and a lost task is simply run again.

Nulls in the text count as the empty text, which has no ids; all other columns are carried unread, so
their nulls and names don't matter. Texts of any length are taken whole. Equal rows give equal results,
an empty table an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from foliant.llm.pieces import PieceCache, flattened, in_parts, no_collector, unassigned
from foliant.session import released, ship, spread

#: Parts above which a word is merged with a heap instead of scans.
LONG = 256
_NONE = 1 << 60
#: Pieces that a worker remembers, some 40 MB.
CACHED = 200_000
#: Characters that are cut into pieces at a time; their pieces and ids take some 40 MB.
PART = 1_000_000

#: The pattern of the word tokenizer, in the form for all of Unicode and in one for common letters.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS_COMMON = r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: What a tokenizer file says of its steps if they are those of this module: normal form, pieces, decoder, and what is added.
STEPS = [
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
    None,
    None,
]
#: Outside these characters (control separators, number letters, scripts beyond Latin) the forms may differ.
UNCOMMON = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def is_common(text: str) -> bool:
    """Whether the forms of a pattern agree on ``text``."""
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return not UNCOMMON.search(text)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else the next free letter from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        self._path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x.get("normalizers", x) for x in [spec["normalizer"] or {}]] + [
            (spec["pre_tokenizer"] or {}).get("pretokenizers"), spec["decoder"], spec["post_processor"]
        ]
        odd = {"byte_fallback": False, "ignore_merges": False, "dropout": None, "continuing_subword_prefix": None, "unk_token": None}
        if steps != STEPS or any(model.get(k, v) != v for k, v in odd.items()) or any(
            x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]
        ):
            raise ValueError(f"{path}: a tokenizer of another kind; its steps are {steps}")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self._inner = [vocab[c] for c in letters]
        self._last = [vocab[c + self.suffix] for c in letters]
        self._rank: dict[int, int] = {}
        self._made: list[int] = []
        for rank, (a, b) in enumerate(tuple(x.split(" ")) if isinstance(x, str) else x for x in model["merges"]):
            self._rank.setdefault(vocab[a] << 32 | vocab[b], rank)
            self._made.append(vocab[a + b])
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for word, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = word
        self._words, self._common = regex.compile(WORDS), re.compile(WORDS_COMMON)
        self._marks = re.compile(
            "(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
        ) if self.special else None
        self.cache = PieceCache(lambda pieces: flattened(map(self.merge, pieces)), CACHED)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece; a special token is its own piece."""
        if piece in self.special:
            return [self.special[piece]]
        raw = piece.encode()
        ids = [self._inner[b] for b in raw[:-1]]
        ids.append(self._last[raw[-1]])
        return self._by_scan(ids) if len(ids) <= LONG else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        rank = self._rank.get
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            ids[i] = self._made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self._rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j], _NONE) != r:
                continue  # a part of this pair has been merged since
            ids[i], ids[j] = self._made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (s := rank(ids[x] << 32 | ids[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (s, x))
        return [x for x in ids if x >= 0]

    def _split_by_library(self, text: str) -> list[str]:
        """Pieces of a text with characters whose class only the library's tables tell."""
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self._path)
        normal = self._library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not is_common(text) and unassigned().search(text):
                return self._split_by_library(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case letter by letter, without the rule for a final sigma
                text = text.replace("Σ", "σ")
        common = is_common(text)
        text = text.lower()
        if common:
            return self._common.findall(text)
        # A run of white space is one space, and spaces belong to no piece.
        return self._words.findall(text)

    def pieces(self, text: str) -> list[str]:
        if self._marks is None or not any(x in text for x in self.special):
            return self._plain(text)
        return [y for i, x in enumerate(self._marks.split(text)) for y in ([x] if i % 2 else self._plain(x))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        with no_collector():
            ids, at = self.cache([self.pieces(x) for x in texts])
        return [ids[at[i] : at[i + 1]] for i in range(len(texts))]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space: the file names no decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder, with its cache, for all tasks of a worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` without its text, with ``bpe_ids`` (array of int; left out where ``ids`` is false), ``n_tokens``,
    ``ids_sha256`` of the ids as little-endian 32-bit integers, and ``decoded_sha256`` of the decoded text.

    ``path`` is the tokenizer file on every executor. A column of ``docs`` named like a result column is replaced.
    """
    ship(docs.sparkSession)
    results = ["bpe_ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    own = [f for f in docs.schema.fields if f.name != text and f.name not in results]
    # Columns go by place, so that no name clashes.
    kept = [F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(own)]
    rows = spread(docs.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")))
    schema = StructType(list(own))
    if ids:
        schema = schema.add("bpe_ids", ArrayType(IntegerType()))
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = batch.column(len(own)).to_pylist()
            for a, b in in_parts(texts, PART):
                found = bpe.encode(texts[a:b])
                columns = batch.slice(a, b - a).columns[:-1]
                if ids:
                    columns.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
                columns.append(pa.array([len(x) for x in found], pa.int64()))
                columns.append(pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found], pa.string()))
                columns.append(pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(released(run), schema)
