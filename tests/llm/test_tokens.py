"""Token counts, rank-array BPE and shards against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliant.llm import bpe, pieces, sst, token_counts

ODD = [
    None, "", " ", "a", "Hello  World\n\n\tIt's 2024, they'll see!!", "ΑΣ ΣΑΣ Σ", "İstanbul ŞİŞ ﬁ ½ ² Ⅷ", "é é naïve", "日本語のテキスト 한국어 русский", "😀👍🏽 emoji", "a<|endoftext|>b <|startoftext|> c", "\x1c\x1d x\x85y z w", "x" * 700, "ab" * 3000,
    "don't DON'T 'Re 've", "1234567890", "tab\tsep\r\nnew", "a​b", "<|endoftext|>", "ǅ ǆ Ĳ ĳ ŉ", "_under_score__ __", "¼½¾ªº¹", "mixed123abc456", "a\u0558b \u1c89\u1c8a1", "x\U000323b0y \ua7cb'S \ua7dc", "'''s ''t",
]


def odd_texts():
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(1, 0x250), 0x3A3, 0x1E9E, 0x2028, 0x3000, 0x4E2D, 0xFB01, 0x1F600)]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_counts_follow_the_library_and_the_cache_is_used(spark, docs_of, tmp_path):
    texts = [t for t in odd_texts() if t is None or "\0" not in t] + ["dup text"] * 5
    model, cache = P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs_of(texts), model, cache).collect()}
    assert got == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in enumerate(texts)}
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    # A stored count is taken as it is: the text isn't encoded again.
    digest = hashlib.sha256(b"planted").digest()
    spark.createDataFrame(
        [(token_counts.tokenizer_version(model), bytearray(digest), 4321)], token_counts.CACHE
    ).write.mode("append").parquet(cache)
    again = token_counts.count_tokens(docs_of(["planted", "dup text"]), model, cache).orderBy("doc_id").collect()
    assert [r.n_tokens for r in again] == [4321, len(sp.encode("dup text"))]
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1


def test_counts_of_nothing_nulls_and_repeats(spark, tmp_path):
    model = P.path("piece_bpe_32k.model")
    none = spark.createDataFrame([], "doc_id long, text string, n_tokens long")
    assert token_counts.count_tokens(none, model, f"file://{tmp_path}/a").count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = token_counts.count_tokens(odd, model, f"file://{tmp_path}/b").collect()
    assert len(rows) == 4 and sum(r.n_tokens for r in rows) == 6


def test_word_bpe_follows_the_library():
    path = P.path("word_bpe_49k.json")
    own, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    texts = [t or "" for t in odd_texts()]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_heap_and_scan_merge_alike():
    own, rng = bpe.WordBpe(P.path("word_bpe_49k.json")), random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice(b"etaonrishd") for _ in range(rng.randint(1, 60)))
        ids = [own._inner[b] for b in raw[:-1]] + [own._last[raw[-1]]]
        assert own._by_scan(list(ids)) == own._by_heap(list(ids))


def test_bpe_keeps_other_columns(spark, docs_of):
    docs = docs_of([None, "two words", "", "two words"]).withColumn("n_tokens", F.lit("clash"))
    rows = bpe.encode_documents(docs, P.path("word_bpe_49k.json")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [0, 2, 0, 2] and rows[1].bpe_ids == rows[3].bpe_ids and rows[0].source == "src0"
    assert bpe.encode_documents(docs.limit(0), P.path("word_bpe_49k.json"), ids=False).count() == 0


def test_shards_follow_the_library_and_are_searchable(spark, docs_of, tmp_path):
    texts, path, folder = odd_texts(), P.path("byte_bpe_50k.json"), f"file://{tmp_path}/shards"
    library = Tokenizer.from_file(path)
    docs = docs_of(texts).unionByName(docs_of(["same key"])).repartition(5)
    docs = docs.unionByName(spark.createDataFrame([(None, "no key", "en", "s", 6)], docs.schema))
    sst.write_shards(docs, folder, path, 2, block_bytes=300, shard_bytes=4000)
    rows = sst.read_documents(spark, folder, ids=True).collect()
    assert len(rows) == len(texts) + 2
    assert len(list((tmp_path / "shards").glob("*.sst"))) > 2
    start = 0
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 0, 0, *range(1, len(texts))]
    for r in ordered:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
        if r.doc_id:
            assert r.ids[:-1] == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    for k in (1, 57, len(texts) - 1):
        assert sst.lookup(spark, folder, k) == [next(r.ids for r in rows if r.doc_id == k)]
    assert len(sst.lookup(spark, folder, 0)) == 2 and len(sst.lookup(spark, folder, None)) == 1
    assert sst.lookup(spark, folder, 10**9) == [] and sst.lookup(spark, folder, -5) == []


def test_no_documents_no_shards(spark, docs_of, tmp_path):
    sst.write_shards(docs_of([]), f"file://{tmp_path}/s", P.path("byte_bpe_50k.json"), 2)
    assert sst.read_documents(spark, f"file://{tmp_path}/s").count() == 0


def test_a_full_cache_starts_anew():
    seen = []

    def encode(new):
        seen.extend(new)
        return pieces.flattened([len(p)] * 2 for p in new)

    cache = pieces.PieceCache(encode, max_pieces=3)
    for _ in range(3):
        ids, at = cache([["a", "bb"], [], ["ccc", "a", "dddd"]])
        assert ids.tolist() == [1, 1, 2, 2, 3, 3, 1, 1, 4, 4] and at.tolist() == [0, 4, 4, 10]
    assert len(seen) == 12
