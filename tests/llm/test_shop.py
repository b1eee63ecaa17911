"""Target encoding, SimHash and fill-in-the-middle against SQL, brute force and round trips."""

import hashlib
import random
import re
import zlib
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import fill_middle, queries, simhash, target_encoding
from foliant.llm.common import passing

DATA = "/root/testdata/sf0.001"


def views():
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {p.name[:-8]} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


@pytest.mark.parametrize("name", ["op11_target_encoding", "op13_fill_middle"])
def test_queries_give_what_sql_gives(name, spark):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = views().execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)


# ------------------------------------------------------------------ target encoding

SHOP = {
    "sale_lines": "sale_id long, item_id long, vendor_id long, flag string, n string",
    "sales": "sale_id long, client_id long, sold_at timestamp_ntz, lines string",
    "items": "item_id long, kind string, level string",
    "vendors": "vendor_id long, nation_id int",
    "clients": "client_id long, segment string, nation_id int",
}


def shop(seed):
    """Few ids and moments, so that ties, repeats and hot keys abound; missing and unknown ids in every place."""
    rng = random.Random(seed)
    some = lambda n: rng.choice([None, *range(n), 0, 0])
    begin = datetime(2024, 3, 30)
    sales = [(i, some(4), None if rng.random() < 0.1 else begin + timedelta(minutes=30 * rng.randrange(12)), "x") for i in range(40)]
    lines = [(rng.choice([None, 99, *range(40), 7, 7, 7]), some(5), some(3), rng.choice(["returned", "kept", None]), "y") for _ in range(300)]
    items = [(i, rng.choice(["a", "b", None]), "z") for i in range(4)]
    vendors, clients = [(0, 1), (1, None)], [(i, rng.choice(["s", None]), 0) for i in range(3)]
    return {"sale_lines": lines, "sales": [*sales, (None, 1, begin, "x")], "items": items, "vendors": vendors, "clients": clients}


def brute(data):
    kinds, nations, segments = ({r[0]: r[1] for r in data[t]} for t in ("items", "vendors", "clients"))
    sales = {s: (c, t) for s, c, t, _ in data["sales"] if s is not None and t is not None}
    rows = []
    for s, i, v, flag, _ in data["sale_lines"]:
        if s in sales:
            i, (c, t) = -1 if i is None else i, sales[s]
            c = -1 if c is None else c
            keys = {"all": 0, "item": i, "kind": kinds.get(i), "vendor": v, "nation": nations.get(v), "client": c, "segment": segments.get(c)}
            rows.append((s, i, v, t, zlib.crc32(str(s).encode()) % 5, flag == "returned", keys))

    def rate(n, s, p):
        return p if n < 1 else (1_000_000 * s + 50 * p) // (n + 50)

    found = {}
    for s, i, v, t, fold, hit, keys in rows:
        past = [r for r in rows if r[3] < t and r[4] != fold]
        of = {k: (sum(r[6][k] == x for r in past), sum(r[5] for r in past if r[6][k] == x)) for k, x in keys.items()}
        top, out = rate(*of["all"], 500_000), []
        for child, parent in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
            out += [of[child][0], rate(*of[child], rate(*of[parent], top))]
        n, hits, _ = found.get((s, i, v), (0, 0, None))
        found[s, i, v] = n + 1, hits + hit, tuple(out)
    return {(*k, n, h, *out) for k, (n, h, out) in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_encoding_against_all_pairs(spark, seed):
    data = shop(seed)
    frames = [spark.createDataFrame(data[t], schema) for t, schema in SHOP.items()]
    got = target_encoding.encode_lines(*frames).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(data)


def test_encoding_of_empty_tables(spark):
    empty = {t: spark.createDataFrame([], schema) for t, schema in SHOP.items()}
    assert target_encoding.encode_lines(*empty.values()).count() == 0
    data = shop(3)
    full = {t: spark.createDataFrame(data[t], schema) for t, schema in SHOP.items()}
    got = target_encoding.encode_lines(full["sale_lines"], full["sales"], *(empty[t] for t in ("items", "vendors", "clients"))).collect()
    assert {tuple(r) for r in got} == brute(data | {"items": [], "vendors": [], "clients": []})


def test_a_sale_that_comes_again_is_its_earliest(spark):
    data = shop(4)
    frames = {t: spark.createDataFrame(data[t], schema) for t, schema in SHOP.items()}
    late = frames["sales"].withColumn("sold_at", F.expr("sold_at + interval 1 day")).withColumn("client_id", F.lit(3).cast("long"))
    frames["sales"] = frames["sales"].unionByName(late)
    known = {s for s, _, t, _ in data["sales"] if t is not None}
    assert {tuple(r) for r in target_encoding.encode_lines(*frames.values()).collect() if r.sale_id in known} == brute(data)


def test_sums_do_not_hang_on_parts_and_batches(spark):
    """One value and one moment over many parts and batches; also the driver's part alone, with parts cut anywhere."""
    rng = np.random.default_rng(5)
    n = 400
    rows = pd.DataFrame({
        "level": 0, "value": rng.integers(0, 3, n), "moment": rng.integers(0, 4, n), "fold": rng.integers(0, 5, n),
        "a": np.arange(n), "b": 0, "c": 0, "lines": rng.integers(1, 4, n), "hits": rng.integers(0, 2, n)
    }).sort_values(["level", "value", "moment", "a"]).reset_index(drop=True)
    want = [
        tuple(int(rows[c][(rows.value == r.value) & (rows.moment < r.moment) & (rows.fold != r.fold)].sum()) for c in ("lines", "hits"))
        for r in rows.itertuples()
    ]
    for cuts in ([], [1, 2, 3], sorted(rng.choice(n, 40, replace=False).tolist()), list(range(1, n))):
        ends, done = [], []
        for part, (i, j) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
            sums = target_encoding._Sums(5)
            for k in range(i, j, 7):
                batch = rows.iloc[k : min(j, k + 7)]
                done += [(part, int(f), bool(o), bool(t), int(x), int(y)) for f, o, t, x, y in zip(batch.fold, *sums.add(batch), strict=True)]
            if sums.last is not None:
                ends += list(target_encoding._ends(part, sums).itertuples())
        more = {(p, f, t): (x, y) for p, f, t, x, y in target_encoding.carried(ends)}
        got = []
        for part, fold, opens, ties, x, y in done:
            dx, dy = more.get((part, fold, ties), (0, 0)) if opens else (0, 0)
            got.append((x + dx, y + dy))
        assert got == want


def test_moments_do_not_hang_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    times = [datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 3, 30, 0, 5), datetime(1969, 12, 31, 23, 59, 59, 999_999), datetime(2500, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r.m for r in df.select(target_encoding.micros(F.col("t")).alias("m")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times]


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def least_reachable(prints, most):
    values = np.array(prints, np.uint64)
    tops = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= most
    while True:
        new = np.where(near, tops[None, :], len(values)).min(axis=1)
        if (new == tops).all():
            return tops.tolist()
        tops = new


def texts_for_simhash():
    rng = random.Random(8)
    texts = [None, "", " \n ", "one", "One", "two words", "Éa ÉA x", "a b c\x1cd e f g", "x " * 3000, "a b c d e f g h " * 4000]
    for _ in range(30):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = base[:]
            other[rng.randrange(len(other))] = "changed"
            texts.append("\t".join(other))
    return texts


def test_simhash_against_all_pairs(spark, docs_of):
    texts = texts_for_simhash()
    prints = [plain_fingerprint(t) for t in texts]
    got = sorted(simhash.near_duplicates(docs_of(texts), block=16, part=1 << 12).collect())
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got] == list(zip(range(len(texts)), prints, least_reachable(prints, 4), strict=True))
    assert [r.fingerprint for r in got[:3]] == ["0" * 16] * 3


@pytest.mark.parametrize("radius", [1, 2])
def test_balls_find_every_link(spark, radius):
    """Clusters of fingerprints at all distances, one hot; links join what is near, and nothing else."""
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 1}
    for size in (150, 20, 20, 5):
        base = rng.getrandbits(64)
        for _ in range(size):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))))
    prints = sorted(prints)
    signed = [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints]
    with passing(spark) as at:
        links = simhash.links(spark.createDataFrame(signed, "fp long"), len(prints), radius, at, block=32, part=1 << 14).collect()
    place = {p[0]: i for i, p in enumerate(signed)}
    tops = list(range(len(prints)))
    find = lambda i: i if tops[i] == i else find(tops[i])
    for a, b in links:
        assert (prints[place[a]] ^ prints[place[b]]).bit_count() <= 2 * radius
        x, y = find(place[a]), find(place[b])
        tops[max(x, y)] = min(x, y)
    assert len(links) == len({frozenset(x) for x in links})
    assert [find(i) for i in range(len(prints))] == least_reachable(prints, 2 * radius)


def test_simhash_odd_rows(spark):
    schema = "fp string, doc_id long, text string, component_id int, key int"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [("a", None, "a b c", 1, 2), ("a", 5, "A B C", 1, 2), ("b", 5, "A B C", 1, 2), ("c", None, "alone here", 1, 2), ("d", 9, None, 1, 2)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id) == [(0, 5), (5, 5), (5, 5), (9, 9)]
    assert [r.doc_id for r in got if r.component_id is None] == [None]


def test_gaps_are_packed_whole():
    rng = np.random.default_rng(2)
    for top in (200, 1 << 16, 1 << 40, (1 << 63) - 1):
        values = np.sort(rng.integers(0, top, 500, dtype=np.uint64))
        assert (simhash.unpacked(simhash.packed(values)) == values).all()


# ------------------------------------------------------------------ fill in the middle


def test_pieces_are_put_back(spark, docs_of):
    odd = [None, "", "a", "a<P>b", "<<S", "<P", "<M><", "x" * 100_000, "日本語 😀👍🏽 é", "퟿", "a\x00b", "<" * 30 + "S>" * 3]
    texts = odd + [f"{i} <S and > text {i}" for i in range(300)]
    for units in ("characters", "words"):
        made = fill_middle.fill_in_middle(docs_of(texts), units=units)
        got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).orderBy("doc_id").collect()
        assert [r.back for r in got] == [t or "" for t in texts]
        assert {r.form for r in got} == {"plain", "psm", "spm"}
        for r, t in zip(got, (t or "" for t in texts), strict=True):
            h = [int(hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in range(0, 32, 8)]
            pieces = list(t) if units == "characters" else re.findall(r"[ \t-\r]+|[^ \t-\r]+", t)
            n = len(pieces)
            lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            p, m, s = ("".join(x) for x in (pieces[:lo], pieces[lo:hi], pieces[hi:]))
            form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
            want = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
            assert (r.n, r.form, r.output) == (n, form, want)
            assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))


def test_fill_in_middle_odd_rows(spark):
    schema = "form string, doc_id long, text string, key int, name string"
    assert fill_middle.fill_in_middle(spark.createDataFrame([], schema)).count() == 0
    rows = [("x", None, "some text", 3, "n"), ("x", 4, "some text", 3, "n"), ("x", 4, "some text", 3, "n")]
    got = fill_middle.fill_in_middle(spark.createDataFrame(rows, schema)).collect()
    assert [r.key for r in got] == [3, 3, 3] and [r.name for r in got] == ["n"] * 3 and got[0].asDict().keys() == {*"doc_id key name n form prefix_chars middle_chars output".split()}
    assert [r.output for r in got if r.doc_id == 4][0] == [r.output for r in got if r.doc_id == 4][1]
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(spark.createDataFrame([], schema), units="bytes")
