"""Regex expressions against Python's ``re``, chunker invariants, and cases that the fixtures name."""

import re
import time
import unicodedata
from difflib import SequenceMatcher

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.functions import gate, text as T
from foliant.functions.udfs import clean_unicode, segmented, sequence_ratio
from foliant.operators import chunk, resolve

ODD = st.text(alphabet=st.sampled_from(list("ab Zé1-.\n\t,$%()’'·½  ")), max_size=80)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ODD, min_size=20, max_size=40))
def test_expressions_follow_re(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "t",
        T.collapse_dots(F.col("t")).alias("dots"),
        T.dehyphenate(F.col("t")).alias("hyphen"),
        T.tokens(F.col("t")).alias("tokens"),
        T.normal_label(F.col("t")).alias("label"),
        T.strip(F.col("t")).alias("strip"),
        T.numeric_density(F.col("t")).alias("d")
    ).collect()
    for r in rows:
        assert r.hyphen == re.sub(r"([a-z])-\n([a-z])", r"\1\2", r.t)
        assert r.tokens == r.t.split()
        assert r.strip == r.t.strip()
        core = [re.sub(r"[\$,%()\-.\s]", "", x) for x in r.t.split()]
        want = sum(1 for c in core if c and sum(ch.isdigit() for ch in c) / len(c) >= 0.6)
        assert abs(r.d - (want / len(core) if core else 0)) < 1e-9


def test_chunks_cover_and_overlap(spark):
    words = [f"w{i}" for i in range(1000)]
    df = spark.createDataFrame(
        [(1, " ".join(words)), (2, "one"), (3, ""), (4, " ".join(words[:350])), (5, " ".join(words[:351]))], "d int, text string"
    )
    rows = chunk.word_chunks(df).orderBy("d", "chunk_index").collect()
    by = {d: [r for r in rows if r.d == d] for d in range(1, 6)}
    assert [len(by[d]) for d in range(1, 6)] == [1 + -(-(1000 - 350) // 300), 1, 0, 1, 2]
    parts = by[1]
    assert "".join(
        p.content[: (parts[i + 1].char_start - p.char_start) if i + 1 < len(parts) else None] for i, p in enumerate(parts)
    ) == " ".join(words)
    for a, b in zip(parts, parts[1:]):
        assert a.content.split()[-50:] == b.content.split()[:50]


def test_boundaries_are_where_re_finds_them(spark):
    text = "PART I\n\n Item 1. A\nx Item 2. no\nITEM 1A - b\n\npart iv\nItem 7.1.B. c\n"
    item = re.compile(r"^\s*ITEM\s*(\d+[A-Z]?(?:\.\d+)?(?:\.[A-Z])?)\.?[\s—-]", re.I | re.M)
    part = re.compile(r"^\s*PART\s*([IVX]+)\b", re.I | re.M)
    want = sorted(
        [
            (m.start(), f"Item {m[1].upper()}") for m in item.finditer(text)
        ] + [(m.start(), f"Part {m[1].upper()}") for m in part.finditer(text)],
        key=lambda x: x[0]
    )
    got = spark.createDataFrame([(text,)], "t string").select(chunk.boundaries(F.col("t")).alias("b")).first().b
    assert [(b.start, b.label) for b in got] == want


def test_boundaries_of_texts_with_control_characters(spark):
    text = "a\x01b\nItem 1. x\n\x01\x02 Part II\nPART II\n"
    got = spark.createDataFrame([(text,), ("",), ("none",)], "t string").select(chunk.boundaries(F.col("t")).alias("b")).collect()
    assert [[(b.start, b.label) for b in r.b] for r in got] == [[(text.index("Item"), "Item 1"), (text.index("PART"), "Part II")], [], []]


def test_chunks_of_a_long_document(spark):
    words = [f"w{i % 97}" + "x" * (i % 5) for i in range(200_000)]
    rows = chunk.word_chunks(spark.createDataFrame([(1, " ".join(words))], "d int, text string")).orderBy("chunk_index").collect()
    assert len(rows) == 1 + -(-(200_000 - 350) // 300)
    at = 0
    for i, r in enumerate(rows):
        assert r.chunk_index == i and r.char_start == at and r.content.split(" ")[:2] == words[i * 300 : i * 300 + 2]
        at += len(" ".join(words[i * 300 : (i + 1) * 300])) + 1


def test_tickers_with_signs(spark):
    q = spark.createDataFrame(
        [
            (1, "How did BRK.B do in 2020?"),
            (2, "brk.b, then"),
            (3, "BRKXB or BRK"),
            (4, "the BF-B share"),
            (5, "AAL in 2022"),
            (6, "AALX")
        ],
        "question_id int, question string"
    )
    e = spark.createDataFrame(
        [("berkshire", "BRK.B"), ("brown-forman", "BF-B"), ("american", "AAL"), ("odd", ".")], "company string, ticker string"
    )
    assert {
        r.question_id: r.company for r in resolve.by_ticker(q, e).collect()
    } == {1: "berkshire", 2: "berkshire", 4: "brown-forman", 5: "american"}
    pairs = q.crossJoin(e.where("company <> 'odd'")).select(
        "question_id", "company", T.names_ticker(F.col("question"), F.col("ticker")).alias("named")
    ).where("named").collect()
    assert {(r.question_id, r.company) for r in pairs} == {(1, "berkshire"), (2, "berkshire"), (4, "brown-forman"), (5, "american")}


def test_white_space_is_that_of_every_script(spark):
    codes = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, t string").select(
        "c", F.size(T.tokens(F.col("t"))).alias("n"), T.strip(F.substring("t", 2, 1)).alias("s")
    ).collect()
    assert {r.c for r in rows if r.n == 2} == {r.c for r in rows if r.s == ""} == {c for c in codes if chr(c).isspace()}


def test_refusals_and_flags(spark):
    df = spark.createDataFrame([("The text does not include it",), ("y" * 395 + " not contain",), ("fine",)], "a string")
    assert [r[0] for r in df.select(gate.is_refusal(F.col("a"))).collect()] == [True, False, False]
    once = df.select(gate.with_notice(gate.with_notice(F.col("a"), gate.LOW_NOTICE), gate.LOW_NOTICE).alias("x")).first().x
    assert once.count(gate.LOW_NOTICE) == 1


def test_ratio_and_unicode(spark):
    pairs = [("antares", "anteres"), ("apple", "aple"), ("", ""), ("a", "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(sequence_ratio("a", "b")).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    odd = spark.createDataFrame([("ﬁ\x00\n½",), ("a\x07b\tc",)], "t string")
    assert [r[0] for r in odd.select(clean_unicode(F.col("t"))).collect()] == ["fi\n1⁄2", "ab\tc"]
    assert segmented("thequickfox", {"the": 1.0, "quick": 2.0, "fox": 3.0}, 1e3, 5) == ["the", "quick", "fox"]


def test_resolver_fails_open(spark):
    q = spark.createDataFrame(
        [(1, "What are general trends in the pharma industry?"), (2, "Antares Pharma in 2014"), (3, "growth in 2022")],
        "question_id int, question string"
    )
    e = spark.createDataFrame([("antares-pharma-inc", None)], "company string, ticker string")
    got = {r.question_id: (r.company, r.fiscal_year) for r in resolve.resolve(q, e).collect()}
    assert got == {1: (None, None), 2: ("antares-pharma-inc", 2014), 3: (None, None)}
    none = spark.createDataFrame([], "company string, ticker string")
    assert all(r.company is None for r in resolve.resolve(q, none).collect())


def test_rounding_is_that_of_the_number_itself(spark):
    import random

    from foliant.functions import text as T

    rng = random.Random(6)
    numbers = [k / n for n in (1, 3, 7, 32, 64, 160, 800, 2000, 20000) for k in range(0, 60)] + [(2 * k + 1) / 20000 for k in range(3000)]
    numbers += [rng.uniform(-50, 50) for _ in range(2000)] + [-1 / 32, -3 / 32, -0.00625, 1e-9, 123456.00005, 2.675, 1e15 + 0.3]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for n in (1, 2, 4):
        got = [r.y for r in df.select(T.rounded(df.x, n).alias("y")).collect()]
        assert [(x, y) for x, y in zip(numbers, got, strict=True) if round(x, n) != y] == []
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double")
    assert str([r.y for r in odd.select(T.rounded(odd.x).alias("y")).collect()]) == "[None, inf, nan]"


def test_nfkc_over_the_documents_is_that_of_unicodedata(spark):
    from foliant.plans.catalog import QUERIES

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}

    def plain(i, t):
        odd = "ﬁne ½\x00\x07\t" if i % 3 == 0 else "plain\x0b "
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKC", odd + t) if c.isprintable() or c in "\n\t")

    got = {r.doc_id: r.text for r in QUERIES["f07_nfkc"](spark, data).collect()}
    assert got == {i: plain(i, t) for i, t in texts.items()}


def test_registrants_are_found_in_linear_time(spark):
    """a long line before the phrase, short lines, phrases one after the other, and a megabyte of lines without any."""
    from foliant.functions import filing

    said = "\n(Exact Name of Registrant as Specified in its Charter)"
    old = re.compile(r"([^\n]{3,120})\n\(Exact\s*Name\s*of\s*Registrant\s*as\s*Specified\s*in\s*its\s*Charter\)", re.I)
    texts = ["Acme, Inc." + said, "ab" + said + "\nAcme" + said, "x" * 300 + " Acme, Inc." + said, said, "a\n" + said, "Acmé" + said.upper(), "", "Acme\r" + said, "ab" + said + said, "one\nAcme  " + said + " and Zeta" + said]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, text string")
    got = {r.id: (r.name, r.r) for r in rows.select("id", filing.registrant_name(F.col("text")).alias("name"), filing.registrant(F.lit("acme-inc"), F.col("text")).alias("r")).collect()}
    for i, t in enumerate(texts):
        found = old.search(t)
        name = found[1].strip() if found and found[1][0] != "(" else None  # the phrase itself is prose
        assert got[i][0] == name, t
        assert got[i][1].name == got[i][0]
    assert got[len(texts)][0] is None and got[0][1].mismatch is False and got[len(texts)][1].mismatch is None
    big = spark.createDataFrame([("word " * 800_000,)], "text string").select(filing.registrant(F.lit("acme-inc"), F.col("text")).alias("r"))
    began = time.monotonic()
    assert big.collect()[0].r.name is None
    assert time.monotonic() - began < 6


def test_only_odd_texts_go_to_workers_in_small_batches(spark):
    """a text of ASCII isn't sent, and no batch is larger than texts need."""
    from foliant.session import BATCH_BYTES, TEXT_BATCH

    rows = spark.createDataFrame([(1, "plain\x0b "), (2, "ﬁne ½\x00\x07\t\n​é"), (3, None), (4, "")], "id int, text string")
    out = rows.select("id", clean_unicode(F.col("text")).alias("t"))
    assert spark.conf.get(BATCH_BYTES) == TEXT_BATCH
    assert {r.id: r.t for r in out.collect()} == {1: "plain ", 2: "fine 1⁄2\t\né", 3: None, 4: ""}
    assert "_nfkc(CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString()


def test_facts_of_a_company_that_agree_go_by_year(spark):
    """the earliest year of equal facts, however the rows lie."""
    from foliant.operators import facts

    rows = [(f"k{i}-co", f"K{i}", y, "net income", "7") for y in (2020, 2019) for i in range(20)]
    df = spark.createDataFrame(rows, "company string, ticker string, fiscal_year int, label string, value string").coalesce(1)
    got = facts.stratified(df, 20, F.concat("company", "label")).collect()
    assert len(got) == 20 and {r.fiscal_year for r in got} == {2019}


def test_headings_are_looked_for_once(spark):
    """two patterns, each split and extracted once for its headings and once for their names."""
    out = spark.createDataFrame([("PART I\nItem 1. A\nb",)], "text string").select(chunk.boundaries(F.col("text")).alias("b"))
    assert 0 < out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= 4
    assert [(b.start, b.label) for b in out.collect()[0].b] == [(0, "Part I"), (7, "Item 1")]


def test_words_are_counted_by_one_lookup_a_letter(spark):
    """F8: words between white space of any kind, by a class that names its letters: one of ranges took most of the time of f09."""
    texts = [f"a{s}b‘c’{s}{s}日本・語{s}" for s in T.SPACE_LETTERS] + ["‘a’​b᠎c", "", T.SPACE_LETTERS, "one two three\tfour\x85five"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.word_count(F.col("t")).alias("n"))
    assert all(r.n is None if r.t is None else r.n == len(r.t.split()) for r in rows.collect())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    counted = plan[plan.index("regexp_extract_all(") :] if "regexp_extract_all(" in plan else plan
    assert "[^" in counted and not re.search(r"\[\^[^\]]*-", counted), counted


def test_statistics_of_tokens_without_a_value_a_letter(spark):
    """the stand-in encoder of c07 gives the numbers of plain Python, and no text becomes an array of its letters."""
    from foliant.functions.vectors import token_statistics

    texts = ["", " ", "One  two\tthree\n", "\x0bÉtÉ \x0c𝒳日\x85本\r\n", "a b", "x" * 5000 + " y", "ends here"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", token_statistics(F.col("t")).alias("v"))
    for r in rows.collect():
        tokens = [w for w in re.split(r"[ \t-\r]+", (r.t or "").lower()) if w]
        want = [len(tokens), sum(map(len, tokens)), sum(ord(c) % 1000 for w in tokens for c in w)]
        assert list(r.v) == ([None] * 3 if r.t is None else want), r.t
    assert "flatten(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_only_lines_that_may_be_figures_become_rows(spark):
    """lines between breaks of any kind are those of Python's ``splitlines`` and its ``re``; those that can't end as a statement line does are dropped in the text."""
    from foliant.operators import facts

    label = {"Total assets": "total assets", "Net Sales": "total net sales", "Gross profit": "gross profit"}
    ends = ("1,234", "$ 1,234 (99)", "(1,234)", "1,234 —", "1,234 –", "1,234 -", "1,234 n/a", "1,234 na", "1,234,", "1,234.5", "1,234 x", "1,234.", "1,234 %", "12", "1,234 )", "१२३४", "1,234\xa0")
    lines = [f"{a}{c}{e}" for a in label for c in (" ", ": ") for e in ends] + ["Prose that goes on.", "Total assets 1,234 per share 1,000", "x" * 320 + " 1,234", ""]
    texts = [b.join(lines) for b in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "i int, content string")
    out = facts.fact_lines(df)
    old, column = re.compile(facts.LINE, re.A), re.compile(facts._COL, re.A)
    want = []
    for i, t in enumerate(texts):
        for line in (x.strip() for x in t.splitlines()):
            m = old.search(line) if 10 <= len(line) <= 320 and not re.search(facts.NOT_AMOUNTS, line) else None
            figures = column.findall(m[2]) if m else []
            if m and m[1] in label and 1 <= len(figures) <= 6 and len(re.sub("[^0-9]", "", figures[0])) >= 3:
                want.append((i, label[m[1]], re.sub(r"\s+", "", figures[0]), len(figures), line))
    assert len(want) > 40 * len(texts) / 2 and sorted(map(tuple, out.collect())) == sorted(want)
    assert "explode(filter(" in out._jdf.queryExecution().optimizedPlan().toString()
