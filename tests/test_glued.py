"""Glued words against the cheapest of all cuts, on typed costs and on those of the given documents."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from foliant.operators import glued

DATA = "/root/testdata/sf0.001"


def cheapest(token, cost):
    """By all cuts."""
    best = None
    for n in range(len(token)):
        for at in itertools.combinations(range(1, len(token)), n):
            parts = [token[a:b] for a, b in zip((0, *at), (*at, len(token)), strict=True)]
            if all(p.lower() in cost for p in parts):
                price = sum(cost[p.lower()] for p in parts)
                best = price if best is None or price < best else best
    return best


def test_costs_are_of_all_words(spark):
    docs = spark.createDataFrame([("The cat. the DOG; the cat1cat",), (None,), ("",), ("internationalization once",)], "text string")
    got = {r.word: (r.n, r.cost) for r in glued.word_costs(docs).collect()}
    assert got == {"the": (3, pytest.approx(math.log(8 / 3))), "cat": (3, pytest.approx(math.log(8 / 3)))}
    assert glued.word_costs(docs.limit(0)).count() == 0


def test_the_cheapest_cut_of_all(spark):
    cost = {"an": 2.0, "and": 1.0, "the": 1.0, "a": 3.0, "nd": 4.0, "then": 2.5, "hen": 2.0, "t": 6.0, "he": 3.0, "n": 5.0, "ndthe": 2.0}
    tokens = ["andthenandthe", "Andthethenhen", "anandandthehen", "xandtheandthen", "thethethethe", "ndthenanandt"]
    costs = spark.createDataFrame(list(cost.items()), "word string, cost double")
    got = {r.token: r.cut for r in glued.cut_tokens(spark.createDataFrame([(t,) for t in tokens + tokens[:1] + [None]], "token string"), costs).collect()}
    assert got.keys() == set(tokens)
    for t in tokens:
        want = cheapest(t, cost)
        assert got[t].replace(" ", "") == t
        assert (got[t] == t) if want is None else sum(cost[p.lower()] for p in got[t].split()) == pytest.approx(want)


def test_texts_keep_everything_else(spark):
    costs = spark.createDataFrame([("quick", 1.0), ("brown", 1.0), ("jumps", 1.0)], "word string, cost double")
    rows = [(1, "A  quickbrownjumps, x\nQuickBrownJumps!", "k"), (2, "internationalization", "k"), (3, None, None), (4, "", "k"), (5, "quickbrown", "k")]
    got = {r.id: (r.text, r.cut) for r in glued.deglued(spark.createDataFrame(rows, "id long, text string, cut string"), costs, "id").collect()}
    assert got == {1: ("A  quick brown jumps, x\nQuick Brown Jumps!", "k"), 2: ("internationalization", "k"), 3: (None, None), 4: ("", "k"), 5: ("quickbrown", "k")}


def test_words_of_the_documents_glued_on_purpose(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 5) & (F.length(w) < 15))
    made = docs.select("doc_id", F.slice(words, 3, 4).alias("w")).where("size(w) = 4").select(
        "doc_id", F.array_join("w", " ").alias("want"), F.array_join("w", "").alias("text")
    )
    got = {r.doc_id: r.text for r in glued.deglued(made.drop("want"), glued.word_costs(docs), "doc_id").collect()}
    want = {r.doc_id: r.want for r in made.collect()}
    # The words are invented of syllables and many are made of others, so the words that were glued aren't always the cheapest: what is found costs no more.
    cost = {r.word: r.cost for r in glued.word_costs(docs).collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k].replace(" ", "") == v.replace(" ", "")
        if len(v.replace(" ", "")) >= glued.GLUED and all(w in cost for w in v.split()):
            assert sum(cost[w] for w in got[k].split()) <= sum(cost[w] for w in v.split()) + 1e-9
    assert any(got[k] == v for k, v in want.items())
    plan = glued.cut_tokens(made.select(F.col("text").alias("token")), glued.word_costs(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("broadcast") == 1  # the one row of the total


def test_no_table_is_gathered_on_the_driver(spark):
    """the plan that runs broadcasts one row, however small its shuffles are."""
    docs = spark.createDataFrame([(1, "quick brown quick brown quickbrownquickbrown"), (2, "brown quick")], "id long, text string")
    out = glued.deglued(docs, glued.word_costs(docs), "id")
    assert {r.id: r.text for r in out.collect()} == {1: "quick brown quick brown quick brown quick brown", 2: "brown quick"}
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == 0
