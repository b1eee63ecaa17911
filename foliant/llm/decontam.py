"""Benchmark decontamination by a prefix-filtered set join.

An item is all its windows of 13 consecutive words (an item of fewer words is one window), and a window is
the set of its shingles of three words. A document holds a window only if it holds every shingle of it, so the
window's rarest shingle is a sufficient prefix: shingles are ordered by their count over all documents, each
window is joined on its rarest one, the join's place fixes where the window would begin, windows that would
begin before the document or end behind it are dropped, and the words of the rest are compared one by one.

All steps are DataFrame expressions. All texts are read once for their shingles that items have, in place, into a written table of places;
what follows goes by text, so copies of one are judged once. Only texts with a prefix shingle are read again, and their candidates
carry only the words around them. No text is shuffled while there are at most ``max_broadcast`` shingles, which are sent to all executors;
beyond that shingles are joined by a shuffle, and so are the texts of candidates where those are many. Texts are told apart by MD5.

Words are runs of letters and digits and all beyond ASCII, with A-Z in lower case. Null or empty texts have no
words and aren't contaminated; an item without words is no item. A null item id counts as the empty string.
Columns named like results are replaced. Repeated documents each get a row; empty tables give an empty result, or one without hits. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import digest_of, fits, passing, text_of, written
from foliant.session import spread

WINDOW, GRAM = 13, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All of ASCII but digits and small letters.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), BETWEEN_WORDS), "")


def _gram(words: Column, i: Column, n: int) -> Column:
    """The hash of ``n`` words from place ``i``; near the end it has fewer, and the bounds drop it."""
    return F.xxhash64(F.lit(n), *(F.get(words, i + k) for k in range(n)))


def _grams(words: Column, sizes: list[int]) -> Column:
    """(place, hash) of each place and size of shingle."""

    def of(n: int) -> Column:
        return F.transform(words, lambda w, i: F.struct(i.alias("at"), _gram(words, i, n).alias("gram")))

    each = [of(n) for n in sizes]
    return each[0] if len(each) == 1 else F.concat(*each)


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``words``, ``n`` (their number), ``size`` (of shingle) and the ``items`` that have them."""
    rows = items.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(text_of(text)).alias("all")
    ).where(F.size("all") > 0)
    n = F.least(F.size("all"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("all") - n + 1)
    each = rows.select("item", n.alias("n"), F.explode(F.transform(starts, lambda s: F.slice("all", s, n))).alias("words"))
    return each.groupBy("words").agg(
        F.first("n").alias("n"), F.collect_set("item").alias("items")
    ).withColumn("size", F.least("n", F.lit(GRAM)))


def find_windows(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, max_broadcast: int = 100_000
) -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``n_hit`` (words inside a window), and ``hit_items`` (sorted).

    Up to ``max_broadcast`` shingles, of windows of ``BROADCAST_BYTES`` with the items that have them, are sent to all executors."""
    with passing(docs.sparkSession) as at:
        return _found(docs, items, text, item, window, max_broadcast, at)


def _found(docs: DataFrame, items: DataFrame, text: str, item: str, window: int, max_broadcast: int, at: list[str]) -> DataFrame:
    size = 128 * window * (items.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    windows = written(item_windows(items, item, text, window), "windows", at, size)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # three values at most
    kept = [c for c in docs.columns if c not in (text, "n_words", "n_hit", "hit_items")]
    content = F.col(f"`{text}`")
    own = spread(docs).select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"),
        digest_of(content).alias("digest"),
        words_of(F.coalesce(content, F.lit(""))).alias("words")
    )
    if not sizes:
        return own.select(
            "doc.*",
            F.size("words").cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("hit_items")
        )

    parts = windows.select("words", "n", "items", "size", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))).alias("offset"))
    gram = F.when(F.col("size") == sizes[0], _gram(F.col("words"), F.col("offset"), sizes[0]))
    for n in sizes[1:]:
        gram = gram.when(F.col("size") == n, _gram(F.col("words"), F.col("offset"), n))
    parts = written(parts.withColumn("gram", gram), "shingles", at)
    few = parts.count() <= max_broadcast and fits(windows)
    sent = F.broadcast if few else (lambda df: df)

    # One pass over all texts: where a shingle of an item stands. Rows keep their own columns; the rest goes by text.
    known, grams = parts.select("gram").distinct(), _grams(F.col("words"), sizes)
    if few:
        listed = ", ".join(f"{r[0]}L" for r in known.collect())  # at most max_broadcast; as text, as a column each takes seconds
        cut = own.select("doc", "digest", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))
        rows = written(cut.select("doc", "digest", "n_words", F.expr(f"filter(grams, g -> g.gram IN ({listed}))").alias("hits")), "seen")
        spots = rows.select("digest", F.explode("hits").alias("h")).select("digest", "h.at", "h.gram")
    else:
        rows = written(own.select("doc", "digest", F.size("words").cast("long").alias("n_words")), "seen")
        every = own.select("digest", F.explode(grams).alias("h")).select("digest", "h.at", "h.gram")
        spots = written(every.join(known, "gram").distinct(), "spots", at)

    # Each window under its rarest shingle; a window with a shingle that no document has is in none.
    counts = spots.groupBy("gram").count()
    rarest = parts.join(counts, "gram", "left").groupBy("words").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "gram")).alias("p"),
        F.first("n").alias("n"),
        F.first("items").alias("items")
    )
    prefixes = written(
        rarest.where("p.count > 0").select("p.gram", "p.offset", F.col("words").alias("window"), "n", "items"), "prefixes", at, size
    )

    # Texts with such a shingle are read again, by digest; its places carry only the words around them.
    places = spots.join(sent(prefixes.select("gram").distinct()), "gram").groupBy("digest").agg(
        F.collect_set(F.struct("at", "gram")).alias("places")
    )
    places = written(places, "places", at)
    wanted = F.broadcast(places) if fits(places) else places.hint("rebalance")
    texts = spread(docs.select(content.alias("__text"))).select(
        digest_of(F.col("__text")).alias("digest"), "__text"
    ).join(wanted, "digest").select(
        "digest", words_of(F.col("__text")).alias("words"), "places"
    )
    around = 2 * window - 1

    def context(words: Column, place: Column) -> Column:
        low = F.greatest(place - (window - 1), F.lit(0))
        return F.struct(place.alias("at"), low.alias("low"), F.slice(words, low + 1, around).alias("near"))

    each = F.explode(F.transform("places", lambda g: F.struct(g["gram"].alias("gram"), context(F.col("words"), g["at"]).alias("c"))))
    joined = texts.select(
        "digest", F.size("words").alias("n_words"), each.alias("g")
    ).select("digest", "n_words", "g.gram", "g.c").join(sent(prefixes), "gram")
    start = F.col("c.at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice(F.col("c.near"), F.greatest(start - F.col("c.low") + 1, F.lit(1)), F.col("n")) == F.col("window")
    found = joined.where(inside & same).select(
        "digest", F.struct(start.alias("start"), (start + F.col("n")).alias("end")).alias("hit"), "items"
    )
    by_text = found.groupBy("digest").agg(
        F.sort_array(F.collect_set("hit")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["sum"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("sum")),
        lambda a: a["sum"],
    )
    judged = written(by_text.select("digest", covered.alias("n_hit"), "hit_items"), "judged", size=128 * places.count())
    # Rows of a hot text are split where verdicts aren't sent to all.
    verdicts = F.broadcast(judged) if fits(judged) else judged.hint("rebalance")
    none = F.array().cast("array<string>")
    return rows.join(verdicts, "digest", "left").select(
        "doc.*",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("hit_items", none).alias("hit_items")
    )


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """The rule of contamination: a twentieth of the words at least."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
