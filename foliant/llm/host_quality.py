"""Quality rules with host verdicts.

Each document is measured by expressions over its words and lines. Failures of each rule (few or repeated words, many
symbols, repeated lines) are summed by host; a host's rate is shrunk with a beta prior fitted to all hosts' rates of that rule by
moments, so a host of few documents is judged mostly by what hosts are like. A host with a shrunk rate above ``max_rate`` is
rejected, and its verdict is joined back to its documents.

Measures are a written table of numbers, so texts are read once and never shuffled. Failures are summed
before the shuffle; a host with a third of all documents is one row on its side of the join back, and its
documents on the other side are split by adaptive execution. The driver sees three sums.

A repeated five-word window is found by a document's window hashes (64 bits): where two are equal, they are sorted next to their places, which
takes n log n for a document of n words. Null and empty texts have no words and fail the base rule. A null host
is a host of its own. Repeated rows each count and each get a row. An empty table gives an empty result; columns other than id, host
and text aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import text_of, written
from foliant.session import spread

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
RUN = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Symbols for a hundred words, and repeated lines of a hundred, beyond which a document fails those rules.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30
#: Rules whose failures are summed by host. A document is dropped by itself for the first alone.
RULES = ("base", "symbols", "lines")


def _hashes(words: Column) -> Column:
    """A hash for each window of ``words``, a column of words, by place."""
    at = F.sequence(F.lit(0), F.size(words) - RUN)
    hashed = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(RUN))))
    return F.when(F.size(words) > RUN, hashed)


def _sorted(hashes: Column) -> Column:
    """Hashes with their places, ascending, if two of them are equal: most texts need no sort."""
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(placed))


def measures(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The base measures of each row of ``docs``, with ``key`` and ``host``, and ``base_failed``."""
    content = text_of(text)
    words = F.array_remove(F.split(content, SPACE), "")
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one = spread(docs.select(key, host, text)).select(
        F.col(key),
        F.col(host).alias("host"),
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count(content, F.lit(SYMBOLS)).cast("long").alias("n_symbols")
    )
    two = one.select(
        key,
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _hashes(F.col("words")).alias("hashes"),
    ).withColumn("windows", _sorted(F.col("hashes"))).drop("hashes")
    # One walk over the sorted windows keeps the places of those whose hash stands next to an equal one.
    first = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("at"))
    twice = F.zip_with(
        F.concat(F.array(first), "windows"),
        F.concat("windows", F.array(first)),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"]))
    )
    three = two.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))).drop("windows")
    covered = F.aggregate(
        "places",
        F.struct(F.lit(-RUN).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(RUN), x - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )
    four = three.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")
    dup_lines = 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines")
    return four.withColumns({"base_failed": failed, "symbols_failed": symbols, "lines_failed": dup_lines})


def priors(hosts: DataFrame, rules: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Alpha and beta of hosts' failure rates for each rule by moments, from ``hosts(n, *rules)``; (1, 1) where rates can't be compared."""
    # Hosts are weighed alike, and the spread that n draws give by chance is taken off. One pass for all rules.
    rate = {r: F.col(r) / F.col("n") for r in rules}
    sums = [x for r in rules for x in (F.avg(rate[r]).alias(f"mean_{r}"), F.var_samp(rate[r]).alias(f"var_{r}"))]
    row = hosts.agg(F.avg(1 / F.col("n")).alias("inv"), *sums).first()
    return {r: _beta(row[f"mean_{r}"], row[f"var_{r}"], row["inv"]) for r in rules}


def _beta(mean: float | None, var: float | None, inv: float | None) -> tuple[float, float]:
    if var is None:
        return 1.0, 1.0
    chance = mean * (1 - mean)
    spread = (var - chance * inv) / max(1 - inv, 1e-9)
    # Where hosts differ by chance alone, all of them together speak for each.
    strength = 1000.0 if chance <= 0 or spread <= 0 else min(max(chance / spread - 1, 1e-3), 1000.0)
    return max(mean * strength, 1e-6), max((1 - mean) * strength, 1e-6)


def host_verdicts(rows: DataFrame, max_rate: float = 0.5, rules: Sequence[str] = RULES) -> DataFrame:
    """``host``, ``n``, each rule's failures and shrunk rate (``<rule>_rate``), the greatest ``rate`` and ``host_ok`` from ``measures``."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(f"{r}_failed").alias(r) for r in rules))
    rates = {r: (F.col(r) + a) / (F.col("n") + (a + b)) for r, (a, b) in priors(hosts, rules).items()}
    judged = hosts.withColumns({f"{r}_rate": rate for r, rate in rates.items()})
    return judged.withColumn("rate", F.greatest(*(f"{r}_rate" for r in rules), F.lit(0.0))).withColumn("host_ok", F.col("rate") <= max_rate)


def judge_documents(
    docs: DataFrame,
    max_rate: float = 0.5,
    key: str = "doc_id",
    host: str = "source",
    text: str = "text",
    rules: Sequence[str] = RULES
) -> DataFrame:
    """Measures, each rule's failure, the host's greatest shrunk rate as ``host_rate``, and ``kept``: not where the base rule fails, nor where the
    host fails any rule too often."""
    rows = written(measures(docs, key, host, text), "measures")
    hosts = host_verdicts(rows, max_rate, rules).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "host_ok")
    joined = rows.join(hosts, rows["host"].eqNullSafe(hosts["__host"]))
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("__host", "host_ok")
