"""Corpus analytics: defects, histograms, inventories, shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.sketches import exact_quantiles

CHARS_PER_TOKEN = 4.0


def has_cid(c: Column) -> Column:
    """P04."""
    return c.contains("(cid:")


def no_english(c: Column) -> Column:
    """Long, and without three common words."""
    return (F.length(c) > 1000) & ~c.contains(" the ") & ~c.contains(" and ") & ~c.contains(" of ")


def is_bad(c: Column) -> Column:
    """P06."""
    return has_cid(c) | no_english(c)


def few_letters(c: Column, least: float = 0.55) -> Column:
    """P07."""
    letters = F.length(F.regexp_replace(c, "[^A-Za-z ]", ""))
    return (F.length(c) > 500) & ~has_cid(c) & (letters < least * F.length(c))


def length_histogram(rows: DataFrame, content: str = "content", low: int = 0, high: int = 20_000, buckets: int = 10) -> DataFrame:
    """Bucket 0 lies below ``low``, ``buckets`` + 1 from ``high`` on."""
    n = F.length(content)
    b = F.width_bucket(n.cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return rows.groupBy(b.cast("long").alias("bucket")).agg(
        F.count("*").alias("n"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest")
    )


def shares(rows: DataFrame, predicates: Mapping[str, Column], content: str = "content") -> DataFrame:
    """Per predicate the rows and characters it holds for, with percentages: one pass for all of them."""
    n = F.length(content)
    one = rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(n), F.lit(0)).alias("chars"),
        *(
            x for k, p in predicates.items() for x in (
                F.count_if(p).alias(f"{k}_rows"), F.coalesce(F.sum(F.when(p, n)), F.lit(0)).alias(f"{k}_chars")
            )
        )
    )
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(k).alias("name"), F.col(f"{k}_rows").alias("n"), F.col(f"{k}_chars").alias("n_chars")
                ) for k in predicates
            )
        )
    )
    flat = one.select("rows", "chars", each.alias("s")).select("s.*", "rows", "chars")
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0)), 4)
    return flat.select("name", "n", "n_chars", pct("n", "rows").alias("pct_rows"), pct("n_chars", "chars").alias("pct_chars"))


def worst_documents(rows: DataFrame, bad: Column, keys: Sequence[str], content: str = "content", limit: int = 25) -> DataFrame:
    """A10: documents by their bad rows."""
    found = rows.where(bad).groupBy(*keys).agg(F.count("*").alias("n_bad"), F.sum(F.length(content)).alias("n_chars"))
    return found.orderBy(F.col("n_bad").desc(), *keys).limit(limit)


def all_bad_documents(rows: DataFrame, bad: Column, keys: Sequence[str]) -> DataFrame:
    """Documents without one good row."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(bad, F.lit(False))).alias("good")
    ).where("good = 0").select(*keys, "n")


def inventory(rows: DataFrame, keys: Sequence[str], newest: str, nullable: str) -> DataFrame:
    """A04."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max(newest).alias(f"max_{newest}"),
        F.bool_or(F.col(nullable).isNull()).alias(f"any_null_{nullable}")
    )


def distinct_counts(rows: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """A01, A02."""
    f = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(F.count("*").alias("n"), *(f(c).alias(f"distinct_{c}") for c in columns))


def distinct_per(rows: DataFrame, key: str, value: str) -> DataFrame:
    """A05."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias(f"distinct_{value}"))


def top_values(rows: DataFrame, key: str, limit: int = 12) -> DataFrame:
    """A06."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(key).asc_nulls_last()).limit(limit)


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P09."""
    return rows.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns),
        *(F.count_if(F.col(c).isNotNull()).alias(f"set_{c}") for c in columns)
    )


def first_letters(rows: DataFrame, column: str) -> DataFrame:
    """A12."""
    return rows.groupBy(
        F.upper(F.substring(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("?")), 1, 1)).alias("letter")
    ).agg(F.count("*").alias("n"))


def statistics(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column; the median is interpolated, and exact without one task that sees all distinct values."""
    medians = {c: exact_quantiles(rows, c, [0.5])[0] for c in columns}
    each = [
        rows.agg(
            F.lit(c).alias("name"),
            F.sum(c).cast("double").alias("total"),
            F.avg(c).alias("mean"),
            F.lit(medians[c]).cast("double").alias("median"),
            F.min(c).cast("double").alias("least"),
            F.max(c).cast("double").alias("most")
        ) for c in columns
    ]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def token_risk(
    chunks: DataFrame,
    wanted: DataFrame,
    keys: Sequence[str],
    content: str = "content",
    key: str = "id",
    k: int = 5,
    cap: int | None = None,
    most: int = 60_000
) -> DataFrame:
    """Per wanted filter the characters of its ``k`` longest chunks, as tokens, and whether that is too much."""
    rows = chunks.where(F.length(content) < cap) if cap else chunks
    near = rows.select(*keys, key, F.length(content).alias("len")).join(wanted.select(*keys).distinct(), list(keys))  # lengths cross the network, no texts
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("len").desc(), key))).where(F.col("r") <= k)
    return ranked.groupBy(*keys).agg(F.sum("len").alias("chars")).select(
        *keys, "chars", (F.col("chars") / CHARS_PER_TOKEN).alias("tokens"), (F.col("chars") > most).alias("risky")
    )


def densest(chunks: DataFrame, keys: Sequence[str], density: str, key: str) -> DataFrame:
    """The row of highest density in each group; no density comes last, ties go by key."""
    w = Window.partitionBy(*keys).orderBy(F.col(density).desc_nulls_last(), key)
    return chunks.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def bad_by_key(wanted: DataFrame, chunks: DataFrame, bad: Column, keys: Sequence[str]) -> DataFrame:
    """Wanted groups with their bad chunks, 0 for none: one aggregate and a join for all of them."""
    counts = chunks.where(bad).groupBy(*keys).agg(F.count("*").alias("n_bad"))
    return wanted.join(counts, list(keys), "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0).cast("long")))


def quarantined(chunks: DataFrame, bad: Column) -> DataFrame:
    """S17's rows that stay: a predicate that is null drops nothing."""
    return chunks.where(~F.coalesce(bad, F.lit(False)))
