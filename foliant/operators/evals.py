"""Evaluation: eligible rows, metric means, test-retest, drift, ranked precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that aren't scored.
UNSCORED = ("subjective_gate", "subjective_gate_bypass", "not_found_structural", "not_found_fictional", "off_topic", "edge_case_garbled")
SEPARATOR = "\n---CHUNK---\n"


def eligible(rows: DataFrame, only_ok: bool = False, only_resolved: bool = False) -> DataFrame:
    """P13."""
    keep = ~F.coalesce(F.col("category"), F.lit("")).isin(*UNSCORED) & (
        F.coalesce(F.col("ground_truth_answer"), F.lit("")) != ""
    ) & (
        F.coalesce(F.col("confidence_flag"), F.lit("")) != "generation_error"
    )
    if only_ok:
        keep = keep & (F.col("confidence_flag") == "ok")
    if only_resolved:
        keep = keep & (F.coalesce(F.col("resolved_company"), F.lit("")) != "")
    return rows.where(keep)


def complete(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Every metric is there; NaN counts as missing."""
    return scores.dropna(how="any", subset=list(metrics))


def means(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """A18."""
    return scores.agg(*(F.avg(_number(m)).alias(m) for m in metrics))


def _number(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def test_retest(a: DataFrame, b: DataFrame, metrics: Sequence[str], key: str = "id", midpoint: float = 0.5) -> DataFrame:
    """Per metric over rows that both runs scored. No correlation where a run doesn't vary."""
    one = a.select(key, *(_number(m).alias(m) for m in metrics)).unpivot(key, list(metrics), "metric", "a")
    two = b.select(key, *(_number(m).alias(m) for m in metrics)).unpivot(key, list(metrics), "metric", "b")
    pairs = one.join(two, [key, "metric"]).where("a IS NOT NULL AND b IS NOT NULL")
    d = F.abs(F.col("a") - F.col("b"))
    flips = ((F.col("a") >= midpoint) != (F.col("b") >= midpoint)).cast("double")
    agg = pairs.groupBy("metric").agg(
        F.count("*").alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(d).alias("mad"),
        F.max(d).alias("max_diff"),
        F.covar_pop("a", "b").alias("cov"),
        F.stddev_pop("a").alias("sa"),
        F.stddev_pop("b").alias("sb"),
        F.avg(flips).alias("flip_rate")
    )
    r = F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("cov") / (F.col("sa") * F.col("sb")))
    return agg.select(
        "metric",
        "n",
        "mean_a",
        "mean_b",
        (F.col("mean_b") - F.col("mean_a")).alias("shift"),
        "mad",
        "max_diff",
        r.alias("r"),
        "flip_rate"
    )


def row_drift(a: DataFrame, b: DataFrame, metrics: Sequence[str], key: str = "id", limit: int = 8) -> DataFrame:
    """Rows by the sum of their changes; a missing metric changes nothing."""
    left, right = a.select(
        key, *(_number(m).alias(f"a_{m}") for m in metrics)
    ), b.select(key, *(_number(m).alias(f"b_{m}") for m in metrics))
    drift = sum((F.coalesce(F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")), F.lit(0.0)) for m in metrics), F.lit(0.0))
    return left.join(right, key).select(key, drift.alias("drift")).orderBy(F.col("drift").desc(), key).limit(limit)


def average_precision(verdicts: Column) -> Column:
    """Over verdicts (0 or 1) by rank."""
    hits = F.transform(verdicts, lambda v, i: v * F.aggregate(F.slice(verdicts, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x) / (i + 1))
    return F.aggregate(hits, F.lit(0.0), lambda s, x: s + x) / (F.aggregate(verdicts, F.lit(0.0), lambda s, x: s + x) + 1e-10)


def joined_contexts(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Chunks as one string, in order."""
    return rows.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda s: s[content]), SEPARATOR
        ).alias("contexts")
    )


def split_contexts(contexts: Column) -> Column:
    return F.split(contexts, SEPARATOR)


def tagged(rows: DataFrame, run_tag: str | Column) -> DataFrame:
    """Results of a run carry its tag, which partitions what is stored; no tag is the empty one."""
    tag = F.lit(run_tag) if isinstance(run_tag, str) else run_tag
    return rows.withColumn("run_tag", F.coalesce(tag, F.lit("")))
