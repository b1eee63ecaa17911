"""Sketches of loads merge to those of all rows, within their error; exact quantiles are those of numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import sketches
from foliant.plans.catalog import QUERIES

DATA = "/root/testdata/sf0.01"


def test_loads_merge_and_a_load_that_comes_again_counts_once(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 7000).alias("k"), F.sqrt("id").alias("x"))
    path = f"file://{tmp_path}/s"
    for i in (0, 1, 2, 1):
        load = rows.where(F.floor(F.col("x") * 10) % 3 == i)
        sketches.keep(sketches.sketched(load, ["g"], ["k"], ["x"]), path, str(i))
    what = (["k"], ["x"])
    got = sketches.estimates(sketches.merged(sketches.kept(spark, path), ["g"], *what), ["g"], *what).collect()
    one = {r.g: r for r in sketches.estimates(sketches.sketched(rows, ["g"], *what), ["g"], *what).collect()}
    x = {g: np.sqrt(np.arange(g, 60_000, 2)) for g in (0, 1)}
    for r in got:
        assert r.n == one[r.g].n == 30_000 and (r.x_least, r.x_most) == (x[r.g][0], x[r.g][-1])
        assert r.distinct_k == one[r.g].distinct_k and abs(r.distinct_k - 3500) < 0.03 * 3500
        assert r.x_mean == pytest.approx(x[r.g].mean())
        assert abs((x[r.g] < r.x_quantile).mean() - 0.5) < 0.01
    (all_rows,) = sketches.estimates(sketches.merged(sketches.kept(spark, path), [], *what), [], *what).collect()
    assert all_rows.n == 60_000 and abs(all_rows.distinct_k - 7000) < 0.03 * 7000


def test_odd_columns(spark):
    odd = spark.createDataFrame([(1, None, None), (1, None, float("nan"))], "g int, k string, x double")
    (r,) = sketches.estimates(sketches.sketched(odd, ["g"], ["k"], ["x"]), ["g"], ["k"], ["x"]).collect()
    assert (r.n, r.distinct_k, r.x_mean, r.x_least, r.x_quantile) == (2, 0, None, None, None)
    assert sketches.exact_quantiles(odd, "x", [0.5]) == [None]
    assert sketches.sketched(odd.limit(0), ["g"], ["k"], ["x"]).count() == 0


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_are_exact(spark, few, monkeypatch):
    monkeypatch.setattr(sketches, "FEW", few)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=4000), np.full(3000, 0.25), rng.integers(0, 5, 1001)])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    asked = [0.0, 0.37, 0.5, 1.0]
    assert sketches.exact_quantiles(rows, "x", asked) == pytest.approx(np.quantile(x, asked).tolist(), abs=1e-12)


def test_quantiles_between_two_frequent_values(spark, monkeypatch):
    monkeypatch.setattr(sketches, "FEW", 3)
    x = np.concatenate([np.zeros(4980), np.linspace(0.1, 0.9, 60), np.ones(4961)])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    asked = [0.4, 0.5, 0.5035, 0.7]
    assert sketches.exact_quantiles(rows, "x", asked) == pytest.approx(np.quantile(x, asked).tolist(), abs=1e-12)


def test_merged_profile_of_sales_lines(spark):
    lines = spark.read.parquet(f"{DATA}/sale_lines.parquet")
    want = {r.flag: r for r in lines.groupBy("flag").agg(F.count("*").alias("n"), F.count_distinct("sale_id").alias("d"), F.avg(F.nanvl("amount", F.lit(None).cast("double"))).alias("mean")).collect()}
    got = {r.flag: r for r in QUERIES["a02_merged_profile"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.n == want[k].n and r.amount_mean == pytest.approx(want[k].mean) and abs(r.distinct_sale_id - want[k].d) <= 0.03 * want[k].d + 1
