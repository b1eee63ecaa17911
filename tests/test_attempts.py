"""Batches against a service with limits: what is tried again, what is given up, and that the source is only read."""

import pytest
from pyspark.sql import functions as F

from foliant.streaming import incremental


def test_time_outs_wait_beside_the_checkpoint(spark, tmp_path):
    src, mark, done = f"{tmp_path}/src", f"{tmp_path}/mark", []
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(src)
    bad, quota = {0, 10}, []

    def load(batch, number):
        first = batch.agg(F.min("id")).first()[0]
        if first in quota:
            raise incremental.QuotaSpent("429")
        if first in bad:
            raise incremental.TimedOut("slow")
        done.append(first)

    def run():
        return incremental.run_batches(spark, src, "id long", load, mark)

    assert run() == {"done": 1, "skipped": 2, "dead": 0, "quota": False}
    assert sorted(tuple(r) for r in incremental.attempts(spark, mark).select("attempts", "outcome").collect()) == [(1, "timeout")] * 2
    bad.discard(10)
    assert run() == {"done": 1, "skipped": 1, "dead": 0, "quota": False}
    quota.append(0)  # the run ends, and that is no attempt
    assert run() == {"done": 0, "skipped": 0, "dead": 0, "quota": True}
    quota.clear()
    assert run() == {"done": 0, "skipped": 1, "dead": 1, "quota": False}
    assert run() == {"done": 0, "skipped": 0, "dead": 0, "quota": False}
    assert sorted(done) == [10, 20] and spark.read.parquet(src).count() == 30
    assert sorted(r.id for r in incremental.dead_letters(spark, mark, "id long").collect()) == list(range(10))
    assert sorted(tuple(r) for r in incremental.attempts(spark, mark).select("attempts", "outcome").collect()) == [(2, "done"), (3, "dead")]

    def broken(batch, number):
        raise KeyError("a bug")

    spark.range(40, 41).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="a bug"):
        incremental.run_batches(spark, src, "id long", broken, mark)
