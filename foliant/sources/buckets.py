"""Tables in hash buckets of a key, changed by small commits: a change rewrites the buckets it touches, an append none.

``data`` holds parts, each the rows of one bucket from one write; parts never change. ``commits`` holds a small file for each change, with the parts it adds and
removes; it gets its name, which no other has, by one rename, so a change is there whole or not at all, and appends of any number of writers never
collide. What the table is, is the fold of its commits by name; a commit that removes what an earlier one has removed is void, and its writer is told.
Readers go on with the parts they have listed until ``vacuum`` deletes those that no commit names any more.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "name STRING, removed ARRAY<STRING>, added ARRAY<STRING>, included ARRAY<STRING>"


class Conflict(RuntimeError):
    """Another writer has replaced the same parts."""


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _bucket_of(part: str) -> int:
    return int(part.rpartition("=")[2])


@dataclass(frozen=True)
class BucketTable:
    """A table in the folder ``path``; ``key`` is a column, ``order`` the columns that deal a key's rows over files."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    order: tuple[str, ...] = ()
    buckets: int = 64

    # ------------------------------------------------------------------ commits

    def create(self) -> bool:
        """Makes the table where there is none; whether it did."""
        at, store = _place(self.spark, f"{self.path}/commits")
        return bool(store.mkdirs(at)) if not store.exists(at) else False

    def exists(self) -> bool:
        at, store = _place(self.spark, f"{self.path}/commits")
        return bool(store.exists(at))

    def _commits(self) -> list:
        """All commits by name: few since the last ``compact``. One that goes after it was listed was included long ago; the list is made again."""
        at, store = _place(self.spark, f"{self.path}/commits")
        for tries in range(5):
            names = [str(x.getPath()) for x in store.listStatus(at) if x.getPath().getName().endswith(".json")]
            try:
                return sorted(self.spark.read.schema(COMMIT).json(names).collect()) if names else []
            except (PySparkException, Py4JError):
                if tries == 4:
                    raise
        return []

    def parts(self, upto: str | None = None) -> list[str]:
        """The parts there are, or were after the commit ``upto``."""
        return self._fold([c for c in self._commits() if upto is None or c.name <= upto])

    def _fold(self, commits: Sequence) -> list[str]:
        whole = max((c for c in commits if c.included is not None), default=None)
        found = dict.fromkeys(whole.added) if whole else {}
        for c in commits:
            if c.included is not None or (whole and c.name in whole.included):
                continue
            if all(p in found for p in c.removed):
                for p in c.removed:
                    del found[p]
                found |= dict.fromkeys(c.added)
        return list(found)

    def commit(self, added: Sequence[str], removed: Sequence[str] = (), included: Sequence[str] | None = None) -> str:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        told = {"name": name, "removed": list(removed), "added": list(added)} | ({} if included is None else {"included": list(included)})
        side, store = _place(self.spark, f"{self.path}/commits/.{name}")
        out = store.create(side, True)
        try:
            out.write((json.dumps(told) + "\n").encode())
        finally:
            out.close()
        store.rename(side, _place(self.spark, f"{self.path}/commits/{name}.json")[0])
        if removed and added and not {*added} <= {*self.parts()}:
            raise Conflict(f"{self.path}: parts were replaced by another writer meanwhile")
        return name

    # ------------------------------------------------------------------ rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def bucket_of(self, value: str) -> int:
        """The bucket of a key; a value is hashed as the column's rows are."""
        return self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(self.buckets))).first()[0]

    def read(self, only: Iterable[int] | None = None, upto: str | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """All rows, or those of some buckets, now or after the commit ``upto``."""
        found = self.parts(upto) if parts is None else parts
        if only is not None:
            wanted = {*only}
            found = [p for p in found if _bucket_of(p) in wanted]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{p}" for p in found))

    def write(self, rows: DataFrame) -> list[str]:
        """Rows as new parts, which belong to the table once they are committed. A bucket, however large, is as many files as its rows need."""
        load = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).columns
        dealt = rows.select(*columns).withColumn("bucket", self.bucket()).repartitionByRange("bucket", self.key, *self.order)
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/data/{load}")
        at, store = _place(self.spark, f"{self.path}/data/{load}")
        return [f"{load}/{x.getPath().getName()}" for x in store.listStatus(at) if x.isDirectory()]

    def append(self, rows: DataFrame) -> str:
        return self.commit(self.write(rows))

    def _rewritten(self, hit: Sequence[int], kept: DataFrame, parts: Sequence[str], rows: DataFrame | None = None) -> str:
        own = [p for p in parts if _bucket_of(p) in {*hit}]
        return self.commit(self.write(kept if rows is None else kept.unionByName(rows)), own)

    def upsert(self, rows: DataFrame) -> list[int]:
        """``rows`` take the place of all rows that have one of their keys; the buckets that were rewritten. ``rows`` are read more than once."""
        parts = self.parts()
        keys = rows.select(self.key).distinct()
        stored = self.read(parts=parts)
        hit = [r[0] for r in stored.join(keys, self.key, "left_semi").select(self.bucket().alias("bucket")).distinct().collect()]
        if not hit:
            self.append(rows)
            return []
        kept = self.read(hit, parts=parts).join(keys, self.key, "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        self._rewritten(hit, kept.select(*columns), parts, rows.select(*columns))
        return sorted(hit)

    def delete_where(self, condition: Column) -> int:
        """Drops the rows for which the condition holds (a null keeps a row); how many. Buckets without such a row stay as they are."""
        parts, gone = self.parts(), F.coalesce(condition, F.lit(False))
        found = self.read(parts=parts).where(gone).groupBy(self.bucket().alias("bucket")).agg(F.count("*").alias("n")).collect()
        if found:
            hit = [r.bucket for r in found]
            self._rewritten(hit, self.read(hit, parts=parts).where(~gone), parts)
        return sum(r.n for r in found)

    def clear(self) -> None:
        if parts := self.parts():
            self.commit([], parts)

    # ------------------------------------------------------------------ upkeep

    def compact(self, most: int = 8) -> None:
        """Rewrites buckets of more than ``most`` parts, and folds all commits into one. Those that it includes go with the next call, so that who has listed
        them can still read them."""
        parts = self.parts()
        counts: dict[int, int] = {}
        for p in parts:
            counts[_bucket_of(p)] = counts.get(_bucket_of(p), 0) + 1
        if many := [b for b, n in counts.items() if n > most]:
            self._rewritten(many, self.read(many, parts=parts), parts)
        # Commits that come while this runs aren't among the included ones, and stay.
        commits = self._commits()
        last = max((c for c in commits if c.included is not None), default=None)
        self.commit(self._fold(commits), included=[c.name for c in commits])
        for name in last.included if last else ():
            at, store = _place(self.spark, f"{self.path}/commits/{name}.json")
            store.delete(at, False)

    def vacuum(self, older_than: float = 7 * 86_400) -> int:
        """Deletes loads of which no part is named any more and that were written over ``older_than`` seconds ago; how many."""
        at, store = _place(self.spark, f"{self.path}/data")
        if not store.exists(at):
            return 0
        named, gone = {p.split("/")[0] for p in self.parts()}, 0
        for x in store.listStatus(at):
            if x.getPath().getName() not in named and x.getModificationTime() <= (time.time() - older_than) * 1000:
                gone += bool(store.delete(x.getPath(), True))
        return gone
