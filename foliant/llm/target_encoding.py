"""Target encoding in time order: for each row, how often the target was hit by earlier rows that share a value with it.

Every row is listed once for each level (a column, or all rows). The list is parted by ranges of level, value, time and the row's own id, so no
value, however hot, is one task, and the level of all rows is a value like any other. Running sums are taken within each part; the driver
carries some numbers from part to part (the sums of the value, and of the moment, at which a part ends), and a second pass adds them.
Rows of one moment don't see each other, and a row sees no row of its own fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import written
from foliant.session import ship

FOLDS, SCALE, WEIGHT, START = 5, 1_000_000, 50, 500_000
#: Levels, parents before children.
ALL, KIND, NATION, SEGMENT, ITEM, VENDOR, CLIENT = range(7)
#: What a row of the first pass is: of a history, or one of the four that tell a part's ends.
ROW, FIRST, LAST, VALUE_SUMS, MOMENT_SUMS = range(5)
#: Stands for a missing vendor_id while rows are listed, and for a kind, nation or segment that is missing or of an unknown id.
NONE = -(1 << 63)
HISTORY = (
    "part int, what byte, level int, fold int, a long, b long, c long, opens boolean, ties boolean, lines long, hits long, n long, s long"
)


class _Sums:
    """Running sums over the rows of a part, by fold, and where the value and the moment of the last row began."""

    def __init__(self, folds: int) -> None:
        self.folds, self.first, self.last = folds, None, None
        # Sums before: the next row, the first row of the last one's value, and the first of its moment. By fold; rows and hits.
        self.now = np.zeros((2, folds + 1), np.int64)
        self.value, self.moment = self.now.copy(), self.now.copy()

    def add(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row whether it is of the part's first value and first moment, and rows and hits of other folds before its moment."""
        level, value, moment, fold = (rows[c].to_numpy() for c in ("level", "value", "moment", "fold"))
        size = len(rows)
        news, turns = np.ones(size, bool), np.ones(size, bool)
        news[1:] = (level[1:] != level[:-1]) | (value[1:] != value[:-1])
        turns[1:] = news[1:] | (moment[1:] != moment[:-1])
        here = (int(level[0]), int(value[0]), int(moment[0]))
        if self.last is None:
            self.first = here
        else:
            news[0], turns[0] = here[:2] != self.last[:2], here != self.last
        # Sums before each row, and one more; the last line is that of all folds.
        before = np.zeros((2, self.folds + 1, size + 1), np.int64)
        for i, c in enumerate(("lines", "hits")):
            own = rows[c].to_numpy()
            for f in range(self.folds):
                np.cumsum(np.where(fold == f, own, 0), out=before[i, f, 1:])
            np.cumsum(own, out=before[i, self.folds, 1:])
        before += self.now[:, :, None]
        # Where the value and the moment of each row began; -1: in an earlier batch.
        places = np.arange(size)
        starts = np.maximum.accumulate(np.where(news, places, -1))
        tied = np.maximum.accumulate(np.where(turns, places, -1))
        every, found = self.folds, []
        for i in range(2):
            sums = 0
            for line, sign in ((np.full(size, every), 1), (fold, -1)):
                at_tie = np.where(tied >= 0, before[i, line, tied], self.moment[i, line])
                at_start = np.where(starts >= 0, before[i, line, starts], self.value[i, line])
                sums = sums + sign * (at_tie - at_start)
            found.append(sums)
        opens = (level == self.first[0]) & (value == self.first[1])
        ties = opens & (moment == self.first[2])
        if starts[-1] >= 0:
            self.value = before[:, :, starts[-1]].copy()
        if tied[-1] >= 0:
            self.moment = before[:, :, tied[-1]].copy()
        self.now = before[:, :, size].copy()
        self.last = (int(level[-1]), int(value[-1]), int(moment[-1]))
        return opens, ties, found[0], found[1]


def _first_pass(folds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), _Sums(folds)
        for rows in batches:
            if not len(rows):
                continue
            opens, ties, n, s = sums.add(rows)
            out = {c: rows[c] for c in ("level", "fold", "a", "b", "c", "lines", "hits")}
            yield _frame(part, np.full(len(rows), ROW, np.int8), **out, opens=opens, ties=ties, n=n, s=s)
        if sums.last is not None:
            yield _ends(part, sums)

    return run


def _frame(part: int, what: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    n = len(what)
    names = [x.split()[0] for x in HISTORY.split(", ")]
    given = {"part": np.full(n, part, np.int32), "what": what, **columns}
    none = {"opens": np.zeros(n, bool), "ties": np.zeros(n, bool)}
    return pd.DataFrame({c: given[c] if c in given else none.get(c, np.zeros(n, np.int64)) for c in names})


def _ends(part: int, sums: _Sums) -> pd.DataFrame:
    """The rows that tell a part's ends: its first and last level, value and moment (as ``level``, ``a`` and ``b``), and by fold the sums of its last value and moment."""
    rows = [(what, end[0], 0, end[1], end[2], 0, 0) for what, end in ((FIRST, sums.first), (LAST, sums.last))]
    for what, start in ((VALUE_SUMS, sums.value), (MOMENT_SUMS, sums.moment)):
        rows += [(what, 0, f, 0, 0, *(sums.now[:, f] - start[:, f]).tolist()) for f in range(sums.folds)]
    what, level, fold, value, moment, n, s = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return _frame(part, what.astype(np.int8), level=level, fold=fold, a=value, b=moment, n=n, s=s)


def carried(ends: list, folds: int = FOLDS) -> list[tuple[int, int, bool, int, int]]:
    """(part, fold, ties, n, s) to be added to rows of a part's first value, from the parts before it; ``ties`` is for rows of its first moment, which don't see
    the rows of that moment in earlier parts. ``ends`` are the rows of ``_ends`` of all parts; there are a few for each part, however many rows it has."""
    parts: dict[int, dict] = {}
    for r in ends:
        here = parts.setdefault(r.part, {FIRST: None, LAST: None, VALUE_SUMS: np.zeros((folds, 2), int), MOMENT_SUMS: np.zeros((folds, 2), int)})
        if r.what in (FIRST, LAST):
            here[r.what] = (r.level, r.a, r.b)
        else:
            here[r.what][r.fold] = r.n, r.s
    found, last = [], None
    value = moment = np.zeros((folds, 2), int)
    for number in sorted(parts):
        p = parts[number]
        goes_on, still = last is not None and p[FIRST][:2] == last[:2], p[FIRST] == last
        value, moment = value if goes_on else 0 * value, moment if still else 0 * moment
        for ties in (False, True):
            sums = value - moment if ties else value
            for f in range(folds):
                n, s = (int(sums[:, i].sum() - sums[f, i]) for i in (0, 1))
                if n:
                    found.append((number, f, ties, n, s))
        one_value, one_moment = p[LAST][:2] == p[FIRST][:2], p[LAST] == p[FIRST]
        value = p[VALUE_SUMS] + (value if one_value else 0)
        moment = p[MOMENT_SUMS] + (moment if one_moment else 0)
        last = p[LAST]
    return found


def histories(rows: DataFrame, at: list[str], folds: int = FOLDS) -> DataFrame:
    """Of each row of ``rows(level, value, moment, fold, a, b, c, lines, hits)``, none null: ``n`` and ``s``, lines and hits of the rows of
    its level and value with a lesser moment and another fold. Level, ``a``, ``b`` and ``c`` (longs, the row's id) must tell rows
    apart. ``level`` is an int, ``value`` and ``moment`` are longs. A written table is added to ``at``."""
    spark = ship(rows.sparkSession)
    order = ["level", "value", "moment", "a", "b", "c"]
    dealt = rows.select(*order, "fold", "lines", "hits").repartitionByRange(*order).sortWithinPartitions(*order)
    first = written(dealt.mapInPandas(_first_pass(folds), HISTORY), "history", at)
    ends = first.where(F.col("what") != ROW).select("part", "what", "level", "fold", "a", "b", "n", "s").collect()
    carries = spark.createDataFrame(carried(ends, folds), "part int, fold int, ties boolean, more_n long, more_s long")
    # A few rows for each part, whatever it holds.
    added = first.where(F.col("what") == ROW).join(
        F.broadcast(carries.withColumn("opens", F.lit(True))), ["part", "fold", "ties", "opens"], "left"
    )
    return added.select(
        "level", "a", "b", "c", "lines", "hits",
        (F.col("n") + F.coalesce("more_n", F.lit(0))).alias("n"), (F.col("s") + F.coalesce("more_s", F.lit(0))).alias("s")
    )


def rate(n: Column, s: Column, prior: Column) -> Column:
    """Hits in a million, drawn to the prior as by ``WEIGHT`` more lines; the prior itself without history."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", SCALE * s + WEIGHT * prior, n + WEIGHT))


def micros(moment: Column) -> Column:
    """Microseconds since 1970 on the clock that the timestamp shows, whatever the session's zone."""
    seconds = F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(moment) * 3600 + F.minute(moment) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("long")


def _valued(table: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` and ``<value>_value``, a long: numbers as they are, names by a 64-bit hash. An id that comes again has its least value."""
    c = F.min(value)
    found = F.xxhash64(c) if dict(table.dtypes)[value] == "string" else c.cast("long")
    each = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.when(c.isNotNull(), found).alias(f"{value}_value"))
    # Dealt anew, so that the join's sides are shuffled for it alone and a hot key's rows can be split.
    return each.hint("rebalance").hint("shuffle_hash")


def _levels(rows: DataFrame, levels: dict[int, str], ids: list[Column]) -> DataFrame:
    """A row for each level."""
    each = F.array(*(F.struct(F.lit(k).alias("level"), F.coalesce(F.col(c).cast("long"), F.lit(NONE)).alias("value")) for k, c in levels.items()))
    a, b, c = ids
    listed = rows.select("moment", "fold", "lines", "hits", a.alias("a"), b.alias("b"), c.alias("c"), F.explode(each).alias("at"))
    return listed.select("at.level", "at.value", "moment", "fold", "a", "b", "c", "lines", "hits")


def _of(level: int, column: str) -> Column:
    return F.max(F.when(F.col("level") == level, F.col(column)))


def encode_lines(
    lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = FOLDS, flag: str = "returned"
) -> DataFrame:
    """A row for each ``sale_id``, ``item_id`` and ``vendor_id`` of ``lines`` whose sale is known and has a ``sold_at``: ``n_lines``, ``n_returned`` (lines, and
    those with the flag), and for item, vendor and client the number of earlier lines of other folds (``item_n``) and their rate in a
    million (``item_rate``), drawn to that of the item's kind, the vendor's nation or the client's segment, and these to that of all.

    A missing item or client is -1, an ordinary id; a missing vendor is an id of its own and stays missing. A kind, nation or segment that is missing, or
    whose id is unknown, is one shared value. Repeated lines count as often as they come. A sale_id that comes again in ``sales`` is its earliest sale,
    of the least client; an id that comes again in the other tables has its least kind, nation or segment. Lines without sale_id have no sale; a missing
    flag is no hit. Empty tables give an empty result, or priors. Other columns are not read. Rows of a hot id, sale or moment are dealt over parts like all
    others. Names of kinds and segments are told apart by 64-bit hashes. Nothing is sent to all executors but some numbers for each part.
    """
    ship(lines.sparkSession)
    hit = F.coalesce((F.col("flag") == flag).cast("long"), F.lit(0))
    item, vendor = F.coalesce(F.col("item_id").cast("long"), F.lit(-1)), F.coalesce(F.col("vendor_id").cast("long"), F.lit(NONE))
    known = lines.where(F.col("sale_id").isNotNull()).select("sale_id", item.alias("item_id"), vendor.alias("vendor_id"), hit.alias("hit"))
    moment, client = micros(F.col("sold_at")), F.coalesce(F.col("client_id").cast("long"), F.lit(-1))
    counts = F.count("*").alias("lines"), F.sum("hit").alias("hits")
    sold = sales.where(F.col("sale_id").isNotNull() & F.col("sold_at").isNotNull()).groupBy("sale_id").agg(
        F.min(F.struct(moment.alias("moment"), client.alias("client_id"))).alias("sale")
    )
    each = sold.join(known.groupBy("sale_id").agg(*counts), "sale_id").select("sale_id", "sale.*", "lines", "hits")
    fold = F.pmod(F.crc32(F.col("sale_id").cast("string").cast("binary")), F.lit(folds)).cast("int").alias("fold")
    at: list[str] = []
    each = written(
        each.join(_valued(clients, "client_id", "segment"), "client_id", "left").select("sale_id", "moment", fold, "client_id", "segment_value", "lines", "hits"),
        "sales",
        at
    )
    placed = known.groupBy("sale_id", "item_id", "vendor_id").agg(*counts).join(
        each.select("sale_id", "moment", "fold").hint("shuffle_hash"), "sale_id"
    ).join(_valued(items, "item_id", "kind"), "item_id", "left").join(_valued(vendors, "vendor_id", "nation_id"), "vendor_id", "left")
    placed = written(placed, "lines", at)
    none = F.lit(0).cast("long")
    rows = _levels(
        placed, {ITEM: "item_id", KIND: "kind_value", VENDOR: "vendor_id", NATION: "nation_id_value"}, [F.col("sale_id"), F.col("item_id"), F.col("vendor_id")]
    ).unionByName(
        _levels(each.withColumn("one", none), {ALL: "one", SEGMENT: "segment_value", CLIENT: "client_id"}, [F.col("sale_id"), none, none])
    )
    found = histories(rows, at, folds)
    of_lines = found.where(F.col("level").isin(ITEM, KIND, VENDOR, NATION)).repartition("a", "b", "c").groupBy("a", "b", "c").agg(
        _of(ITEM, "lines").alias("n_lines"),
        _of(ITEM, "hits").alias("n_returned"),
        *(_of(k, c).alias(f"{name}_{c}") for k, name in ((ITEM, "item"), (KIND, "kind"), (VENDOR, "vendor"), (NATION, "nation")) for c in "ns")
    )
    of_sales = found.where(F.col("level").isin(ALL, SEGMENT, CLIENT)).groupBy("a").agg(
        *(_of(k, c).alias(f"{name}_{c}") for k, name in ((ALL, "all"), (SEGMENT, "segment"), (CLIENT, "client")) for c in "ns")
    )
    both = of_lines.join(of_sales.hint("rebalance").hint("shuffle_hash"), "a")
    col, top = F.col, rate(F.col("all_n"), F.col("all_s"), F.lit(START))
    both = both.withColumn("top", top)
    for child, parent in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
        both = both.withColumn(f"{parent}_rate", rate(col(f"{parent}_n"), col(f"{parent}_s"), col("top")))
        both = both.withColumn(f"{child}_rate", rate(col(f"{child}_n"), col(f"{child}_s"), col(f"{parent}_rate")))
    return both.select(
        col("a").alias("sale_id"),
        col("b").alias("item_id"),
        F.nullif(col("c"), F.lit(NONE)).alias("vendor_id"),
        "n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate"
    )
