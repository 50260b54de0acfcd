"""Joining one row per key onto many rows, without a hot key or an unchecked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kongrid.operators.cut import cut

# Tables of at most this many rows (a few wide columns each) are broadcast; the size is always counted.
BROADCAST_ROWS = 100_000
# A key holding more than 1/HOT_PARTS of all rows is hot. At most HOT_PARTS keys can be.
HOT_PARTS = 10_000


def attach(rows: DataFrame, stats: DataFrame, on: list[str], count: str, limit: int | None = None) -> DataFrame:
    """Inner-join per-key `stats` (one row per key, `count` = rows of that key) onto `rows`.

    The stats are written once and counted. A table within `limit` rows is broadcast. Otherwise only
    the hot keys are (there are at most HOT_PARTS of them, whatever the data size), their rows stay
    where they are, and the rest is a shuffle join in which no key is large.
    """
    stats = cut(stats)
    if stats.count() <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(stats), on)
    total = stats.agg(F.sum(count)).first()[0]
    is_hot = F.col(count) * F.lit(HOT_PARTS) > F.lit(total)
    hot, cold = stats.where(is_hot), stats.where(~is_hot)
    kept = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return kept.unionByName(rest)


def attach_small(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", limit: int | None = None) -> DataFrame:
    """Join a table with one row per grid or pair: broadcast when its counted size allows, else shuffle.

    For keys whose row count is bounded by construction (a grid has at most MAX_CELLS cells).
    """
    table = cut(table)
    small = table.count() <= (BROADCAST_ROWS if limit is None else limit)
    return rows.join(F.broadcast(table) if small else table, on, how)

def multicast(rows: DataFrame, table: DataFrame, on: str | list[str], uses: int = 16, how: str = "inner", apart: bool = False) -> DataFrame:
    """Join a keyed `table` of wide rows, or of many rows per key, onto `rows` that may share a key without bound.

    Uses of each key are counted; a key gets one copy of its table rows per `uses` of them, and its uses are dealt over the
    copies by hash. So no task meets more than about `uses` rows of a key, and copies add at most 1/uses of what the join
    returns anyway. Only the counts are broadcast, by their number; beyond it both sides are joined with them by key, the
    rows after hot keys of theirs have been taken out (`attach`). `how` is inner or left. `apart`: the join keeps as many tasks as
    asked for, where rows are few and small but what follows is not.
    """
    on = [on] if isinstance(on, str) else list(on)
    rows = rows.withColumn("_k", F.xxhash64(*rows.columns))
    counts = rows.groupBy(*on).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / uses).cast("int"))
    counts = cut(counts.where("_parts > 1"))
    if counts.count() <= BROADCAST_ROWS:
        dealt = rows.join(F.broadcast(counts.drop("_n")), on, "left")
    else:
        dealt = attach(rows, counts, on, "_n").drop("_n").unionByName(rows.join(counts.select(*on), on, "left_anti").withColumn("_parts", F.lit(1)))
    dealt = dealt.withColumn("_copy", F.pmod("_k", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts", "_k")
    copies = attach_small(table, counts.drop("_n"), on, "left")
    copies = copies.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    if apart:
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt, copies = (t.repartition(tasks, *on, "_copy") for t in (dealt, copies))
    # wide rows are taken for small ones where Spark guesses their size, so they're never broadcast
    return dealt.join(copies.hint("merge"), [*on, "_copy"], how).drop("_copy")
