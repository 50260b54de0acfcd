"""Exact group quantiles (linear interpolation) for groups of any size.

The row counts of the groups are taken first. When the largest fits in one task the built-in aggregate
is used. Otherwise no group is gathered: values are first collapsed to (group, value, count), so copies cost one row. A monotone bucketing of
the value then narrows each wanted rank to one bucket, twice; only the rows of the final buckets are
ordered. Every shuffle key contains the value or its bucket, so one huge group spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kongrid.operators.cut import cut

# Rows of one group that one aggregation buffer may hold.
TASK_ROWS = 1_000_000
LOG_STEPS = 128
LINEAR_STEPS = 1024


def _log_bucket(v: Column) -> Column:
    """Non-decreasing in v and bounded: 128 steps per power of two on either side of zero."""
    def size(p):
        return F.floor(F.log2(p) * LOG_STEPS) + 1100 * LOG_STEPS

    return F.when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0)).cast("long")


def _narrow(hist: DataFrame, parent: list[str], bucket: str, wanted: Column) -> DataFrame:
    """Keep the buckets that hold a wanted rank; `base` counts the values below the bucket."""
    w = Window.partitionBy(*parent).orderBy(bucket)
    h = hist.withColumn("_cum", F.sum("_n").over(w) + F.col("_base"))
    h = h.withColumn("_ranks", F.filter(wanted, lambda r: (r >= F.col("_cum") - F.col("_n")) & (r < F.col("_cum"))))
    return h.where(F.size("_ranks") > 0).withColumn("_base", F.col("_cum") - F.col("_n")).drop("_cum")


def group_quantiles(
    df: DataFrame, by: list[str], v: str, probs: dict[str, float], small: bool = False, limit: int | None = None
) -> DataFrame:
    """One row per group: `n` and one column per entry of `probs`. NULL and NaN values are ignored.

    `small=True` skips the size check for groups bounded by construction (profile bins, rings, sectors).
    """
    df = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    if not small:
        largest = df.groupBy(*by).count().agg(F.max("count")).first()[0]
        small = (largest or 0) <= (TASK_ROWS if limit is None else limit)
    if small:
        qs = F.percentile(F.col(v).cast("double"), F.array(*[F.lit(float(q)) for q in probs.values()]))
        agg = df.groupBy(*by).agg(F.count("*").alias("n"), qs.alias("_q"))
        return agg.select(*by, "n", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(probs)])
    return _narrowed(df, by, v, probs)


def _narrowed(df: DataFrame, by: list[str], v: str, probs: dict[str, float]) -> DataFrame:
    names, qs = list(probs), list(probs.values())
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_all")]
    by_ = by or ["_all"]
    # -0.0 and 0.0 are one value
    values = df.select(*keys, (F.col(v).cast("double") + F.lit(0.0)).alias("_v")).groupBy(*by_, "_v").agg(F.count("*").alias("_n"))
    values = values.withColumn("_b", _log_bucket(F.col("_v")))

    hist = values.groupBy(*by_, "_b").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hist = hist.withColumns({"_base": F.lit(0).cast("long"), "_total": F.sum("_n").over(Window.partitionBy(*by_))})
    positions = [(F.col("_total") - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in positions for f in (F.floor, F.ceil)]))
    level1 = _narrow(hist, by_, "_b", ranks).drop("_n")
    level1 = cut(level1)

    near = values.join(level1, by_ + ["_b"])
    span = F.col("_hi") - F.col("_lo")
    near = near.withColumn(
        "_c", F.when(span > 0, F.floor((F.col("_v") - F.col("_lo")) / span * LINEAR_STEPS)).otherwise(F.lit(0)).cast("long")
    )
    hist2 = near.groupBy(*by_, "_b", "_c").agg(
        F.sum("_n").alias("_n"), F.first("_base").alias("_base"), F.first("_ranks").alias("_want"), F.first("_total").alias("_total")
    )
    level2 = _narrow(hist2, by_ + ["_b"], "_c", F.col("_want")).select(*by_, "_b", "_c", "_base", "_ranks", "_total")

    last = near.select(*by_, "_b", "_c", "_v", "_n").join(level2, by_ + ["_b", "_c"])
    w = Window.partitionBy(*by_, "_b", "_c").orderBy("_v")
    last = last.withColumn("_cum", F.sum("_n").over(w) + F.col("_base"))
    hit = F.filter("_ranks", lambda r: (r >= F.col("_cum") - F.col("_n")) & (r < F.col("_cum")))
    picked = last.withColumn("_rank", F.explode(hit)).groupBy(*by_).agg(
        F.first("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m")
    )
    out = []
    for name, q in zip(names, qs, strict=True):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        lo = F.element_at("_m", F.floor(pos).cast("long"))
        hi = F.element_at("_m", F.ceil(pos).cast("long"))
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*by, F.col("_total").alias("n"), *out)
