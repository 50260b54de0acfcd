"""Robust statistics, correlation and scoring over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.functions.color import abs_diff, clip
from kongrid.functions.geometry import wrap180
from kongrid.operators.keys import attach
from kongrid.operators.quantiles import group_quantiles

# Below this many values the neutral tone points are used.
MIN_TONE_VALUES = 100
NEUTRAL_TONE = (0.0, 127.5, 255.0)


def tone_points(p10, p50, p90, n) -> Column:
    few = F.col(n) < MIN_TONE_VALUES if isinstance(n, str) else n < MIN_TONE_VALUES
    parts = zip(("p10", "p50", "p90"), (p10, p50, p90), NEUTRAL_TONE, strict=True)
    return F.struct(*[F.when(few, F.lit(d)).otherwise(F.col(c) if isinstance(c, str) else c).alias(k) for k, c, d in parts])


def robust_percentiles(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    """`tone` = (p10, p50, p90) per group and `n`; the neutral points for groups under 100 values."""
    q = group_quantiles(df, by, v, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select(*by, "n", tone_points("p10", "p50", "p90", "n").alias("tone"))


def spread_points(p10: Column, p50: Column, p90: Column) -> Column:
    return F.struct(p50.alias("median"), F.greatest(F.lit(4.0), p90 - p10).alias("spread"))


def median_spread(df: DataFrame, v: str, by: list[str]) -> DataFrame:
    q = group_quantiles(df, by, v, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select(*by, "n", spread_points(F.col("p10"), F.col("p50"), F.col("p90")).alias("stats"))


def circular_mean(df: DataFrame, angle: str, weight: str, by: list[str], min_count: int = 50, min_weight: float = 1.0) -> DataFrame:
    """Weighted mean direction in [0, 360); NULL for groups too small or too light to trust."""
    a = F.radians(F.col(angle))
    w = F.col(weight).cast("double")
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(w).alias("weight_sum"),
        F.sum(w * F.sin(a)).alias("_s"), F.sum(w * F.cos(a)).alias("_c"),
    )
    ok = (F.col("n") >= min_count) & (F.col("weight_sum") > min_weight)
    mean = F.when(ok, F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0)))
    return g.select(*by, "n", "weight_sum", mean.alias("mean_angle"))


def robust_offset(
    df: DataFrame, v: str, by: list[str], tol: float = 2.5, min_values: int = 6, min_kept: int = 5, small: bool = False
) -> DataFrame:
    """Median offset after dropping outliers; NULL and 0 with fewer than six values per group."""
    df = df.where(F.col(v).isNotNull())
    first = group_quantiles(df, by, v, {"_m1": 0.5}, small).withColumnRenamed("n", "_n")
    joined = df.join(first, by) if small else attach(df, first, by, "_n")
    kept = joined.where(F.abs(wrap180(F.col(v) - F.col("_m1"))) < tol).select(*by, v)
    second = group_quantiles(kept, by, v, {"_m2": 0.5}, small).withColumnRenamed("n", "_k")
    enough = F.col("_n") >= min_values
    k = F.coalesce(F.col("_k"), F.lit(0).cast("long"))
    value = F.when(enough & (k >= min_kept), F.col("_m2")).when(enough, F.col("_m1"))
    return first.join(second, by, "left").select(
        *by, F.col("_n").alias("n"), value.alias("offset"), F.when(enough, k).otherwise(F.lit(0).cast("long")).alias("kept")
    )


def masked_corr(df: DataFrame, a: str, b: str, mask: Column, by: list[str], min_count: int = 100) -> DataFrame:
    """Pearson r over the masked cells of each group; 0 when too few cells or no variance."""
    g = df.where(mask & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.corr(a, b).alias("_r")
    )
    r = F.when(F.col("n") < min_count, F.lit(0.0)).otherwise(F.coalesce(F.nanvl("_r", F.lit(0.0)), F.lit(0.0)))
    return g.select(*by, "n", r.alias("score"))


def appearance_report(df: DataFrame, before: Column, after: Column, by: list[str]) -> DataFrame:
    """Mean distance before and after normalisation and the relative improvement."""
    g = df.groupBy(*by).agg(
        F.count("*").alias("sample_cells"), F.avg(before).alias("distance_before"), F.avg(after).alias("distance_after")
    )
    gain = F.when(F.col("distance_before") <= 0.001, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("distance_after") / F.col("distance_before"))
    )
    return g.withColumn("improvement", gain)


def zscore(df: DataFrame, v: str, by: list[str], out: str | None = None) -> DataFrame:
    """(v - mean) / (population deviation + 1e-6) within each group."""
    s = df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_sd"))
    z = (F.col(v) - F.col("_mean")) / (F.col("_sd") + 1e-6)
    return attach(df, s, by, "_n").withColumn(out or v, z).drop("_n", "_mean", "_sd")


def top_fraction(df: DataFrame, v: str, q: float, by: list[str], strict: bool = False) -> DataFrame:
    """Rows at or above (strictly above) the q-th percentile of their group."""
    cut = group_quantiles(df, by, v, {"_cut": q}).withColumnRenamed("n", "_n")
    keep = F.col(v) > F.col("_cut") if strict else F.col(v) >= F.col("_cut")
    return attach(df, cut, by, "_n").where(keep).drop("_n", "_cut")


def percentile_stretch(
    df: DataFrame, v: str, by: list[str], low: float = 0.25, high: float = 0.97, out: str | None = None, among: Column | None = None
) -> DataFrame:
    """Spread the low..high percentile range of each group over 0-255; all zero for a flat group."""
    base = df if among is None else df.where(among)
    q = group_quantiles(base, by, v, {"_lo": low, "_hi": high}).withColumnRenamed("n", "_n")
    span = F.col("_hi") - F.col("_lo")
    s = F.when(span <= 0, F.lit(0.0)).otherwise(clip((F.col(v) - F.col("_lo")) * 255.0 / span, 0, 255))
    return attach(df, q, by, "_n").withColumn(out or v, s).drop("_n", "_lo", "_hi")


def diff_summary(cells: DataFrame, a: str, b: str, by: list[str], threshold: float = 25.0) -> DataFrame:
    """Numeric content of the difference views: one row per pair."""
    d = abs_diff(F.col(a), F.col(b))
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"),
        F.avg(d).alias("mean_diff"),
        F.max(d).alias("max_diff"),
        F.avg(F.when(d > threshold, 1.0).otherwise(0.0)).alias("share_above"),
    )


def best_candidate(df: DataFrame, score: Column, by: list[str], tie: list[str], largest: bool = False) -> DataFrame:
    """One row per group with the smallest (largest) score; ties go to the smallest `tie` columns.

    A struct minimum aggregates map-side, unlike a window, and is deterministic, unlike max_by.
    """
    key = -score if largest else score
    rest = [c for c in df.columns if c not in by and c not in tie]
    best = F.min(F.struct(key.alias("_k"), *tie, *rest)).alias("_best")
    return df.groupBy(*by).agg(best).select(*by, *[F.col(f"_best.{c}").alias(c) for c in tie + rest])


def anchor_preference(x, y, r, width, height) -> Column:
    """Smaller is better: near the centre with a radius close to 30 % of the short side."""
    w, h = F.greatest(F.lit(1.0), width.cast("double")), F.greatest(F.lit(1.0), height.cast("double"))
    return 1.4 * F.hypot((x - width / 2) / w, (y - height / 2) / h) + F.abs(r / F.least(w, h) - 0.30)
