"""Grids, dials, profiles, descriptors and requests derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.operators.cut import cut
from kongrid.operators.grids import densify


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: one 30 x 24 grid (day of month x hour) per event type."""
    e = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("grid_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")
    ).agg(F.sum("value").alias("v"))
    return densify(e, 30, 24, 0.0)


def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2: one 8 x 8 grid per embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("grid_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), F.col("e").cast("double").alias("v"))


def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3: quantity x discount grid of revenue per flag and status, sparse."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("grid_id"),
        F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x"),
    ).agg(F.sum("l_extendedprice").alias("v"))


def seconds_of_day(ts: str = "ts"):
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def event_dial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1: time of day as a direction, value as weight."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("grid_id"), "event_id", (seconds_of_day() / 240.0).alias("angle"), F.col("value").alias("weight")
    )


def event_profile(spark: SparkSession, sf_dir: str, bins: int = 24, by: list[str] = ["event_type"]) -> DataFrame:
    """D2: value per time-of-day bin; missing bins are 0."""
    width = 86400 // bins
    return (
        table(spark, sf_dir, "events")
        .groupBy(*by, F.floor(seconds_of_day() / width).cast("int").alias("bin"))
        .agg(F.sum("value").alias("v"))
    )


def sign_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: sign bits of each embedding as one 64-bit word; even ids are candidates."""
    word = F.aggregate(
        F.transform("embedding", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 2 == 0, "cand").otherwise("ref").alias("grid_id"),
        F.col("vec_id").alias("kp_id"), "label", "embedding", F.array(word).alias("desc"),
    )


def price_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: extended price by return flag."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v")
    )


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 colours: a (b, g, r) triple per part."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        (F.col("p_partkey") * 7 % 256).cast("double").alias("b"),
        (F.col("p_size") * 37 % 256).cast("double").alias("g"),
        (F.floor(F.col("p_retailprice")) % 256).cast("double").alias("r"),
    )


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1: events as control changes of a session."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("param"), "value",
    )


# ---------------------------------------------------------------- drawn dials


def draw_dials(params: DataFrame, size: int = 96) -> DataFrame:
    """Grey dials drawn from rows (grid_id, cx, cy, r, rotation, ratio, gain, offset).

    A bright rim, twelve markers turned by `rotation` (clockwise) and a bar standing for printed text;
    `ratio` below 1 squeezes the dial vertically.
    """
    from kongrid.functions.geometry import wrap180
    from kongrid.operators.grids import canvas_cells

    c = canvas_cells(params, F.lit(size), F.lit(size))
    dx, dy = F.col("x") - F.col("cx"), (F.col("y") - F.col("cy")) / F.col("ratio")
    d = F.hypot(dx, dy)
    a = F.degrees(F.atan2(dx, -dy)) - F.col("rotation")
    t = F.radians("rotation")
    u, v = dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)
    r = F.col("r")
    off = F.abs(wrap180(a * 12) / 12)
    marker = (d >= r * 0.62) & (d <= r * 0.80) & (off <= 3.0)
    bar = (F.abs(u) <= r * 0.3) & (v >= r * -0.30) & (v <= r * -0.22)
    value = F.when(marker | bar, 230.0).when(F.abs(d - r) <= 1.5, 200.0).when(d <= r, 90.0).otherwise(20.0)
    out = F.greatest(F.lit(0.0), F.least(F.lit(255.0), value * F.col("gain") + F.col("offset")))
    return c.select("grid_id", "y", "x", out.alias("v"))


def dial_params(suppliers: DataFrame, **over) -> DataFrame:
    """Dial parameters that differ by supplier; keywords replace single columns."""
    k = F.col("s_suppkey")
    base = {
        "grid_id": k.cast("string"), "cx": 48.0 + k % 7 - 3, "cy": 47.0 + k % 5 - 2, "r": 28.0 + k % 4,
        "rotation": (k % 11 - 5).cast("double"), "ratio": F.lit(1.0), "gain": F.lit(1.0), "offset": F.lit(0.0),
    }
    return suppliers.select(*[(F.lit(v) if not hasattr(v, "alias") else v).alias(n) for n, v in {**base, **over}.items()])


def supplier_dials(spark: SparkSession, sf_dir: str, size: int = 96, **over) -> tuple[DataFrame, DataFrame]:
    """(dials, their parameters), one per supplier."""
    p = dial_params(table(spark, sf_dir, "supplier"), **over)
    return cut(draw_dials(p, size)), p
