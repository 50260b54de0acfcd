"""Steps that must not pass through the driver, and stencils that cross tile borders."""

import numpy as np
from pyspark.sql import functions as F

from checks.streams import stream
from kongrid.functions.geometry import identity
from kongrid.operators import detect, neighborhood as nb, stencils as st
from kongrid.operators.warp import tiles, warp


def waves(spark, height, width, hole=None):
    g = spark.range(height * width).select(F.lit("g").alias("grid_id"), F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    g = g.withColumn("v", F.sin(F.col("y") * 0.7) * 50 + F.cos(F.col("x") * 0.9) * 40 + F.pmod(F.col("x") * 7 + F.col("y") * 3, F.lit(5)))
    return g if hole is None else g.withColumn("v", F.when((F.col("y") != hole[0]) | (F.col("x") != hole[1]), F.col("v")))


def cells(df, *cols):
    return {(r["y"], r["x"]): tuple(r[c] for c in cols) for r in df.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_made_of_few_anchors_are_not_broadcast(spark):
    points = detect.signature_points(spark.createDataFrame([("g", 20.0, 20.0, 15.0)], "grid_id string, cx double, cy double, r double"), 1440)
    assert "Broadcast" not in plan(nb.bilinear_sample(waves(spark, 40, 40), points))


def test_small_grids_make_small_tiles(spark):
    rows = tiles(waves(spark, 8, 8)).collect()
    assert len(rows) == 1 and len(rows[0]["v"]) == 8 * 64


def test_tiles_are_not_broadcast(spark):
    g = waves(spark, 8, 8)
    t = spark.createDataFrame([("g",)], "grid_id string").withColumn("m", identity())
    moved = warp(g, t, 8, 8, out=["grid_id"])
    moved.write.format("noop").mode("overwrite").save()
    joins = [line for line in plan(moved).splitlines() if "_copy" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_streams_read_folders_as_well_as_files(spark, tmp_path):
    spark.range(20).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    stream(spark, str(tmp_path), "pages").writeStream.format("memory").queryName("folder").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("folder").count() == 20


def plain_gradient(a):
    p = np.pad(a, 1, mode="reflect")
    gx = sum(w * (p[1 + d : 1 + d + a.shape[0], 2:] - p[1 + d : 1 + d + a.shape[0], :-2]) for d, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (p[2:, 1 + d : 1 + d + a.shape[1]] - p[:-2, 1 + d : 1 + d + a.shape[1]]) for d, w in ((-1, 1), (0, 2), (1, 1)))
    return gx, gy


def test_stencils_cross_tiles(spark, monkeypatch):
    monkeypatch.setattr(st, "TILE", 16)
    g = waves(spark, 35, 41)
    a = np.zeros((35, 41))
    for (y, x), (v,) in cells(g, "v").items():
        a[y, x] = v
    k = nb.gaussian_kernel(1.5, 3)
    blurred = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 3, mode="reflect"), k, "valid"), 1, a)
    blurred = np.apply_along_axis(lambda r: np.convolve(np.pad(r, 3, mode="reflect"), k, "valid"), 0, blurred)
    gx, gy = plain_gradient(blurred)
    got = cells(nb.sobel(g, blur=(1.5, 3)), "v", "gx", "gy")
    assert len(got) == a.size
    for (y, x), values in got.items():
        assert np.allclose(values, (blurred[y, x], gx[y, x], gy[y, x]), atol=1e-9)


def test_samples_cross_tiles_and_keep_nulls(spark, monkeypatch):
    g = waves(spark, 20, 20, hole=(5, 5))
    p = spark.createDataFrame([("g", 3.25, 4.5), ("g", 15.75, 15.5), ("g", 5.0, 5.0), ("g", 19.0, 3.0), ("g", -0.5, 2.0), ("h", 1.0, 1.0)], "grid_id string, px double, py double")
    whole = sorted((r["px"], r["py"], r["v"]) for r in nb.bilinear_sample(g, p).collect())
    monkeypatch.setattr(st, "TILE", 16)
    assert sorted((r["px"], r["py"], r["v"]) for r in nb.bilinear_sample(g, p).collect()) == whole
    assert [r[:2] for r in whole] == [(3.25, 4.5), (5.0, 5.0), (15.75, 15.5)] and whole[1][2] is None


def test_repeated_cells_answer_as_often_as_they_come(spark):
    g = waves(spark, 6, 6)
    p = spark.createDataFrame([("g", 2.5, 2.5)], "grid_id string, px double, py double")
    assert nb.bilinear_sample(g.unionByName(g), p.unionByName(p)).count() == 4
