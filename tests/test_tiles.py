"""Tiled warps, sessions over slices, access compaction and the emitted record, against plain versions."""

import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kongrid.functions import geometry as geo
from kongrid.operators import grids, neighborhood as nb, warp as tiled
from kongrid.operators.cut import shared_dir
from kongrid.operators.recency import sessions
from kongrid.plans.align import emit_metrics
from kongrid.schemas import METRICS
from kongrid.sources import store


def brute_warp(cells, m, h, w, fill, method):
    """Plain resampling of a dict of cells through a 3x3 matrix."""
    inv = np.linalg.inv(np.array(m, float).reshape(3, 3))
    out = {}
    for y in range(h):
        for x in range(w):
            d = inv @ (x, y, 1.0)
            if d[2] == 0:
                out[y, x] = (fill, False)
                continue
            px, py = np.round(d[0] / d[2], 9), np.round(d[1] / d[2], 9)
            half = 0.5 if method == "nearest" else 0.0
            bx, by = int(np.floor(px + half)), int(np.floor(py + half))
            fx, fy = px - bx, py - by
            v = cells.get((by, bx))
            if v is not None and method != "nearest":
                r, b = cells.get((by, bx + 1)), cells.get((by + 1, bx))
                if (fx > 0 and r is None) or (fy > 0 and b is None):
                    v = None
                else:
                    c = cells.get((by + 1, bx + 1))
                    c = c if c is not None else r if r is not None else b if b is not None else v
                    v = (v * (1 - fx) + (v if r is None else r) * fx) * (1 - fy) + ((v if b is None else b) * (1 - fx) + c * fx) * fy
            out[y, x] = (fill, False) if v is None else (v, True)
    return out


MATRICES = {
    "turned": [0.9, -0.4, 12.0, 0.4, 0.9, -3.0, 0, 0, 1],
    "shrunk": [0.2, 0, 1.0, 0, 0.25, 2.0, 0, 0, 1],
    "keystone": [1.0, 0.02, 1.0, -0.01, 1.05, 2.0, 0.002, -0.001, 1],
    "folded": [1.0, 0, 0, 0, 1.0, 0, 0.02, 0, -1],
    "away": [1.0, 0, 500.0, 0, 1.0, 0, 0, 0, 1],
}


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
def test_tiled_warp_equals_plain_resampling(spark, method):
    """Affine and projective maps over many tiles, a grid with holes, an output without a grid, and a singular matrix."""
    rng = np.random.default_rng(4)
    cells = {(y, x): float(rng.integers(0, 255)) for y in range(137) for x in range(149) if rng.random() > 0.02 or y < 70}
    grid = spark.createDataFrame([("g", y, x, v) for (y, x), v in cells.items()], "grid_id string, y int, x int, v double").repartition(3)
    rows = [(k, "g", *map(float, m)) for k, m in MATRICES.items()] + [("none", "absent", *map(float, MATRICES["turned"])), ("flat", "g", *[0.0] * 9)]
    t = spark.createDataFrame(rows, "pair_id string, grid_id string, " + ", ".join(f"c{i} double" for i in range(9)))
    t = t.select("pair_id", "grid_id", geo.matrix(*[F.col(f"c{i}") for i in range(9)]).alias("m"))
    got = {}
    for r in tiled.warp(grid, t, 141, 135, fill=7.0, method=method).collect():
        assert (r["y"], r["x"]) not in got.setdefault(r["pair_id"], {})
        got[r["pair_id"]][r["y"], r["x"]] = (r["v"], r["valid"])
    for name, m in MATRICES.items():
        want = brute_warp(cells, m, 141, 135, 7.0, method)
        assert set(got[name]) == set(want)
        assert all(got[name][k][1] == want[k][1] and abs(got[name][k][0] - want[k][0]) < 1e-6 for k in want), name
    for name in ("none", "flat"):
        assert len(got[name]) == 141 * 135 and set(got[name].values()) == {(7.0, False)}


def test_warp_joins_tiles_and_not_cells(spark):
    """For many outputs of one grid the join meets a tile row per output tile and source tile, and the hot grid is dealt out."""
    grid = spark.range(128 * 128).select(F.lit("g").alias("grid_id"), (F.col("id") / 128).cast("int").alias("y"), (F.col("id") % 128).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    t = spark.range(100).select(F.col("id").cast("string").alias("pair_id"), F.lit("g").alias("grid_id"), geo.matrix(1, 0, 3.5, 0, 1, 0, 0, 0, 1).alias("m"))
    assert tiled.tiles(grid).where("ty >= 0 and tx >= 0").count() == 4
    t = t.select("*", geo.invert(F.col("m")).alias("_inv"), F.lit(128).alias("_h"), F.lit(128).alias("_w"), *[F.lit(v).alias(n) for n, v in (("_x0", 0), ("_x1", 1), ("_y0", 0), ("_y1", 1))])
    # four output tiles each, which meet the tile on their left or above as well: 100 outputs of 16,384 cells are 900 rows
    assert tiled._covered(t, "bilinear").count() == 100 * 9


def test_sessions_over_slices_equal_a_walk(spark):
    r = random.Random(5)
    zero = dt.datetime(2024, 1, 1)
    rows = [(u, zero + dt.timedelta(seconds=r.choice((r.randint(0, 200_000), 5_000 * r.randint(0, 40))))) for u in (1, 1, 1, 2, None) for _ in range(120)] + [(3, None), (4, zero)]
    df = spark.createDataFrame(rows, "u long, ts timestamp").repartition(3)
    want = []
    for u in {u for u, _ in rows}:
        times = sorted(t for v, t in rows if v == u and t)
        for t in times:
            if want and want[-1][0] == u and (t - want[-1][3]).total_seconds() < 2_500:
                want[-1][1:] = [want[-1][1] + 1, want[-1][2], t]
            else:
                want.append([u, 1, t, t])
    for width in (2_500, 3_600, 1_000_000):
        got = [list(x) for x in sessions(df, 2_500, ["u"], slice_seconds=width).select("u", "n", "first_access", "last_access").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_access_compaction_never_shows_half(spark):
    path, schema = f"{shared_dir(spark)}/kongrid-access-{uuid.uuid4().hex}", "k long, last_access timestamp"
    day = [dt.datetime(2024, 1, d) for d in range(1, 9)]

    def log(rows):
        store.log_access(spark.createDataFrame([(k, 200, t) for k, t in rows], "k long, status int, last_access timestamp"), path, "k")

    def now():
        return {r["k"]: r["last_access"] for r in store.read_access(spark, path, "k", schema).collect()}

    assert now() == {} and store.compact_access(spark, path, "k", schema) == 0
    log([(1, day[0]), (2, day[1])])
    log([(1, day[3])])
    assert store.compact_access(spark, path, "k", schema) > 0 and now() == {1: day[3], 2: day[1]}
    log([(2, day[5]), (3, day[2]), (1, day[0])])
    # a table without its marker, as a run that was lost would leave it, is not read and is written over
    spark.createDataFrame([(9, day[7])], schema).write.parquet(f"{path}/tables/v000000002")
    assert now() == {1: day[3], 2: day[5], 3: day[2]}
    assert store.compact_access(spark, path, "k", schema) > 0 and now() == {1: day[3], 2: day[5], 3: day[2]}
    assert spark.read.parquet(f"{path}/tables/v000000002").count() == 3 and store.compact_access(spark, path, "k", schema) == 0


def test_emitted_record_has_the_schema(spark):
    spot = "struct<cx:double,cy:double,r:double>"
    row = ("p", "anchor", 1.0123456, 2.34567, 9, 2.1, 2.2, 0.51239, 0.4, True, 0.1, False, "none", False, 0.98765, "round", (1.234, 2.0, 3.0), (4.0, 5.0, 6.0), 0.7, "medium", (1.0,) * 9)
    names = "pair_id string, alignment_method string, scale double, rotation double, matches int, marker_rotation double, polar_rotation double, polar_correlation double, refine_score double, refine_applied boolean, text_lock_score double, text_lock_applied boolean, text_lock_reason string, dewarp_applied boolean, axis_ratio double, dewarp_reason string"
    matrix = "struct<" + ",".join(f"m{i}{j}:double" for i in range(3) for j in range(3)) + ">"
    df = spark.createDataFrame([row], f"{names}, reference_anchor {spot}, candidate_anchor {spot}, confidence_score double, confidence string, m {matrix}")
    out = emit_metrics(df)
    assert out.schema["metrics"].dataType.fieldNames() == METRICS.fieldNames()
    m = out.first()["metrics"]
    assert (m["detected_scale"], m["inlier_ratio"], m["reference_circle"], m["perspective_axis_ratio"]) == (1.01235, 0.75, [1.23, 2.0, 3.0], 0.9877)
    with pytest.raises(ValueError):
        emit_metrics(df.drop("confidence"))


def test_compare_cells_of_a_hot_reference(spark):
    """One reference for 300 candidates: all cells of every pair."""
    ref = spark.range(12).select(F.lit("r").alias("grid_id"), (F.col("id") / 4).cast("int").alias("y"), (F.col("id") % 4).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    cand = spark.range(300 * 12).select(F.concat(F.lit("c"), (F.col("id") / 12).cast("int")).alias("grid_id"), (F.col("id") % 12 / 4).cast("int").alias("y"), (F.col("id") % 12 % 4).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    pairs = spark.range(300).select(F.col("id").cast("string").alias("pair_id"), F.lit("r").alias("ref_id"), F.concat(F.lit("c"), "id").alias("cand_id"))
    out = grids.compare_cells(ref, cand, pairs)
    assert out.count() == 3600 and out.where("ref_v is null or cand_v is null or (cand_v - ref_v) % 12 <> 0").count() == 0


def test_pairs_of_a_large_group_are_refused(spark):
    ids = spark.range(1001).select(F.col("id").alias("grid_id"), F.lit(0).alias("k"))
    with pytest.raises(ValueError):
        grids.make_pairs(ids, ids, ["k"], "before")
    few = ids.where("grid_id < 5")
    assert grids.make_pairs(few, few, ["k"], "before").count() == 10 and grids.make_pairs(few, few, ["k"]).count() == 25


def test_small_grids_are_equalised_in_one_shuffle(spark, monkeypatch):
    """Grids within a tile: rows as from joined curves, gaps, copies and missing values included, without a join."""
    r = np.random.default_rng(4)
    rows = [(g, y, x, float(r.random() * 300 - 20)) for g, h, w in (("a", 20, 17), ("b", 5, 30), ("c", 1, 4)) for y in range(h) for x in range(w) if r.random() < 0.9]
    rows += rows[:5] + [("a", 30, 40, 7.0), (None, 0, 0, 1.0), ("b", 2, 2, None), ("c", None, 1, 2.0)]
    grid = spark.createDataFrame(rows, "grid_id string, y int, x int, v double")

    def made(f):
        return sorted((t["grid_id"], t["y"], t["x"], "" if t["v"] is None else f"{t['v']:.9g}") for t in f().collect())

    ways = [lambda: nb.tile_equalize(grid), lambda: nb.feature_map(grid, "gradient"), lambda: nb.feature_map(grid, "dial")]
    plan = ways[0]()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    small = [made(f) for f in ways]
    monkeypatch.setattr(nb, "within_tile", lambda grid: False)
    assert small == [made(f) for f in ways]
