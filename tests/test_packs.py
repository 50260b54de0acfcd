"""Packed cells: what travels, and that work on whole grids equals the work on rows of cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kongrid.operators import cut as cuts, detect, neighborhood as nb, packs, profiles as P, stencils as st
from kongrid.sources import adapters as A

CELLS = "grid_id string, y int, x int, v double"


def dials(spark, size=64, odd=True):
    """Dials of which one lacks cells, one has repeated cells and one has nulls; a grid without an anchor, an anchor without a grid."""
    r = random.Random(3)
    p = spark.createDataFrame([(k, 31.0 + i, 30.0 - i, 19.0 + i, 2.0 * i, 0.85) for i, k in enumerate("abcd")], "grid_id string, cx double, cy double, r double, rotation double, ratio double")
    drawn = A.draw_dials(p.withColumns({"gain": F.lit(1.0), "offset": F.lit(0.0)}), size)
    rows = [(*c, v + r.random()) for *c, v in sorted(tuple(x) for x in drawn.collect())]
    if odd:
        rows = [x for x in rows if x[0] != "b" or r.random() > 0.03]
        rows += [x for x in rows if x[0] == "c" and r.random() < 0.05]
        rows = [(*x[:3], None) if x[0] == "d" and r.random() < 0.02 else x for x in rows] + [("e", 0, 0, 1.0), (None, 1, 1, 1.0)]
    r.shuffle(rows)
    anchors = p.select("grid_id", "cx", "cy", "r")
    return spark.createDataFrame(rows, CELLS), anchors.unionByName(spark.createDataFrame([("f", 5.0, 5.0, 4.0)], anchors.schema)) if odd else anchors


def close(got, want, names, tol=1e-6):
    got, want = ({tuple(r[k] for k in names): tuple(x for c, x in r.asDict().items() if c not in names) for r in rows} for rows in (got, want))
    assert set(got) == set(want) and want
    for k in want:
        assert all((a is None and b is None) or abs(a - b) <= tol for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def test_packed_cells_come_back(spark):
    r = random.Random(1)
    rows = [(k, y, x, r.choice([None, r.random()]), r.choice([True, False, None])) for k in ("a", "b", None) for y in range(-2, 9) for x in range(7) if r.random() > 0.3]
    rows += rows[::5] + [("a", None, 1, 1.0, True)]
    r.shuffle(rows)
    grid = spark.createDataFrame(rows, "grid_id string, y int, x long, v double, ok boolean")

    def back(key, y, x, cells):
        import pyarrow as pa

        columns = {c: pa.array(a, mask=~k) for c, (a, k) in cells.items()}
        return pa.table(packs.repeated(key, ["grid_id"], len(y)) | {"y": pa.array(y).cast(pa.int32()), "x": pa.array(x)} | columns)

    for tile in (None, 4):
        got = packs.per_grid(grid, ["grid_id"], ["v", "ok"], back, grid.schema, tile=tile).collect()
        assert sorted(map(str, got)) == sorted(str(x) for x in grid.where("y is not null").collect())


def test_few_rows_travel(spark):
    """A grid whose lines follow each other is one packed row for each batch, not one row per cell."""
    grid = spark.range(4096, numPartitions=1).select(F.lit("g").alias("grid_id"), (F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    made = packs.runs(grid, ["grid_id"], ["v"]).collect()
    assert len(made) == 1 and len(made[0]["_v0"]) == 8 * 4096 and len(made[0]["_runs"]) == 24 * 64
    # the plan of a stencil shuffles what `runs` made and not the cells
    plan = nb.gradient(grid)._jdf.queryExecution().executedPlan().toString()
    assert "_runs" in plan and "Generate explode" not in plan


@pytest.mark.parametrize("steps", [[st.smooth("v", nb.gaussian_kernel(2.0, 3))], [st.equalize("v", 2.0, 8, 8), st.slopes("v"), st.magnitude(True), st.ridges()], [st.highpass("v", nb.gaussian_kernel(3.0))]])
def test_full_rectangles_equal_cells_in_any_order(steps):
    r = np.random.default_rng(2)
    h, w = 31, 23
    y, x = (a.ravel() for a in np.mgrid[:h, :w])
    v = np.floor(r.random(h * w) * 256)

    def run(order):
        lines, cells = st.Lines(y[order], x[order]), {"v": (v[order], np.ones(h * w, bool))}
        assert (lines.shape is not None) == (order[:2].tolist() == [0, 1])
        for step in steps:
            step(cells, lines)
        return {c: a[np.argsort(order)] for c, (a, _) in cells.items()}

    plain, mixed = run(np.arange(h * w)), run(r.permutation(h * w))
    assert all((plain[c] == mixed[c]).all() for c in mixed)


def both_ways(monkeypatch, run):
    """Results where grids meet as a whole, and by rows of cells."""
    whole = run()
    monkeypatch.setattr(detect, "_one_group", lambda *a: False)
    return whole, run()


def test_signatures_equal_sampled_rows(spark, monkeypatch):
    grid, anchors = dials(spark)
    got, want = both_ways(monkeypatch, lambda: detect.circular_signature(grid, anchors, 90).collect())
    close([r for r in got if r["grid_id"]], [r for r in want if r["grid_id"]], ("grid_id", "bin"), 1e-4)


def test_rays_equal_sampled_rows(spark, monkeypatch):
    grid, anchors = dials(spark)
    got, want = both_ways(monkeypatch, lambda: detect.ray_edges(grid, anchors).collect())
    close(got, want, ("grid_id", "ray"))


def test_orientation_equals_rows(spark, monkeypatch):
    grid, anchors = dials(spark, 96)
    got, want = both_ways(monkeypatch, lambda: detect.orientation(grid, anchors).collect())
    close(got, want, ("grid_id",))


def test_rings_equal_rows(spark, monkeypatch):
    grid, anchors = dials(spark)
    got, want = both_ways(monkeypatch, lambda: [detect.radial_profile(grid, anchors)[k].collect() for k in (0, 1)])
    close(got[0], want[0], ("grid_id", "ring"))
    close(got[1], want[1], ("grid_id",))


def test_circles_equal_rows(spark, monkeypatch):
    grid, _ = dials(spark)
    got, want = both_ways(monkeypatch, lambda: detect.detect_anchor(grid.where("grid_id is not null"), refine=False).collect())
    close(got, want, ("grid_id",))


def test_profiles_taken_apart_are_not_put_together_anew(spark):
    packed = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [0.0, 4.0, 5.0])], "grid_id string, profile array<double>")
    rows = P.unpack_profiles(packed, unique=3)
    assert "Exchange" not in P.pack_profiles(rows, 3)._jdf.queryExecution().executedPlan().toString()
    again = P.pack_profiles(rows.select("*"), 3)
    assert sorted(map(str, again.collect())) == sorted(map(str, P.pack_profiles(rows, 3).collect()))


def test_batches_are_weighed_again(spark):
    """The limit of a batch's bytes is lifted only while narrow rows made without Python are handed over."""
    before = spark.conf.get(cuts._LIMIT)
    plain = spark.range(3).mapInArrow(lambda it: it, "id long")
    with cuts.narrow_rows(plain):
        assert spark.conf.get(cuts._LIMIT) == cuts._NONE
    assert spark.conf.get(cuts._LIMIT) == before
    with cuts.narrow_rows(plain.mapInArrow(lambda it: it, "id long")):
        assert spark.conf.get(cuts._LIMIT) == before
