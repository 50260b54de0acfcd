"""Plans at production sizes, on a few pairs."""

from pyspark.sql import functions as F

from checks.detectchecks import couples
from kongrid.functions import geometry as geo
from kongrid.operators import neighborhood as nb, stencils as st, warp
from kongrid.operators.cut import cut
from kongrid.operators.grids import canvas_cells
from kongrid.plans.compare import compare_pairs, default_palette, difference_views


def test_scale_lock_at_the_smallest_production_canvas(spark, sf):
    """A candidate placed a tenth too small is brought back by the marker ring, searched on reduced maps."""
    ref, rp, cand, cp, pairs = couples(spark, sf)
    pairs = pairs.where("pair_id = '1'")

    def colour(g):
        return g.where(F.substring("grid_id", 2, 20) == "1").select("grid_id", "y", "x", *[F.col("v").alias(c) for c in "bgr"])

    anchors = rp.unionByName(cp).select("grid_id", "cx", "cy", "r")
    both = rp.select(F.substring("grid_id", 2, 20).alias("pair_id"), F.struct("cx", "cy", "r").alias("a")).join(
        cp.select(F.substring("grid_id", 2, 20).alias("pair_id"), F.struct("cx", "cy", "r").alias("c"), "rotation"), "pair_id")
    right = both.select("pair_id", geo.similarity_from_anchors(F.col("a"), F.col("c"), F.col("rotation")).alias("_m"), F.col("a.cx").alias("_x"), F.col("a.cy").alias("_y"))
    wrong = right.select("pair_id", geo.compose(geo.rotate_scale_about(F.col("_x"), F.col("_y"), 0.0, 0.9), F.col("_m")).alias("m"))
    _, metrics = compare_pairs(colour(ref), colour(cand), pairs, wrong, anchors, pairs.select("pair_id", F.lit(False).alias("appearance_match")))
    row = metrics.join(right, "pair_id").select("canvas_size", "scale_lock_applied", "scale_lock_reason", (geo.scale_of(F.col("m")) / geo.scale_of(F.col("_m")) / F.col("render_scale")).alias("s")).first()
    assert row["canvas_size"] == 640 and row["scale_lock_applied"], row
    assert abs(row["s"] - 1) < 0.03, row


def test_canvas_cells_fill_the_cluster(spark):
    frames = spark.createDataFrame([("a", 30), ("b", 20)], "k string, n int").coalesce(1)
    cells = canvas_cells(frames, F.col("n"), F.lit(7))
    assert cells.count() == 350 and cells.distinct().count() == 350
    assert cells.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def counted(monkeypatch, module, name):
    """Calls of a function of a module, which goes on working."""
    calls, whole = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append(a) or whole(*a, **k))
    return calls


def board(spark):
    """Cells of two pairs with shifted boards: one with missing cells, one with rows that are there twice."""
    rows = []
    for pid, h, w in (("a", 40, 50), ("b", 30, 30)):
        for y in range(h):
            for x in range(w):
                if pid == "a" and (x * 7 + y * 3) % 41 == 0:
                    continue
                ref, cand = (90.0 + 110 * (((x + k) // 9 + y // 7) % 2) + (x * y) % 13 for k in (0, 2))
                rows += [(pid, y, x, ref, ref * 0.9, ref * 0.8, cand, cand * 0.9, cand * 0.7, x % 5 > 0)] * (2 if pid == "b" and (x + y) % 6 == 0 else 1)
    return spark.createDataFrame(rows, "pair_id string, y int, x int, ref_b double, ref_g double, ref_r double, b double, g double, r double, valid boolean")


def test_difference_views_meet_a_pairs_cells_once(spark, monkeypatch):
    """Edges of both sides and the blur take one pass, with the edges that `edge_cells` finds on each side by itself."""
    cells = cut(board(spark))
    edges = [nb.edge_cells(cells.select(F.col("pair_id").alias("grid_id"), "y", "x", (F.col(p + "b") * 0.114 + F.col(p + "g") * 0.587 + F.col(p + "r") * 0.299).alias("v")), 70, 160) for p in ("ref_", "")]
    both = edges[0].withColumnRenamed("edge", "e0").join(edges[1].withColumnRenamed("edge", "e1"), ["grid_id", "y", "x"], "full")
    kind = {(True, True): "both", (True, False): "reference", (False, True): "candidate", (False, False): "none"}
    want = {}
    for r in both.groupBy("grid_id", "e0", "e1").count().collect():
        want[r["grid_id"], kind[r["e0"], r["e1"]]] = r["count"]
    passes = counted(monkeypatch, st, "stencil")
    views, counts = difference_views(cells, default_palette(spark))
    assert len(passes) == 1
    got = {(r["pair_id"], k): r[f"edges_{k}"] for r in counts.collect() for k in kind.values() if r[f"edges_{k}"]}
    assert got == want and min(want[p, "both"] for p in "ab") > 0
    assert views.where("view = 'edges'").count() == sum(want.values())
    assert views.where("view = 'heatmap'").count() == cells.count()


def test_candidates_are_packed_once_for_both_renders(spark, sf, monkeypatch):
    ref, rp, cand, cp, pairs = couples(spark, sf, rotation=F.lit(0.0))

    def colour(g):
        return g.select("grid_id", "y", "x", *[F.col("v").alias(c) for c in "bgr"])

    packs = counted(monkeypatch, warp, "tiles")
    anchors = rp.unionByName(cp).select("grid_id", "cx", "cy", "r")
    m = pairs.select("pair_id", geo.identity().alias("m"))
    compare_pairs(colour(ref), colour(cand), pairs, m, anchors, pairs.select("pair_id", F.lit(False).alias("logo_lock")), minimum=96, maximum=96)
    assert len(packs) == 2


def test_packed_grids_warp_as_their_cells_do(spark):
    cells = spark.range(100 * 90).select(F.lit("g").alias("grid_id"), F.floor(F.col("id") / 90).cast("int").alias("y"), (F.col("id") % 90).cast("int").alias("x"), F.sin("id").alias("v"))
    cells = cells.where("(x * 3 + y) % 17 <> 0")
    t = spark.createDataFrame([("p", "g"), ("q", "none")], "pair_id string, grid_id string").withColumn("m", geo.rotate_scale_about(F.lit(50.0), F.lit(45.0), F.lit(12.0), F.lit(1.1)))
    plain, quick = (sorted(map(repr, warp.warp(g, t, 80, 70).collect())) for g in (cells, warp.packed(cells)))
    assert plain == quick and len(plain) == 2 * 80 * 70
