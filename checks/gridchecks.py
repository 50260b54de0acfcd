"""Grid queries (SRC-4, SRC-5, PRD-5, NB-1..7, JN-1..4, AG-12, FN-20)."""

from pyspark.sql import functions as F

from checks.base import G1, G2, G3, query
from checks.statistics import rounded
from kongrid.functions import color, geometry as geo, regions
from kongrid.operators import grids, neighborhood as nb, stats
from kongrid.operators.warp import warp
from kongrid.sources import adapters as A


def mirror(p, n):
    return f"(CASE WHEN {p} < 0 THEN -({p}) WHEN {p} >= {n} THEN 2 * ({n} - 1) - ({p}) ELSE {p} END)"


def blur_sql(src, dst, sigma, radius, height, width):
    kern = f"""(SELECT k, exp(-k * k / {2 * sigma * sigma}) / sum(exp(-k * k / {2 * sigma * sigma})) OVER () AS w
      FROM (SELECT CAST(unnest(range({-radius}, {radius + 1})) AS INTEGER) AS k))"""
    return f"""{dst}_x AS (SELECT g.grid_id, g.y, g.x, sum(w * s.v) AS v FROM {src} g CROSS JOIN {kern} kk
      JOIN {src} s ON s.grid_id = g.grid_id AND s.y = g.y AND s.x = {mirror('g.x + k', width)} GROUP BY 1, 2, 3),
    {dst} AS (SELECT g.grid_id, g.y, g.x, sum(w * s.v) AS v FROM {dst}_x g CROSS JOIN {kern} kk
      JOIN {dst}_x s ON s.grid_id = g.grid_id AND s.x = g.x AND s.y = {mirror('g.y + k', height)} GROUP BY 1, 2, 3)"""


def sobel_sql(src, dst, height, width):
    taps = "(VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) t(dy, dx, wx, wy)"
    return f"""{dst} AS (SELECT g.grid_id, g.y, g.x, any_value(g.v) AS v, sum(wx * s.v) AS gx, sum(wy * s.v) AS gy,
      sqrt(sum(wx * s.v)^2 + sum(wy * s.v)^2) AS mag
      FROM {src} g CROSS JOIN {taps} JOIN {src} s ON s.grid_id = g.grid_id
       AND s.y = {mirror('g.y + dy', height)} AND s.x = {mirror('g.x + dx', width)} GROUP BY 1, 2, 3)"""


# values of G1 folded to 0-255 so that grey-level operators apply
BYTES = "gb AS (SELECT grid_id, y, x, CAST(CAST(floor(v) AS BIGINT) % 256 AS DOUBLE) AS v FROM g1)"


def byte_grid(spark, sf):
    return A.event_grid(spark, sf).withColumn("v", (F.floor("v") % 256).cast("double"))


@query("src5_densify", f"""WITH {G3} SELECT i.grid_id, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, round(coalesce(g.v, -1.0), 2) AS v
FROM (SELECT DISTINCT grid_id FROM g3) i CROSS JOIN (SELECT unnest(range(51)) AS y) a CROSS JOIN (SELECT unnest(range(11)) AS x) b
LEFT JOIN g3 g ON g.grid_id = i.grid_id AND g.y = a.y AND g.x = b.x""")
def src5(spark, sf):
    return rounded(grids.densify(A.price_grid(spark, sf), 51, 11, -1.0), "v", n=2)


@query("src4_area_downsample", f"""WITH {G2} SELECT grid_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) AS v FROM g2 GROUP BY 1, 2, 3""")
def src4(spark, sf):
    return rounded(grids.area_downsample(A.patch_grid(spark, sf), 4), "v")


@query("prd5_roi_crop", f"""WITH {G1} SELECT grid_id, y - 4 AS y, x - 0 AS x, v0 AS v, 0 AS x0, 4 AS y0
FROM (SELECT *, round(v, 4) AS v0 FROM g1) WHERE y >= 4 AND y < 17 AND x >= 0 AND x < 10""")
def prd5(spark, sf):
    g = rounded(A.event_grid(spark, sf), "v", n=4)
    return regions.roi_crop(g, F.lit(-3), F.lit(4), F.lit(10), F.lit(17))


@query("nb1_gaussian_blur", f"WITH {G1}, {blur_sql('g1', 'o', 2.0, 4, 30, 24)} SELECT grid_id, y, x, round(v, 5) AS v FROM o")
def nb1(spark, sf):
    return rounded(nb.gaussian_blur(A.event_grid(spark, sf), 2.0, 4), "v", n=5)


@query("nb2_sobel", f"""WITH {G1}, {sobel_sql('g1', 'o', 30, 24)} SELECT grid_id, y, x, round(gx, 5) + 0.0 AS gx, round(gy, 5) + 0.0 AS gy, round(mag, 5) AS mag FROM o""")
def nb2(spark, sf):
    g = rounded(nb.gradient(A.event_grid(spark, sf)).drop("v"), "gx", "gy", "mag", n=5)
    return g.withColumns({c: F.col(c) + 0.0 for c in ("gx", "gy")})


@query("nb2_gradient_patches", f"""WITH {G2}, {sobel_sql('g2', 'o', 8, 8)},
m AS (SELECT *, ln(1 + mag) AS m FROM o) SELECT grid_id, y, x, round(m / (max(m) OVER (PARTITION BY grid_id) + 1e-6), 6) AS mag FROM m""")
def nb2p(spark, sf):
    g = nb.gradient(A.patch_grid(spark, sf), log=True)
    return rounded(nb.per_grid_max(g, "mag").select("grid_id", "y", "x", "mag"), "mag")


@query("nb3_highpass", f"""WITH {G1}, {blur_sql('g1', 'o', 3.0, 9, 30, 24)}
SELECT grid_id, y, x, round(greatest(0.0, g1.v - o.v), 5) AS v FROM g1 JOIN o USING (grid_id, y, x)""")
def nb3(spark, sf):
    return rounded(nb.highpass(A.event_grid(spark, sf), 3.0, 9), "v", n=5)


CLAHE = f"""
t0 AS (SELECT *, CAST(y // 8 AS INTEGER) AS ty, CAST(x // 6 AS INTEGER) AS tx, CAST(v AS INTEGER) AS l FROM gb),
h0 AS (SELECT grid_id, ty, tx, l, count(*) AS c FROM t0 GROUP BY 1, 2, 3, 4),
h1 AS (SELECT a.*, sum(c) OVER (PARTITION BY grid_id, ty, tx) AS area FROM
       (SELECT t.grid_id, t.ty, t.tx, b.l, coalesce(h0.c, 0) AS c FROM (SELECT DISTINCT grid_id, ty, tx FROM t0) t
        CROSS JOIN (SELECT CAST(unnest(range(256)) AS INTEGER) AS l) b LEFT JOIN h0 ON h0.grid_id = t.grid_id AND h0.ty = t.ty AND h0.tx = t.tx AND h0.l = b.l) a),
h2 AS (SELECT *, greatest(1, floor(2.0 * area / 256)) AS lim FROM h1),
h3 AS (SELECT *, CAST(sum(greatest(0, c - lim)) OVER (PARTITION BY grid_id, ty, tx) AS BIGINT) AS ex FROM h2),
h4 AS (SELECT *, greatest(1, floor(256 / greatest(1, ex % 256))) AS gap FROM h3),
h5 AS (SELECT grid_id, ty, tx, l, area, least(c, lim) + ex // 256 + CASE WHEN l % gap = 0 AND l / gap < ex % 256 THEN 1 ELSE 0 END AS e FROM h4),
lut AS (SELECT grid_id, ty, tx, l, sum(e) OVER (PARTITION BY grid_id, ty, tx ORDER BY l) * 255.0 / area AS f FROM h5),
w0 AS (SELECT *, y / 8.0 - 0.5 AS fy, x / 6.0 - 0.5 AS fx FROM t0),
eq AS (SELECT w.grid_id, w.y, w.x, sum(lut.f * CASE WHEN i = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END
                                             * CASE WHEN j = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) AS v
       FROM w0 w CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(i, j)
       JOIN lut ON lut.grid_id = w.grid_id AND lut.l = w.l AND lut.ty = greatest(0, least(3, floor(fy) + i)) AND lut.tx = greatest(0, least(3, floor(fx) + j))
       GROUP BY 1, 2, 3)"""


@query("nb4_tile_equalize", f"WITH {G1}, {BYTES}, {CLAHE} SELECT grid_id, y, x, round(v, 9) AS v FROM eq")
def nb4(spark, sf):
    return rounded(nb.tile_equalize(byte_grid(spark, sf), 2.0, 4, 4), "v", n=9)


def box_sql(src, dst, fn, hy, hx):
    return f"""{dst} AS (SELECT a.grid_id, a.y, a.x, {fn}(b.v) AS v FROM {src} a JOIN {src} b ON b.grid_id = a.grid_id
      AND b.y BETWEEN a.y - {hy} AND a.y + {hy} AND b.x BETWEEN a.x - {hx} AND a.x + {hx} GROUP BY 1, 2, 3)"""


@query("nb5_top_hat", f"""WITH {G1}, {box_sql('g1', 'er', 'min', 2, 6)}, {box_sql('er', 'op', 'max', 2, 6)}
SELECT grid_id, y, x, round((g1.v - op.v) / 255.0, 6) AS v FROM g1 JOIN op USING (grid_id, y, x)""")
def nb5(spark, sf):
    return rounded(nb.top_hat(A.event_grid(spark, sf)), "v")


EDGES = """
nm AS (SELECT o.*, coalesce(CASE WHEN abs(gy) < abs(gx) * 0.41421356237 THEN l.mag WHEN abs(gy) > abs(gx) * 2.41421356237 THEN u.mag
                                 WHEN gx * gy > 0 THEN lu.mag ELSE ru.mag END, 0) AS pre,
              coalesce(CASE WHEN abs(gy) < abs(gx) * 0.41421356237 THEN r.mag WHEN abs(gy) > abs(gx) * 2.41421356237 THEN d.mag
                            WHEN gx * gy > 0 THEN rd.mag ELSE ld.mag END, 0) AS post
  FROM o {joins}),
ridge AS (SELECT grid_id, y, x, mag FROM nm WHERE mag > pre AND mag >= post AND mag > 70),
linked AS (SELECT grid_id, y, x FROM ridge WHERE mag > {high}
  UNION SELECT w.grid_id, w.y, w.x FROM ridge w JOIN linked k ON w.grid_id = k.grid_id AND abs(w.y - k.y) <= 1 AND abs(w.x - k.x) <= 1)"""
_JOINS = " ".join(
    f"LEFT JOIN (SELECT grid_id, y + ({-dy}) AS y, x + ({-dx}) AS x, mag FROM o) {n} ON {n}.grid_id = o.grid_id AND {n}.y = o.y AND {n}.x = o.x"
    for n, dy, dx in [("l", 0, -1), ("r", 0, 1), ("u", -1, 0), ("d", 1, 0), ("lu", -1, -1), ("ru", -1, 1), ("ld", 1, -1), ("rd", 1, 1)]
)


@query("nb6_edge_cells", f"""WITH RECURSIVE {G1}, {BYTES}, {sobel_sql('gb', 'o', 30, 24)}, {EDGES.format(joins=_JOINS, high=500)}
SELECT gb.grid_id, gb.y, gb.x, gb.v, linked.y IS NOT NULL AS edge FROM gb LEFT JOIN linked USING (grid_id, y, x)""")
def nb6(spark, sf):
    return nb.edge_cells(byte_grid(spark, sf), 70, 500)


@query("nb7_bilinear_sample", f"""WITH {G1}, p AS (SELECT event_type AS grid_id, event_id, value % 26 AS px, event_id % 311 / 10.0 AS py FROM events)
SELECT p.grid_id, event_id, px, py, round(
  a.v * (1 - (px - floor(px))) * (1 - (py - floor(py))) + b.v * (px - floor(px)) * (1 - (py - floor(py)))
  + c.v * (1 - (px - floor(px))) * (py - floor(py)) + d.v * (px - floor(px)) * (py - floor(py)), 5) AS v
FROM p JOIN g1 a ON a.grid_id = p.grid_id AND a.x = floor(px) AND a.y = floor(py)
 JOIN g1 b ON b.grid_id = p.grid_id AND b.x = floor(px) + 1 AND b.y = floor(py)
 JOIN g1 c ON c.grid_id = p.grid_id AND c.x = floor(px) AND c.y = floor(py) + 1
 JOIN g1 d ON d.grid_id = p.grid_id AND d.x = floor(px) + 1 AND d.y = floor(py) + 1""")
def nb7(spark, sf):
    p = A.table(spark, sf, "events").select(
        F.col("event_type").alias("grid_id"), "event_id", (F.col("value") % 26).alias("px"), (F.col("event_id") % 311 / 10.0).alias("py")
    )
    return rounded(nb.bilinear_sample(A.event_grid(spark, sf), p), "v", n=5)


@query("jn1_make_pairs", """SELECT r.vec_id AS ref_id, c.vec_id AS cand_id, r.vec_id || '|' || c.vec_id AS pair_id
FROM embeddings c JOIN embeddings r ON r.vec_id = c.vec_id - 1 WHERE c.vec_id % 2 = 1""")
def jn1(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_id"), F.floor(F.col("vec_id") / 2).alias("k"))
    return grids.make_pairs(e.where("grid_id % 2 = 0"), e.where("grid_id % 2 = 1"), ["k"]).drop("k")


def patch_pairs(spark, sf):
    g = A.patch_grid(spark, sf)
    ids = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_id"), F.floor(F.col("vec_id") / 2).alias("k"))
    pairs = grids.make_pairs(ids.where("grid_id % 2 = 0"), ids.where("grid_id % 2 = 1"), ["k"]).drop("k")
    return g, pairs


# Every pair of a group of eight grids, the smaller id as reference.
@query("jn1_pairs_before", """SELECT r.vec_id AS ref_id, c.vec_id AS cand_id, r.vec_id || '|' || c.vec_id AS pair_id
FROM embeddings c JOIN embeddings r ON r.vec_id // 8 = c.vec_id // 8 AND r.vec_id < c.vec_id""")
def jn1_before(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("vec_id").alias("grid_id"), F.floor(F.col("vec_id") / 8).alias("k"))
    return grids.make_pairs(e, e, ["k"], "before").drop("k")


@query("jn2_compare_cells", f"""WITH {G2}, r AS (SELECT * FROM g2 WHERE grid_id % 2 = 0), c AS (SELECT grid_id, y, x + 1 AS x, v FROM g2 WHERE grid_id % 2 = 1),
r2 AS (SELECT grid_id || '|' || (grid_id + 1) AS pair_id, y, x, v FROM r WHERE grid_id + 1 IN (SELECT vec_id FROM embeddings)),
c2 AS (SELECT (grid_id - 1) || '|' || grid_id AS pair_id, y, x, v FROM c)
SELECT coalesce(r2.pair_id, c2.pair_id) AS pair_id, coalesce(r2.y, c2.y) AS y, coalesce(r2.x, c2.x) AS x, r2.v AS ref_v, c2.v AS cand_v,
  round(abs(r2.v - c2.v), 6) AS diff, round(r2.v * 0.5 + c2.v * 0.5, 6) AS overlay
FROM r2 FULL JOIN c2 ON c2.pair_id = r2.pair_id AND c2.y = r2.y AND c2.x = r2.x""")
def jn2(spark, sf):
    g, pairs = patch_pairs(spark, sf)
    # candidates lie one column to the right, so each side has a column that the other lacks
    c = grids.compare_cells(g, g.withColumn("x", F.col("x") + 1), pairs)
    return c.withColumns({
        "diff": F.round(color.abs_diff(F.col("ref_v"), F.col("cand_v")), 6),
        "overlay": F.round(color.blend(F.col("ref_v"), F.col("cand_v"), 0.5), 6),
    })


WARP_SQL = """, t AS (SELECT grid_id, 0.9 * cos(radians(10)) AS a, 0.9 * sin(radians(10)) AS b FROM (SELECT DISTINCT grid_id FROM g1)),
m AS (SELECT grid_id, a, b, 12 - a * 12 - b * 15 + 1.5 AS tx, 15 + b * 12 - a * 15 - 0.75 AS ty FROM t),
o AS (SELECT m.grid_id, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, round((a * (xx - tx) - b * (yy - ty)) / (a * a + b * b), 9) AS px,
   round((b * (xx - tx) + a * (yy - ty)) / (a * a + b * b), 9) AS py FROM m CROSS JOIN (SELECT unnest(range(30)) AS yy) CROSS JOIN (SELECT unnest(range(26)) AS xx)),
f AS (SELECT *, px BETWEEN 0 AND 23 AND py BETWEEN 0 AND 29 AS valid, floor(px) AS ix, floor(py) AS iy, px - floor(px) AS dx, py - floor(py) AS dy FROM o)
SELECT f.grid_id, f.y, f.x, f.valid, CASE WHEN f.valid THEN round(
   a.v * (1 - dx) * (1 - dy) + coalesce(b.v, 0) * dx * (1 - dy) + coalesce(c.v, 0) * (1 - dx) * dy + coalesce(d.v, 0) * dx * dy, 4) ELSE 18.0 END AS v
FROM f LEFT JOIN g1 a ON a.grid_id = f.grid_id AND a.x = ix AND a.y = iy LEFT JOIN g1 b ON b.grid_id = f.grid_id AND b.x = ix + 1 AND b.y = iy
 LEFT JOIN g1 c ON c.grid_id = f.grid_id AND c.x = ix AND c.y = iy + 1 LEFT JOIN g1 d ON d.grid_id = f.grid_id AND d.x = ix + 1 AND d.y = iy + 1"""


@query("jn3_warp", f"WITH {G1}{WARP_SQL}")
def jn3(spark, sf):
    g = A.event_grid(spark, sf)
    t = g.select("grid_id").distinct().withColumn("m", geo.rotate_scale_about(12, 15, 10, 0.9, 1.5, -0.75))
    return rounded(warp(g, t, 30, 26, out=["grid_id"]), "v", n=4)


@query("jn3_warp_nearest", f"""WITH {G2}, o AS (SELECT *, floor(x * 0.5 + 0.25 + 0.5) AS sx, floor(y * 0.5 + 0.5) AS sy FROM
  (SELECT DISTINCT grid_id FROM g2) CROSS JOIN (SELECT CAST(unnest(range(18)) AS INTEGER) AS y) CROSS JOIN (SELECT CAST(unnest(range(18)) AS INTEGER) AS x))
SELECT o.grid_id, o.y, o.x, coalesce(s.v, 0.0) AS v, s.v IS NOT NULL AS valid FROM o LEFT JOIN g2 s ON s.grid_id = o.grid_id AND s.x = sx AND s.y = sy""")
def jn3n(spark, sf):
    g = A.patch_grid(spark, sf)
    t = g.select("grid_id").distinct().withColumn("m", geo.matrix(2, 0, -0.5, 0, 2, 0, 0, 0, 1))
    return warp(g, t, 18, 18, fill=0.0, method="nearest", out=["grid_id"])


@query("jn4_edge_overlap", f"""WITH {G2}, r AS (SELECT grid_id // 2 AS k, y, x, v FROM g2 WHERE grid_id % 2 = 0), c AS (SELECT grid_id // 2 AS k, y, x, v FROM g2 WHERE grid_id % 2 = 1),
j AS (SELECT k, y, x, r.v > 0.15 AS re, c.v > 0.15 AS ce FROM r JOIN c USING (k, y, x))
SELECT (2 * k) || '|' || (2 * k + 1) AS pair_id, count(*) FILTER (re AND ce) AS edges_both, count(*) FILTER (re AND NOT ce) AS edges_reference,
 count(*) FILTER (ce AND NOT re) AS edges_candidate, count(*) FILTER (NOT re AND NOT ce) AS edges_none,
 CAST(sum(CASE WHEN re OR ce THEN 255 ELSE 18 END) AS BIGINT) AS blue FROM j GROUP BY k""")
def jn4(spark, sf):
    g, pairs = patch_pairs(spark, sf)
    g = g.select("grid_id", "y", "x", (F.col("v") > 0.15).alias("edge"))
    e = grids.edge_overlap(grids.compare_cells(g, g, pairs), "ref_edge", "cand_edge")
    blue = e.groupBy("pair_id").agg(F.sum("edge_b").cast("long").alias("blue"))
    return grids.edge_counts(e).join(blue, "pair_id")


@query("ag12_diff_summary", f"""WITH {G2}, j AS (SELECT r.grid_id AS a, abs(r.v - c.v) AS d FROM g2 r JOIN g2 c ON c.grid_id = r.grid_id + 1 AND c.y = r.y AND c.x = r.x WHERE r.grid_id % 2 = 0)
SELECT a || '|' || (a + 1) AS pair_id, count(*) AS cells, round(avg(d), 6) AS mean_diff, round(max(d), 6) AS max_diff,
 round(avg(CASE WHEN d > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM j GROUP BY a""")
def ag12(spark, sf):
    g, pairs = patch_pairs(spark, sf)
    d = stats.diff_summary(grids.compare_cells(g, g, pairs), "ref_v", "cand_v", ["pair_id"], 0.1)
    return rounded(d, "mean_diff", "max_diff", "share_above")


@query("fn20_color_map", """SELECT p_partkey, CAST(level AS DOUBLE) AS v, CAST(255 - level AS DOUBLE) AS b, CAST(level * 2 % 256 AS DOUBLE) AS g, CAST(level AS DOUBLE) AS r
FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) % 256 AS level FROM part)""")
def fn20(spark, sf):
    p = A.table(spark, sf, "part").select("p_partkey", (F.floor("p_retailprice") % 256).cast("double").alias("v"))
    lv = F.col("level")
    lut = spark.range(256).select(
        F.col("id").cast("int").alias("level"), (255 - F.col("id")).cast("double").alias("b"),
        (F.col("id") * 2 % 256).cast("double").alias("g"), F.col("id").cast("double").alias("r"),
    )
    return color.color_map(p, "v", lut)
