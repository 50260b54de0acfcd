"""Detection and search queries (AG-7..10, TK-2, TK-3, AL-1..6, NB-10).

Queries on event grids and patches equal brute-force SQL. Queries on drawn dials report whether the
known parameters of each supplier's dial were recovered, which the SQL states from the table.
"""

from pyspark.sql import functions as F

from checks.base import G1, G2, query
from checks.gridchecks import BYTES, blur_sql, byte_grid, sobel_sql
from checks.statistics import rounded
from kongrid.functions import geometry as geo
from kongrid.operators import detect, neighborhood as nb, profiles as P, search
from kongrid.sources import adapters as A


def event_anchor(spark, sf, cx=12.0, cy=15.0, r=8.0):
    return A.table(spark, sf, "events").select(F.col("event_type").alias("grid_id")).distinct().select("grid_id", *[F.lit(v).alias(n) for n, v in (("cx", cx), ("cy", cy), ("r", r))])


DIST = "sqrt((x - 12.0)^2 + (y - 15.0)^2)"
ANG = "(((degrees(atan2(x - 12.0, 15.0 - y)) % 360) + 360) % 360)"


@query("ag7_radial_profile", f"""WITH {G1}, {blur_sql('g1', 'bl', 1.1, 2, 30, 24)}, {sobel_sql('bl', 'o', 30, 24)},
d AS (SELECT *, {DIST} AS d, {ANG} AS a FROM o),
s AS (SELECT grid_id, d, CASE WHEN (a > 135 AND a < 225) OR (a > 70 AND a < 110) THEN 0.0 ELSE abs(gx * (x - 12.0) / greatest(d, 1e-6) + gy * (y - 15.0) / greatest(d, 1e-6)) END AS s FROM d)
SELECT grid_id, ring, round(quantile_cont(s, 0.85), 5) AS strength FROM s JOIN (SELECT CAST(unnest(range(10, 17)) AS INTEGER) AS ring) ON abs(d - ring) <= 1.2 WHERE ring <= least(11, 16) GROUP BY 1, 2""")
def ag7(spark, sf):
    prof, _ = detect.radial_profile(A.event_grid(spark, sf), event_anchor(spark, sf, r=12.0))
    return rounded(prof, "strength", n=5)


@query("ag7_refine_anchor", "SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, true AS radius_ok FROM supplier")
def ag7r(spark, sf):
    dials, p = A.supplier_dials(spark, sf)
    found = detect.refine_anchor(dials, p.select("grid_id", "cx", "cy", (F.col("r") * 1.08).alias("r")))
    return found.select("grid_id", F.col("r").alias("found")).join(p, "grid_id").select("grid_id", (F.abs(F.col("found") - F.col("r")) <= 2.0).alias("radius_ok"))


@query("ag8_circular_signature")
def ag8(spark, sf):
    dials, p = A.supplier_dials(spark, sf)
    return rounded(detect.circular_signature(dials, p.select("grid_id", "cx", "cy", "r")), "v")


@query("ag8_rotation_recovery", "SELECT CAST(s_suppkey AS VARCHAR) AS pair_id, true AS rotation_ok, true AS score_ok FROM supplier")
def ag8r(spark, sf):
    k = F.col("s_suppkey").cast("string")
    ref, rp = A.supplier_dials(spark, sf, grid_id=F.concat(F.lit("r"), k), rotation=F.lit(0.0))
    cand, cp = A.supplier_dials(spark, sf, grid_id=F.concat(F.lit("c"), k))
    anchors = rp.unionByName(cp).select("grid_id", "cx", "cy", "r")
    sig = detect.circular_signature(ref.unionByName(cand), anchors)
    pairs = cp.select(F.substring("grid_id", 2, 20).alias("pair_id"), F.concat(F.lit("r"), F.substring("grid_id", 2, 20)).alias("ref_id"), F.col("grid_id").alias("cand_id"), F.col("rotation").alias("truth"))
    best = P.circular_xcorr(P.pack_profiles(sig, 1440), pairs, 1440, 15.0)
    return best.select("pair_id", (F.abs(geo.wrap180(-F.col("degrees") - F.col("truth"))) <= 1.0).alias("rotation_ok"), (F.col("score") > 0.4).alias("score_ok"))


@query("ag9_circle_votes", f"""WITH {G1}, {BYTES}, {sobel_sql('gb', 'o', 30, 24)}, e AS (SELECT * FROM o WHERE mag > 200),
v AS (SELECT grid_id, CAST(floor(round((x + s * r * gx / mag) / 2, 6) + 0.5) * 2 AS INTEGER) AS cx, CAST(floor(round((y + s * r * gy / mag) / 2, 6) + 0.5) * 2 AS INTEGER) AS cy, r
  FROM e CROSS JOIN (SELECT CAST(unnest(range(4, 8)) AS INTEGER) AS r) CROSS JOIN (VALUES (-1.0::DOUBLE), (1.0)) t(s))
SELECT grid_id, cx, cy, r, count(*) AS votes FROM v GROUP BY 1, 2, 3, 4""")
def ag9(spark, sf):
    e = nb.gradient(byte_grid(spark, sf)).where("mag > 200")
    return detect.circle_votes(e, 4, 7, bin_size=2)


@query("tk2_threshold_cascade", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity + l_discount * 100 AS INTEGER) AS votes FROM lineitem),
c AS (SELECT * FROM v JOIN (VALUES (0, 60), (1, 55), (2, 50), (3, 45), (4, 40), (5, 35)) t(lv, threshold) ON votes >= threshold),
n AS (SELECT l_orderkey, lv.lv, count(c.votes) AS seen FROM (SELECT DISTINCT l_orderkey FROM v) s CROSS JOIN (SELECT unnest(range(6)) AS lv) lv LEFT JOIN c USING (l_orderkey, lv) GROUP BY 1, 2),
r AS (SELECT *, sum(seen) OVER (PARTITION BY l_orderkey ORDER BY lv) AS upto FROM n), s AS (SELECT l_orderkey, coalesce(min(lv) FILTER (upto >= 3), 5) AS stop FROM r GROUP BY 1)
SELECT l_orderkey, l_linenumber, votes, threshold FROM c JOIN s USING (l_orderkey) WHERE lv <= stop""")
def tk2(spark, sf):
    li = A.table(spark, sf, "lineitem")
    v = li.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.col("l_discount") * 100).cast("int").alias("votes"))
    return detect.threshold_cascade(v, by=["l_orderkey"])


@query("tk3_ray_edges", f"""WITH {G1}, {blur_sql('g1', 'bl', 2.0, 3, 30, 24)}, {sobel_sql('bl', 'o', 30, 24)},
lv AS (SELECT grid_id, quantile_cont(mag, 0.70) AS lvl FROM o GROUP BY 1),
p AS (SELECT CAST(ray AS INTEGER) AS ray, k, 12.0 + (8 * 0.75 + k * 0.5) * cos(radians(ray * 5.0)) AS px, 15.0 + (8 * 0.75 + k * 0.5) * sin(radians(ray * 5.0)) AS py
  FROM (SELECT unnest(range(72)) AS ray) CROSS JOIN (SELECT unnest(range(10)) AS k)),
q AS (SELECT *, floor(px) AS ix, floor(py) AS iy, px - floor(px) AS dx, py - floor(py) AS dy FROM p),
s AS (SELECT a.grid_id, ray, k, px, py, a.mag * (1 - dx) * (1 - dy) + b.mag * dx * (1 - dy) + c.mag * (1 - dx) * dy + d.mag * dx * dy AS v
  FROM q JOIN o a ON a.x = ix AND a.y = iy JOIN o b ON b.grid_id = a.grid_id AND b.x = ix + 1 AND b.y = iy JOIN o c ON c.grid_id = a.grid_id AND c.x = ix AND c.y = iy + 1 JOIN o d ON d.grid_id = a.grid_id AND d.x = ix + 1 AND d.y = iy + 1),
b AS (SELECT *, row_number() OVER (PARTITION BY grid_id, ray ORDER BY v DESC, k) AS n FROM s)
SELECT b.grid_id, ray, round(px, 6) AS px, round(py, 6) AS py, round(v, 5) AS v FROM b JOIN lv USING (grid_id) WHERE n = 1 AND v > lvl""")
def tk3(spark, sf):
    return rounded(rounded(detect.ray_edges(A.event_grid(spark, sf), event_anchor(spark, sf)), "px", "py"), "v", n=5)


RATIO = "(CASE s_suppkey % 4 WHEN 0 THEN 0.97 WHEN 1 THEN 0.85 WHEN 2 THEN 0.82 ELSE 0.6 END)"


def tilted(spark, sf):
    k = F.col("s_suppkey") % 4
    return A.supplier_dials(spark, sf, ratio=F.when(k == 0, 0.97).when(k == 1, 0.85).when(k == 2, 0.82).otherwise(0.6))


@query("ag10_fit_ellipse", f"SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, CASE WHEN {RATIO} > 0.8 THEN true END AS center_ok, CASE WHEN {RATIO} > 0.8 THEN true END AS major_ok, CASE WHEN {RATIO} > 0.8 THEN true END AS ratio_ok FROM supplier")
def ag10(spark, sf):
    dials, p = tilted(spark, sf)
    a = p.select("grid_id", "cx", "cy", "r")
    fit = detect.fit_ellipse(detect.ray_edges(dials, a), a).where("applied").select("grid_id", "ellipse")
    j = p.join(fit, "grid_id", "left")
    e = F.col("ellipse")

    def seen(ok):  # dials squashed further than the fit's own limit have no true ellipse to meet
        return F.when(F.col("ratio") > 0.8, F.coalesce(ok, F.lit(False)))

    return j.select(
        "grid_id", seen(F.hypot(e["cx"] - F.col("cx"), e["cy"] - F.col("cy")) <= 1.5).alias("center_ok"),
        seen(F.abs(e["semi_major"] / F.col("r") - 1) <= 0.08).alias("major_ok"), seen(F.abs(e["semi_minor"] / e["semi_major"] - F.col("ratio")) <= 0.05).alias("ratio_ok"),
    )


@query("al5_dewarp", f"SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, {RATIO} IN (0.85, 0.82) AS dewarp_applied FROM supplier")
def al5(spark, sf):
    dials, p = tilted(spark, sf)
    return detect.dewarp_decision(dials, p.select("grid_id", "cx", "cy", "r")).select("grid_id", "dewarp_applied")


@query("al5_dewarped_shape", f"SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, CASE WHEN {RATIO} IN (0.85, 0.82) THEN true END AS round_ok FROM supplier")
def al5s(spark, sf):
    dials, p = tilted(spark, sf)
    a = p.select("grid_id", "cx", "cy", "r")
    flat = detect.dewarp(dials, a)
    fit = p.select("grid_id", "ratio").join(detect.fit_ellipse(detect.ray_edges(flat, a), a).select("grid_id", "ellipse"), "grid_id", "left")
    is_round = F.coalesce(F.col("ellipse.semi_minor") / F.col("ellipse.semi_major") > 0.93, F.lit(False))
    return fit.select("grid_id", F.when(F.col("ratio").isin(0.85, 0.82), is_round).alias("round_ok"))


@query("al1_orientation", "SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, true AS angle_ok, true AS markers_ok FROM supplier")
def al1(spark, sf):
    dials, p = A.supplier_dials(spark, sf)
    o = detect.orientation(dials, p.select("grid_id", "cx", "cy", "r")).join(p.select("grid_id", "rotation"), "grid_id")
    return o.select("grid_id", (F.abs(geo.wrap180(F.col("angle") - F.col("rotation"))) <= 1.0).alias("angle_ok"), (F.col("markers") >= 6).alias("markers_ok"))


@query("al2_shift_search", f"""WITH {G2}, sh AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(range(-2, 3)) AS a) CROSS JOIN (SELECT unnest(range(-2, 3)) AS b)),
c AS (SELECT r.grid_id, dx, dy, count(*) AS cells, round(coalesce(corr(r.v, c.v), 0), 6) AS score FROM g2 r CROSS JOIN sh JOIN g2 c ON c.grid_id = r.grid_id + 1 AND c.y = r.y - dy AND c.x = r.x - dx WHERE r.grid_id % 2 = 0 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY score DESC, abs(dx) + abs(dy), dy, dx) AS n FROM c)
SELECT grid_id || '|' || (grid_id + 1) AS pair_id, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, cells, score FROM k WHERE n = 1""")
def al2(spark, sf):
    from checks.gridchecks import patch_pairs

    g, pairs = patch_pairs(spark, sf)
    s = search.shift_search(g, g, pairs, 2, side=8, outer=1e9, min_cells=20)
    return rounded(s.select("pair_id", "dx", "dy", "cells", "score"), "score")


def couples(spark, sf, **over):
    """Reference and candidate dials per supplier, in pairs."""
    k = F.col("s_suppkey").cast("string")
    ref, rp = A.supplier_dials(spark, sf, grid_id=F.concat(F.lit("r"), k), rotation=F.lit(0.0))
    cand, cp = A.supplier_dials(spark, sf, grid_id=F.concat(F.lit("c"), k), **over)
    pid = F.substring("grid_id", 2, 20)
    pairs = cp.select(pid.alias("pair_id"), F.concat(F.lit("r"), pid).alias("ref_id"), F.col("grid_id").alias("cand_id"))
    return ref, rp, cand, cp, pairs


@query("al3_scale_shift_search", "SELECT CAST(s_suppkey AS VARCHAR) AS pair_id, true AS scale_ok, true AS shift_ok, true AS applied FROM supplier")
def al3(spark, sf):
    k = F.col("s_suppkey")
    ref, rp, cand, cp, pairs = couples(spark, sf, rotation=F.lit(0.0), r=(28.0 + k % 4) * F.when(k % 2 == 0, 0.9).otherwise(1.08), cx=48.0 + k % 7 - 1, cy=47.0 + k % 5 - 5)
    maps = [nb.feature_map(g, "dial") for g in (ref, cand)]
    s = search.scale_shift_search(maps[0], maps[1], pairs, rp.select("grid_id", "cx", "cy", "r"))
    t = s.withColumn("k", F.col("pair_id").cast("long"))
    px, py = geo.apply_transform(48.0 + F.col("k") % 7 - 1, 47.0 + F.col("k") % 5 - 5, F.col("m"))
    truth = F.when(F.col("k") % 2 == 0, 1 / 0.9).otherwise(1 / 1.08)
    miss = F.hypot(px - (48.0 + F.col("k") % 7 - 3), py - (47.0 + F.col("k") % 5 - 2))
    return t.select("pair_id", (F.abs(F.col("scale") / truth - 1) <= 0.025).alias("scale_ok"), (miss <= 2.0).alias("shift_ok"), "applied")


@query("al4_refine_local", "SELECT CAST(s_suppkey AS VARCHAR) AS pair_id, true AS shift_ok, true AS rotation_ok, true AS applied FROM supplier")
def al4(spark, sf):
    k = F.col("s_suppkey")
    ref, rp, cand, cp, pairs = couples(spark, sf, rotation=F.lit(1.0), cx=48.0 + k % 7 - 2, cy=47.0 + k % 5 - 4)
    maps = [nb.feature_map(g, "gradient") for g in (ref, cand)]
    s = search.refine_local(maps[0], maps[1], pairs, rp.select("grid_id", "cx", "cy", "r"))
    t = s.withColumn("k", F.col("pair_id").cast("long"))
    px, py = geo.apply_transform(48.0 + F.col("k") % 7 - 2, 47.0 + F.col("k") % 5 - 4, F.col("m"))
    miss = F.hypot(px - (48.0 + F.col("k") % 7 - 3), py - (47.0 + F.col("k") % 5 - 2))
    return t.select("pair_id", (miss <= 1.5).alias("shift_ok"), (F.abs(F.col("rotation") - 1.0) <= 1.0).alias("rotation_ok"), "applied")


# A patch turned and scaled about its middle, sampled bilinearly; `t` has (k, s, a): preference, scale and degrees.
TURN = """p AS (SELECT k, s, a, y, x, cos(radians(a)) / s * (x - 3.5) - sin(radians(a)) / s * (y - 3.5) + 3.5 AS sx, sin(radians(a)) / s * (x - 3.5) + cos(radians(a)) / s * (y - 3.5) + 3.5 AS sy
  FROM t CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS y) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS x)),
q AS (SELECT *, CAST(least(floor(sx), 6) AS INTEGER) AS x0, CAST(least(floor(sy), 6) AS INTEGER) AS y0 FROM p WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7)"""


def turned_sql(name, shifts, steps, min_cells=20):
    """Correlation of every even patch with the next one, turned by each row of `steps` and moved by each of `shifts`."""
    return f"""{name}m AS (SELECT c.grid_id - 1 AS grid_id, k, s, a, q.y, q.x, (c.v * (1 - sx + x0) + d.v * (sx - x0)) * (1 - sy + y0) + (e.v * (1 - sx + x0) + f.v * (sx - x0)) * (sy - y0) AS w
  FROM {steps} q JOIN g2 c ON c.y = y0 AND c.x = x0 JOIN g2 d ON d.grid_id = c.grid_id AND d.y = y0 AND d.x = x0 + 1
  JOIN g2 e ON e.grid_id = c.grid_id AND e.y = y0 + 1 AND e.x = x0 JOIN g2 f ON f.grid_id = c.grid_id AND f.y = y0 + 1 AND f.x = x0 + 1 WHERE c.grid_id % 2 = 1),
{name}c AS (SELECT r.grid_id, k, s, a, dx, dy, count(*) AS cells, CASE WHEN count(*) >= {min_cells} THEN round(coalesce(corr(r.v, m.w), 0), 9) ELSE 0 END AS score
  FROM {name}m m CROSS JOIN (SELECT CAST(unnest(range(-{shifts}, {shifts + 1})) AS INTEGER) AS dx) CROSS JOIN (SELECT CAST(unnest(range(-{shifts}, {shifts + 1})) AS INTEGER) AS dy)
  JOIN g2 r ON r.grid_id = m.grid_id AND r.y = m.y + dy AND r.x = m.x + dx GROUP BY 1, 2, 3, 4, 5, 6),
{name}b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY score DESC, k, abs(dx) + abs(dy), dy, dx) AS n FROM {name}c) WHERE n = 1)"""


def middles(pairs):
    return pairs.select(F.col("ref_id").alias("grid_id"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"), F.lit(100.0).alias("r"))


# Every shift of whole cells is scored; the parabola through the best score and its two neighbours gives the rest.
@query("al2_peak", f"""WITH {G2}, sh AS (SELECT CAST(a AS INTEGER) AS dx, CAST(b AS INTEGER) AS dy FROM (SELECT unnest(range(-3, 4)) AS a) CROSS JOIN (SELECT unnest(range(-3, 4)) AS b)),
c AS (SELECT r.grid_id, dx, dy, count(*) AS cells, round(coalesce(corr(r.v, c.v), 0), 9) AS score FROM g2 r CROSS JOIN sh JOIN g2 c ON c.grid_id = r.grid_id + 1 AND c.y = r.y - dy AND c.x = r.x - dx WHERE r.grid_id % 2 = 0 GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY score DESC, abs(dx) + abs(dy), dy, dx) AS n FROM c WHERE abs(dx) <= 2 AND abs(dy) <= 2),
f AS (SELECT k.*, a.score AS xa, b.score AS xb, d.score AS ya, e.score AS yb FROM k JOIN c a ON a.grid_id = k.grid_id AND a.dx = k.dx - 1 AND a.dy = k.dy JOIN c b ON b.grid_id = k.grid_id AND b.dx = k.dx + 1 AND b.dy = k.dy
  JOIN c d ON d.grid_id = k.grid_id AND d.dx = k.dx AND d.dy = k.dy - 1 JOIN c e ON e.grid_id = k.grid_id AND e.dx = k.dx AND e.dy = k.dy + 1 WHERE n = 1)
SELECT grid_id || '|' || (grid_id + 1) AS pair_id, round(dx + CASE WHEN xa - 2 * score + xb < 0 THEN greatest(-0.5, least(0.5, 0.5 * (xa - xb) / (xa - 2 * score + xb))) ELSE 0.0 END, 5) AS peak_dx,
 round(dy + CASE WHEN ya - 2 * score + yb < 0 THEN greatest(-0.5, least(0.5, 0.5 * (ya - yb) / (ya - 2 * score + yb))) ELSE 0.0 END, 5) AS peak_dy FROM f""")
def al2_peak(spark, sf):
    from checks.gridchecks import patch_pairs

    g, pairs = patch_pairs(spark, sf)
    s = search.shift_search(g, g, pairs, 2, side=8, outer=1e9, min_cells=20)
    return rounded(s.select("pair_id", "peak_dx", "peak_dy"), "peak_dx", "peak_dy", n=5)


@query("al3_patches", f"""WITH {G2}, t AS (SELECT k, round(0.70 + 0.02 * k, 6) AS s, 0.0 AS a FROM (SELECT unnest(range(41)) AS k)), {TURN}, {turned_sql('o', 2, 'q')},
ft AS (SELECT grid_id AS g, j AS k, round(greatest(0.68, s - 0.035) + 0.002 * j, 6) AS s, 0.0 AS a FROM ob CROSS JOIN (SELECT unnest(range(40)) AS j) WHERE greatest(0.68, s - 0.035) + 0.002 * j < least(1.52, s + 0.035) + 0.0001),
fp AS (SELECT g, k, s, a, y, x, (x - 3.5) / s + 3.5 AS sx, (y - 3.5) / s + 3.5 AS sy FROM ft CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS y) CROSS JOIN (SELECT CAST(unnest(range(8)) AS INTEGER) AS x)),
fq AS (SELECT *, CAST(least(floor(sx), 6) AS INTEGER) AS x0, CAST(least(floor(sy), 6) AS INTEGER) AS y0 FROM fp WHERE sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7),
{turned_sql('f', 2, 'fq').replace("c.grid_id % 2 = 1", "c.grid_id = g + 1")}
SELECT ob.grid_id || '|' || (ob.grid_id + 1) AS pair_id, CAST(CASE WHEN fb.score > ob.score THEN fb.s ELSE ob.s END AS DOUBLE) AS scale, CAST(CASE WHEN fb.score > ob.score THEN fb.dx ELSE ob.dx END AS DOUBLE) AS dx,
 CAST(CASE WHEN fb.score > ob.score THEN fb.dy ELSE ob.dy END AS DOUBLE) AS dy, CASE WHEN fb.score > ob.score THEN fb.cells ELSE ob.cells END AS cells, round(greatest(fb.score, ob.score), 6) AS score FROM ob JOIN fb USING (grid_id)""")
def al3_patches(spark, sf):
    from checks.gridchecks import patch_pairs

    g, pairs = patch_pairs(spark, sf)
    s = search.scale_shift_search(g, g, pairs, middles(pairs), inner=0.0, min_cells=20)
    return rounded(s.select("pair_id", "scale", "dx", "dy", "cells", "score"), "score")


@query("al4_patches", f"""WITH {G2}, t AS (SELECT s, a, row_number() OVER (ORDER BY abs(s - 1) + abs(a) / 50, s, a) AS k FROM (SELECT unnest([0.97, 0.98, 0.99, 1.0, 1.01, 1.02, 1.03])::DOUBLE AS s)
  CROSS JOIN (SELECT unnest([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0])::DOUBLE AS a)), {TURN}, {turned_sql('o', 1, 'q')}
SELECT grid_id || '|' || (grid_id + 1) AS pair_id, s AS scale, a AS rotation, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, cells, round(score, 6) AS score FROM ob""")
def al4_patches(spark, sf):
    from checks.gridchecks import patch_pairs

    g, pairs = patch_pairs(spark, sf)
    s = search.refine_local(g, g, pairs, middles(pairs), inner=0.0, min_cells=20)
    return rounded(s.select("pair_id", "scale", "rotation", "dx", "dy", "cells", "score"), "score")


@query("al6_detect_anchor", "SELECT CAST(s_suppkey AS VARCHAR) AS grid_id, true AS center_ok, true AS radius_ok FROM supplier")
def al6(spark, sf):
    dials, p = A.supplier_dials(spark, sf)
    a = detect.detect_anchor(dials).select("grid_id", F.col("cx").alias("fx"), F.col("cy").alias("fy"), F.col("r").alias("fr")).join(p, "grid_id")
    return a.select("grid_id", (F.hypot(F.col("fx") - F.col("cx"), F.col("fy") - F.col("cy")) <= 2.0).alias("center_ok"), (F.abs(F.col("fr") - F.col("r")) <= 2.5).alias("radius_ok"))


def _features(kind):
    def run(spark, sf):
        return rounded(nb.feature_map(byte_grid(spark, sf), kind, side=24), "v")

    return run


for _kind in ("gradient", "text", "dial"):
    query(f"nb10_feature_map_{_kind}")(_features(_kind))
