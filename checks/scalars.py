"""Scalar, predicate, gate, store and request queries (FN, PRD, SNK, SRC-2, TK-5, TK-6)."""

import uuid

from pyspark.sql import functions as F

from checks.base import COLORS, D1, G1, R1, query, wrap
from checks.statistics import rounded
from kongrid.functions import color, gates, geometry as geo, regions
from kongrid.operators import exports, recency
from kongrid.operators.cut import shared_dir
from kongrid.operators.stats import appearance_report
from kongrid.sources import adapters as A
from kongrid.sources import images, store

CELLS = [f"m{i}{j}" for i in range(3) for j in range(3)]


def unpack(df, *names, n=6):
    """Matrix structs to rounded columns."""
    cols = [F.round(F.col(f"{m}.{c}"), n).alias(f"{m}_{c}") for m in names for c in CELLS]
    return df.select(*[c for c in df.columns if c not in names], *cols).withColumns({f"{m}_{c}": F.col(f"{m}_{c}") + 0.0 for m in names for c in CELLS})


def matrix_sql(name, rows, n=6):
    return ", ".join(f"round(CAST({v} AS DOUBLE), {n}) + 0.0 AS {name}_{c}" for v, c in zip(rows, CELLS))


def rot_sql(cx, cy, deg, s, dx="0", dy="0"):
    a, b = f"({s} * cos(radians({deg})))", f"({s} * sin(radians({deg})))"
    return [a, b, f"((1 - {a}) * {cx} - {b} * {cy} + {dx})", f"(-{b})", a, f"({b} * {cx} + (1 - {a}) * {cy} + {dy})", "0", "0", "1"]


# line items as transform parameters
LI = """li AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_tax * 100 AS deg, 0.5 + l_discount * 10 AS s, l_extendedprice / 997.0 AS p FROM lineitem)"""


def params(spark, sf):
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), (F.col("l_tax") * 100).alias("deg"),
        (0.5 + F.col("l_discount") * 10).alias("s"), (F.col("l_extendedprice") / 997.0).alias("p"),
    )


K = ["l_orderkey", "l_linenumber"]


@query("fn1_polar", f"""WITH {G1} SELECT grid_id, y, x, round(sqrt((x - 11.3)^2 + (y - 14.2)^2), 6) AS radius,
 round(((degrees(atan2(x - 11.3, 14.2 - y)) % 360) + 360) % 360, 6) AS angle FROM g1""")
def fn1(spark, sf):
    rad, ang = geo.polar(F.col("x"), F.col("y"), 11.3, 14.2)
    return A.event_grid(spark, sf).select("grid_id", "y", "x", F.round(rad, 6).alias("radius"), F.round(ang, 6).alias("angle"))


@query("fn2_wrap180", f"SELECT event_id, round({wrap('value * 7 - 500')}, 6) AS a FROM events")
def fn2(spark, sf):
    return A.table(spark, sf, "events").select("event_id", F.round(geo.wrap180(F.col("value") * 7 - 500), 6).alias("a"))


@query("fn3_luma", f"WITH {COLORS} SELECT p_partkey, round(0.114 * b + 0.587 * g + 0.299 * r, 9) AS v FROM colors")
def fn3(spark, sf):
    return A.part_colors(spark, sf).select("p_partkey", F.round(color.luma(F.col("b"), F.col("g"), F.col("r")), 9).alias("v"))


def lab_sql(b="b", g="g", r="r", p=""):
    def lin(c):
        return f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"

    def f(t):
        return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END)"

    m, w = color.SRGB_TO_XYZ, color.WHITE
    x, y, z = (f"(({row[0]} * {lin(r)} + {row[1]} * {lin(g)} + {row[2]} * {lin(b)}) / {wt})" for row, wt in zip(m, w))
    return (
        f"(CASE WHEN {y} > 0.008856 THEN 116.0 * {f(y)} - 16.0 ELSE 903.3 * {y} END) * 255.0 / 100.0 AS {p}ll, "
        f"500.0 * ({f(x)} - {f(y)}) + 128.0 AS {p}aa, 200.0 * ({f(y)} - {f(z)}) + 128.0 AS {p}bb"
    )


@query("fn4_bgr_to_lab", f"""WITH {COLORS}, t AS (SELECT p_partkey, b, g, r, {lab_sql()} FROM colors)
SELECT p_partkey, round(ll, 6) AS l, round(aa, 6) AS a, round(bb, 6) AS bb, true AS round_trip FROM t""")
def fn4(spark, sf):
    c = A.part_colors(spark, sf).withColumn("lab", color.bgr_to_lab(F.col("b"), F.col("g"), F.col("r")))
    c = c.withColumn("back", color.lab_to_bgr(F.col("lab.l"), F.col("lab.a"), F.col("lab.b")))
    err = F.greatest(*[F.abs(F.col(f"back.{k}") - F.col(k)) for k in "bgr"])
    return c.select("p_partkey", F.round("lab.l", 6).alias("l"), F.round("lab.a", 6).alias("a"), F.round("lab.b", 6).alias("bb"), (err < 0.2).alias("round_trip"))


@query("fn5_blend", f"WITH {COLORS} SELECT p_partkey, abs(b - g) AS d, round(b * (1 - 0.58) + g * 0.58, 9) AS v FROM colors")
def fn5(spark, sf):
    b, g = F.col("b"), F.col("g")
    return A.part_colors(spark, sf).select("p_partkey", color.abs_diff(b, g).alias("d"), F.round(color.blend(b, g, 0.58), 9).alias("v"))


@query("fn6_alpha_blend", f"WITH {COLORS} SELECT p_partkey, round(CASE WHEN r < 128 THEN greatest(0.0, least(255.0, b * 0.15 + (g * 2 - 60) * 0.85)) ELSE b END, 6) AS v FROM colors")
def fn6(spark, sf):
    v = color.alpha_blend(F.col("b"), F.col("g") * 2 - 60, F.col("r") < 128, 0.85)
    return A.part_colors(spark, sf).select("p_partkey", F.round(v, 6).alias("v"))


def pts(a, b, c):
    return F.struct(F.lit(a).alias("p10"), F.lit(b).alias("p50"), F.lit(c).alias("p90"))


@query("fn7_tone_map", f"""WITH {COLORS} SELECT p_partkey, round(greatest(0.0, least(255.0, 120.0 + (b - 100.0) * CASE WHEN b <= 100.0
 THEN greatest(0.45, least(2.2, (120.0 - 20.0) / greatest(8.0, 100.0 - 95.0))) ELSE greatest(0.45, least(2.2, (200.0 - 120.0) / greatest(8.0, 180.0 - 100.0))) END)), 9) AS v FROM colors""")
def fn7(spark, sf):
    v = color.tone_map(F.col("b"), pts(95.0, 100.0, 180.0), pts(20.0, 120.0, 200.0))
    return A.part_colors(spark, sf).select("p_partkey", F.round(v, 9).alias("v"))


@query("fn8_spread_transfer", f"WITH {COLORS} SELECT p_partkey, round(greatest(0.0, least(255.0, (b - 110.0) * greatest(0.55, least(1.8, 70.0 / 44.0)) + 131.0)), 9) AS v FROM colors")
def fn8(spark, sf):
    def s(m, w):
        return F.struct(F.lit(m).alias("median"), F.lit(w).alias("spread"))

    return A.part_colors(spark, sf).select("p_partkey", F.round(color.spread_transfer(F.col("b"), s(110.0, 44.0), s(131.0, 70.0)), 9).alias("v"))


@query("fn9_adjustment", f"WITH {LI} SELECT l_orderkey, l_linenumber, {matrix_sql('m', rot_sql('(100 / 2.0)', '(80 / 2.0)', 'deg', 's', 'q', 'p'))} FROM li")
def fn9(spark, sf):
    c = F.col
    return unpack(params(spark, sf).select(*K, geo.adjustment(100, 80, c("deg"), c("s"), c("q"), c("p")).alias("m")), "m")


def mat_mul(a, b):
    return [f"({' + '.join(f'{a[3 * i + k]} * {b[3 * k + j]}' for k in range(3))})" for i in range(3) for j in range(3)]


_A = ["a.m00", "a.m01", "a.m02", "a.m10", "a.m11", "a.m12", "0.001", "0.0002", "1.0"]
AFF = """ab AS (SELECT *, {'m00': s, 'm01': deg / 10 - 0.3, 'm02': q, 'm10': p / 100, 'm11': 1.1, 'm12': -q} AS a FROM li)"""
_B = ["1.0", "0.0", "q", "0.0", "1.0", "p", "0.0", "0.0", "1.0"]


def two(spark, sf):
    c = F.col
    a = geo.matrix(c("s"), c("deg") / 10 - 0.3, c("q"), c("p") / 100, 1.1, -c("q"), 0.001, 0.0002, 1)
    return params(spark, sf).select(*K, "q", "p", a.alias("a"))


@query("fn10_compose", f"WITH {LI}, {AFF} SELECT l_orderkey, l_linenumber, {matrix_sql('m', mat_mul(_A, _B))} FROM ab")
def fn10(spark, sf):
    return unpack(two(spark, sf).select(*K, geo.compose(F.col("a"), geo.translate(F.col("q"), F.col("p"))).alias("m")), "m")


@query("fn10_invert", "SELECT l_orderkey, l_linenumber, " + matrix_sql("m", [1, 0, 0, 0, 1, 0, 0, 0, 1]) + " FROM lineitem")
def fn10i(spark, sf):
    m = geo.compose(geo.invert(F.col("a")), F.col("a"))
    return unpack(two(spark, sf).select(*K, m.alias("m")), "m")


_SIM = rot_sql("(q * 2)", "(p - 3)", "deg", "(30 / greatest(1e-6, s * 10))", "(60 - q * 2)", "(40 - (p - 3))")


@query("fn11_similarity_from_anchors", f"WITH {LI} SELECT l_orderkey, l_linenumber, {matrix_sql('m', _SIM)} FROM li")
def fn11(spark, sf):
    c = F.col
    d = params(spark, sf).select(*K, "deg", geo.anchor(60, 40, 30).alias("ref"), geo.anchor(c("q") * 2, c("p") - 3, c("s") * 10).alias("cand"))
    return unpack(d.select(*K, geo.similarity_from_anchors(c("ref"), c("cand"), c("deg")).alias("m")), "m")


_E_T, _E_T2 = ["1", "0", "-(q * 2)", "0", "1", "-p", "0", "0", "1"], ["1", "0", "50", "0", "1", "45", "0", "0", "1"]
_co, _si = "cos(radians(deg * 11))", "sin(radians(deg * 11))"
_E_R1, _E_R2 = [_co, _si, "0", f"(-{_si})", _co, "0", "0", "0", "1"], [_co, f"(-{_si})", "0", _si, _co, "0", "0", "0", "1"]
_E_S = ["(25 / greatest(1.0, s * 20))", "0", "0", "0", "(25 / greatest(1.0, s * 15))", "0", "0", "0", "1"]


@query("fn12_ellipse_to_circle", f"WITH {LI} SELECT l_orderkey, l_linenumber, {matrix_sql('m', mat_mul(_E_T2, mat_mul(_E_R2, mat_mul(_E_S, mat_mul(_E_R1, _E_T)))))} FROM li")
def fn12(spark, sf):
    c = F.col
    e = F.struct((c("q") * 2).alias("cx"), c("p").alias("cy"), (c("s") * 20).alias("semi_major"), (c("s") * 15).alias("semi_minor"), (c("deg") * 11).alias("angle"))
    return unpack(params(spark, sf).select(*K, e.alias("e")).select(*K, geo.ellipse_to_circle(c("e"), 50, 45, 25).alias("m")), "m")


@query("fn13_decompose", f"""WITH {LI}, ab AS (SELECT *, s AS a, deg / 10 - 0.3 AS b, p / 100 AS c, 1.1 AS d FROM li),
e AS (SELECT *, a * a + b * b + c * c + d * d AS t, abs(a * d - b * c) AS det FROM ab),
f AS (SELECT *, sqrt((t + sqrt(greatest(0.0, t * t - 4 * det * det))) / 2) AS sx FROM e)
SELECT l_orderkey, l_linenumber, round(sx, 5) AS sx, round(det / sx, 5) AS sy, round(sx / greatest(1e-6, det / sx), 3) AS anisotropy,
 round(degrees(atan2(c - b, a + d)), 5) AS rotation FROM f""")
def fn13(spark, sf):
    d = two(spark, sf).select(*K, geo.decompose(F.col("a")).alias("d")).select(*K, "d.*")
    return rounded(rounded(d, "sx", "sy", "rotation", n=5), "anisotropy", n=3)


_W = "(0.001 * q + 0.0002 * p + 1.0)"


@query("fn14_apply_transform", f"""WITH {LI}, {AFF} SELECT l_orderkey, l_linenumber, round((a.m00 * q + a.m01 * p + a.m02) / {_W}, 6) AS px,
 round((a.m10 * q + a.m11 * p + a.m12) / {_W}, 6) AS py FROM ab""")
def fn14(spark, sf):
    px, py = geo.apply_transform(F.col("q"), F.col("p"), F.col("a"))
    return two(spark, sf).select(*K, F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


def corner_sql(x, y):
    w = f"(0.001 * {x} + 0.0002 * {y} + 1.0)"
    return f"abs((a.m00 * {x} + a.m01 * {y} + a.m02) / {w} - {x}), abs((a.m10 * {x} + a.m11 * {y} + a.m12) / {w} - {y})"


@query("fn15_max_corner_displacement", f"""WITH {LI}, {AFF} SELECT l_orderkey, l_linenumber, round(greatest({corner_sql(0, 0)}, {corner_sql(90, 0)}, {corner_sql(90, 70)}, {corner_sql(0, 70)}), 6) AS max_displacement,
 round(sqrt(0.001^2 + 0.0002^2) * 90, 6) AS perspective FROM ab""")
def fn15(spark, sf):
    r = geo.corner_report(F.col("a"), 90, 70)
    return rounded(two(spark, sf).select(*K, r.alias("r")).select(*K, "r.max_displacement", "r.perspective"), "max_displacement", "perspective")


@query("fn16_canvas", f"""WITH {LI}, d AS (SELECT *, p * 4 + 20 AS rr, q * 10 AS cr FROM li),
e AS (SELECT *, greatest(640, least(1600, CAST(round_even(greatest(rr, cr) * 1.72 * 2.0, 0) AS INTEGER))) AS s0 FROM d),
f AS (SELECT *, CAST(s0 + s0 % 2 AS INTEGER) AS size FROM e)
SELECT l_orderkey, l_linenumber, size, round(size / 3.44, 6) AS target_r, round(size / 3.44 / greatest(1e-6, rr), 6) AS render_scale,
 round(size / 2.0 - size / 3.44 / greatest(1e-6, rr) * q, 4) AS tx FROM f""")
def fn16(spark, sf):
    c = F.col
    d = params(spark, sf).select(*K, geo.anchor(c("q"), c("p"), c("p") * 4 + 20).alias("ref"), (c("q") * 10).alias("cr"))
    d = d.select(*K, geo.canvas(c("ref"), c("cr")).alias("k")).select(*K, "k.size", "k.target_r", "k.render_scale", c("k.m.m02").alias("tx"))
    return rounded(rounded(d, "target_r", "render_scale"), "tx", n=4)


@query("fn17_confidence", f"""WITH {LI}, t AS (SELECT *, 0.40 * least(q / 5, 11.0) / 12.0 + 0.20 * greatest(0.0, least(1.0, s / 10 / 0.55)) + 0.40 * greatest(0.0, least(1.0, p / 100 / 0.55)) AS w,
 0.65 * (p / 110) + 0.25 * least(q, 35.0) / 35.0 + 0.10 * greatest(0.0, 1.0 - deg / 8.0) AS m FROM li),
u AS (SELECT *, greatest(0.0, least(1.0, w)) AS ws, greatest(0.0, least(1.0, m)) AS ms FROM t)
SELECT l_orderkey, l_linenumber, round(ws, 6) AS anchor_score, CASE WHEN ws >= 0.72 THEN 'high' WHEN ws >= 0.48 THEN 'medium' ELSE 'low' END AS anchor_label,
 round(ms, 6) AS match_score, CASE WHEN ms >= 0.68 THEN 'high' WHEN ms >= 0.42 THEN 'medium' ELSE 'low' END AS match_label FROM u""")
def fn17(spark, sf):
    c = F.col
    w = gates.confidence_anchor(c("q") / 5, F.lit(11.0), c("s") / 10, c("p") / 100)
    m = gates.confidence_match(c("p") / 110, c("q"), c("deg"))
    d = params(spark, sf).select(*K, w.alias("w"), m.alias("m"))
    return d.select(*K, F.round("w.score", 6).alias("anchor_score"), c("w.label").alias("anchor_label"), F.round("m.score", 6).alias("match_score"), c("m.label").alias("match_label"))


_M, _P = "(CASE WHEN q < 10 THEN NULL ELSE deg - 4 END)", "(CASE WHEN q > 40 THEN NULL ELSE q - 25 END)"


@query("fn18_combine_rotation", f"""WITH {LI}, t AS (SELECT *, {_M} AS m, {_P} AS pr FROM li)
SELECT l_orderkey, l_linenumber, round(greatest(-15.0, least(15.0, CASE WHEN m IS NOT NULL AND pr IS NOT NULL AND abs({wrap('m - pr')}) <= 2.0 THEN m * 0.7 + pr * 0.3
 ELSE coalesce(m, pr, 0.0) END)), 6) AS rotation FROM t""")
def fn18(spark, sf):
    c = F.col
    m, p = F.when(c("q") >= 10, c("deg") - 4), F.when(c("q") <= 40, c("q") - 25)
    return params(spark, sf).select(*K, F.round(gates.combine_rotation(m, p), 6).alias("rotation"))


@query("fn19_parse_anchor", """SELECT p_partkey, CASE WHEN ok THEN CAST(p_size AS DOUBLE) END AS cx, CASE WHEN ok THEN p_retailprice END AS cy, CASE WHEN ok THEN CAST(p_size - 20 AS DOUBLE) END AS r
FROM (SELECT *, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size - 20 > 5 AS ok FROM part)""")
def fn19(spark, sf):
    p = A.table(spark, sf, "part")
    text = [F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), (F.col("p_size") - 20).cast("string")]
    arr = F.when(F.col("p_partkey") % 3 == 0, F.array(*text[:2])).when(F.col("p_partkey") % 5 == 0, F.array(text[0], F.lit("n/a"), text[2])).otherwise(F.array(*text))
    return p.select("p_partkey", geo.parse_anchor(arr).alias("a")).select("p_partkey", "a.cx", "a.cy", "a.r")


# ---------------------------------------------------------------- predicates


@query("prd1_in_ellipse", f"WITH {G1} SELECT grid_id, y, x FROM g1 WHERE ((x - 12.0) / 20)^2 + ((y - 15.0) / 20)^2 <= 1")
def prd1(spark, sf):
    g = A.event_grid(spark, sf)
    return g.where(regions.center_ellipse(F.col("x"), F.col("y"), 24, 30)).select("grid_id", "y", "x")


@query("prd2_in_circle", f"WITH {G1} SELECT grid_id, count(*) AS n, round(sum(v), 4) AS total FROM g1 WHERE sqrt((x - 12)^2 + (y - 15)^2) <= 7.5 AND v > 0 GROUP BY 1")
def prd2(spark, sf):
    g = A.event_grid(spark, sf).where(regions.in_circle(F.col("x"), F.col("y"), 12, 15, 7.5) & (F.col("v") > 0))
    return rounded(g.groupBy("grid_id").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", n=4)


@query("prd3_in_annulus", f"""WITH {G1}, d AS (SELECT *, sqrt((x - 12)^2 + (y - 15)^2) / 10.0 AS d FROM g1)
SELECT grid_id, y, x, d > 0.56 AND d < 1.12 AS band, d >= 0.5 AND d <= 1.0 AS inclusive FROM d""")
def prd3(spark, sf):
    a = geo.anchor(12, 15, 10)
    x, y = F.col("x"), F.col("y")
    return A.event_grid(spark, sf).select("grid_id", "y", "x", regions.in_annulus(x, y, a, 0.56, 1.12).alias("band"), regions.in_annulus(x, y, a, 0.5, 1.0, False).alias("inclusive"))


@query("prd4_in_sector", f"""WITH {D1}, s AS (SELECT *, CAST(((CAST(floor(angle / 30 + 0.5) AS BIGINT) % 12) + 12) % 12 * 30 AS INTEGER) AS sector FROM d1)
SELECT grid_id, event_id, sector, abs({wrap('angle - sector')}) < 11.0 AS inside, (angle > 135 AND angle < 225) OR (angle > 70 AND angle < 110) AS suppressed FROM s""")
def prd4(spark, sf):
    d = A.event_dial(spark, sf).withColumn("sector", regions.nearest_sector(F.col("angle")))
    return d.select("grid_id", "event_id", "sector", regions.in_sector(F.col("angle"), F.col("sector")).alias("inside"), regions.suppressed(F.col("angle")).alias("suppressed"))


REQ = """req AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_tax * 250 END AS rotation, l_discount * 20 AS scale, l_quantity * 10 AS x, -l_quantity * 9 AS y,
 CASE WHEN l_linenumber <> 2 THEN l_discount * 12 END AS opacity, l_tax * 13 AS match_strength, CAST(l_quantity * 80 AS INTEGER) AS frame_ms,
 CASE l_shipdate_m WHEN 0 THEN 'gif' WHEN 1 THEN 'mp4' WHEN 2 THEN 'png' WHEN 3 THEN 'bmp' END AS format FROM (SELECT *, l_partkey % 5 AS l_shipdate_m FROM lineitem))"""


def requests(spark, sf):
    c = F.col
    li = A.table(spark, sf, "lineitem")
    m = c("l_partkey") % 5
    fmt = F.when(m == 0, "gif").when(m == 1, "mp4").when(m == 2, "png").when(m == 3, "bmp")
    return li.select(
        *K, F.when(c("l_linenumber") != 1, c("l_tax") * 250).alias("rotation"), (c("l_discount") * 20).alias("scale"), (c("l_quantity") * 10).alias("x"),
        (-c("l_quantity") * 9).alias("y"), F.when(c("l_linenumber") != 2, c("l_discount") * 12).alias("opacity"), (c("l_tax") * 13).alias("match_strength"),
        (c("l_quantity") * 80).cast("int").alias("frame_ms"), fmt.alias("format"),
    )


@query("prd7_validate_params", f"""WITH {REQ}, d AS (SELECT * REPLACE (coalesce(rotation, 0.0) AS rotation, coalesce(opacity, 0.5) AS opacity) FROM req)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN rotation NOT BETWEEN -15 AND 15 THEN 'rotation' END, CASE WHEN scale NOT BETWEEN 0.6 AND 1.4 THEN 'scale' END,
 CASE WHEN x NOT BETWEEN -400 AND 400 THEN 'x' END, CASE WHEN y NOT BETWEEN -400 AND 400 THEN 'y' END, CASE WHEN opacity NOT BETWEEN 0 AND 1 THEN 'opacity' END,
 CASE WHEN match_strength NOT BETWEEN 0 AND 1 THEN 'match_strength' END, CASE WHEN frame_ms NOT BETWEEN 250 AND 3000 THEN 'frame_ms' END,
 CASE WHEN format IS NULL OR format NOT IN ('gif', 'mp4', 'png') THEN 'format' END) AS errors FROM d""")
def prd7(spark, sf):
    return gates.validate_params(requests(spark, sf)).select(*K, F.concat_ws(",", "errors").alias("errors"))


@query("prd8_gate", f"""WITH {LI}, t AS (SELECT *, p / 100 AS score, q AS shift, deg / 2 AS rotation, 0.9 + s / 50 AS scale, 1.0 + deg / 200 AS anisotropy FROM li),
g AS (SELECT *, CASE WHEN NOT score >= 0.18 THEN 'weak score' WHEN NOT (shift / 400 <= 0.10 AND abs(rotation) <= 2.0 AND scale >= 0.97 AND scale <= 1.03 AND anisotropy <= 1.03)
 THEN 'correction outside safety bounds' ELSE 'applied' END AS reason FROM t)
SELECT l_orderkey, l_linenumber, reason = 'applied' AS applied, reason FROM g""")
def prd8(spark, sf):
    c = F.col
    t = params(spark, sf).select(*K, (c("p") / 100).alias("score"), c("q").alias("shift"), (c("deg") / 2).alias("rotation"), (0.9 + c("s") / 50).alias("scale"), (1.0 + c("deg") / 200).alias("anisotropy"), F.lit(400).alias("min_side"))
    return gates.gate(t, "refine", {0: "weak score"}).select(*K, "applied", "reason")


@query("prd8_gate_counts", f"""WITH {LI}, t AS (SELECT *, p / 100 AS score, q AS shift, s AS scale, 10 * s AS r FROM li)
SELECT count(*) FILTER (score >= 0.34 AND shift <= least(18.0, greatest(10.0, 0.105 * r))) AS text_lock,
 count(*) FILTER (score >= 0.34 AND scale > 0.705 AND scale < 1.495 AND shift / 300 <= 0.14) AS scale_lock,
 count(*) FILTER (scale < 0.90 AND scale >= 0.78) AS dewarp FROM t""")
def prd8c(spark, sf):
    c = F.col
    t = params(spark, sf).select(*K, (c("p") / 100).alias("score"), c("q").alias("shift"), c("s").alias("scale"), (10 * c("s")).alias("r"), F.lit(300).alias("min_side"), c("s").alias("axis_ratio"))
    for name in ("text_lock", "scale_lock", "dewarp"):
        t = gates.gate(t, name).withColumnRenamed("applied", name).drop("reason")
    return t.agg(*[F.count_if(n).alias(n) for n in ("text_lock", "scale_lock", "dewarp")])


# ---------------------------------------------------------------- ingest, store, requests


@query("src2_validate_ingest", """SELECT page_id, CASE WHEN n > 6000 THEN 413 WHEN page_id % 7 = 0 THEN 400 WHEN n * 40 > 150000 THEN 413 ELSE 200 END AS status,
 CASE WHEN n > 6000 THEN 'too many bytes' WHEN page_id % 7 = 0 THEN 'undecodable' WHEN n * 40 > 150000 THEN 'too many cells' ELSE 'ok' END AS reason
FROM (SELECT page_id, length(html) AS n FROM pages)""")
def src2(spark, sf):
    n = F.length("html")
    p = A.table(spark, sf, "pages").select("page_id", n.alias("length"), F.when(F.col("page_id") % 7 == 0, -1).otherwise(n).alias("height"), F.lit(40).alias("width"))
    return images.validate_ingest(p, max_bytes=6000, max_cells=150_000).select("page_id", "status", "reason")


@query("src2_documents", """SELECT doc_id, CASE WHEN n_chars > 20000 THEN 413 WHEN n_chars * 80 > 400000 THEN 413 ELSE 200 END AS status FROM documents""")
def src2d(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"), F.col("n_chars").alias("height"), F.lit(80).alias("width"))
    return images.validate_ingest(d, max_bytes=20_000, max_cells=400_000).select("doc_id", "status")


IDS = "CASE WHEN o_orderkey % 10 = 0 THEN 'order ' || o_orderkey ELSE printf('%06x', o_orderkey) || '-a' END"


@query("snk1_write_results", """SELECT o_orderkey, o_custkey AS cust, '{"cust":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS metrics_json, '2024-01-31' AS run_date FROM orders""")
def snk1(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/kongrid-results-{uuid.uuid4().hex}"
    o = A.table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status")).alias("metrics"))
    store.write_results(o, path, ["o_orderkey"], "2024-01-31")
    return store.read_results(spark, path).select("o_orderkey", F.col("metrics.cust").alias("cust"), "metrics_json", F.col("run_date").cast("string").alias("run_date"))


# half of the orders are looked up again on the 19th; a day later only run dates with such an order are left
@query("snk4_remove_expired", """WITH s AS (SELECT o_orderkey, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(o_custkey % 17 AS INTEGER)) AS DATE) AS run_date, o_custkey % 17 < 5 AND o_orderkey % 2 = 0 AS seen FROM orders)
SELECT o_orderkey, CAST(run_date AS VARCHAR) AS run_date, seen FROM s WHERE run_date IN (SELECT run_date FROM s WHERE seen)""")
def snk4r(spark, sf):
    base = f"{shared_dir(spark).rstrip('/')}/kongrid-store-{uuid.uuid4().hex}"
    o = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_custkey") % 17).cast("int")).alias("run_date"))
    o = o.withColumn("last_access", F.col("run_date").cast("timestamp"))
    o.repartition("run_date").write.partitionBy("run_date").parquet(f"{base}/results")
    found = o.where("o_custkey % 17 < 5 AND o_orderkey % 2 = 0").select("o_orderkey", F.lit(200).alias("status"), F.lit("2024-01-19 12:00:00").cast("timestamp").alias("last_access"))
    store.record_access(found, f"{base}/access", "o_orderkey")
    access = spark.read.parquet(f"{base}/access")
    store.remove_expired(spark, f"{base}/results", access, "o_orderkey", F.lit("2024-01-20 12:00:00").cast("timestamp"), 86400)
    left = store.with_access(store.read_results(spark, f"{base}/results"), access, "o_orderkey")
    return left.select("o_orderkey", F.col("run_date").cast("string").alias("run_date"), (F.col("last_access") >= F.lit("2024-01-19").cast("timestamp")).alias("seen"))


# Accesses of every order, logged in four runs; compactions in between leave one row per key and lose none.
@query("snk4_compact_access", """SELECT o_orderkey, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(greatest(o_custkey % 17, CASE WHEN o_orderkey % 3 = 0 THEN 20 ELSE 0 END, CASE WHEN o_orderkey % 5 = 0 THEN 9 ELSE 0 END) AS INTEGER)) AS TIMESTAMP) AS last_access FROM orders""")
def snk4_compact(spark, sf):
    import uuid

    path = f"{shared_dir(spark)}/kongrid-access-{uuid.uuid4().hex}"
    schema = "o_orderkey long, last_access timestamp"
    orders = A.table(spark, sf, "orders").withColumn("status", F.lit(200))
    day = F.lit("2024-01-01").cast("timestamp")
    seen = orders.withColumn("last_access", F.timestamp_add("DAY", (F.col("o_custkey") % 17).cast("int"), day))
    store.log_access(seen.where("o_orderkey % 2 = 0"), path, "o_orderkey")
    store.log_access(seen.where("o_orderkey % 2 = 1"), path, "o_orderkey")
    store.compact_access(spark, path, "o_orderkey", schema)
    store.log_access(orders.where("o_orderkey % 3 = 0").withColumn("last_access", F.timestamp_add("DAY", F.lit(20), day)), path, "o_orderkey")
    store.compact_access(spark, path, "o_orderkey", schema)
    store.log_access(orders.where("o_orderkey % 5 = 0").withColumn("last_access", F.timestamp_add("DAY", F.lit(9), day)), path, "o_orderkey")
    return store.read_access(spark, path, "o_orderkey", schema).withColumn("last_access", F.col("last_access").cast("timestamp_ntz"))


@query("snk2_lookup_results", f"""WITH k AS (SELECT o_orderkey, {IDS} AS id FROM orders),
s AS (SELECT printf('%06x', o_orderkey) || '-a' AS id, o_totalprice AS transform, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS metrics FROM orders WHERE o_custkey % 2 = 0)
SELECT k.o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 400 WHEN s.id IS NULL THEN 404 WHEN metrics IS NULL THEN 500 ELSE 200 END AS status,
 CASE WHEN o_orderkey % 10 = 0 THEN 'invalid id' WHEN s.id IS NULL THEN 'not found or expired' WHEN metrics IS NULL THEN 'parts unavailable' ELSE 'ok' END AS reason
FROM k LEFT JOIN s USING (id)""")
def snk2(spark, sf):
    o = A.table(spark, sf, "orders")
    good = F.concat(F.lower(F.lpad(F.hex("o_orderkey"), 6, "0")), F.lit("-a"))
    keys = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).otherwise(good).alias("id"))
    st = o.where("o_custkey % 2 = 0").select(good.alias("id"), F.col("o_totalprice").alias("transform"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("metrics"))
    return store.lookup_results(keys, st, "id", ["transform", "metrics"]).select("o_orderkey", "status", "reason")


@query("snk3_compute_missing", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE -1.0 END AS result, o_custkey % 3 = 0 AS reused FROM orders""")
def snk3(spark, sf):
    o = A.table(spark, sf, "orders")
    have = o.where("o_custkey % 3 = 0").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("result"))
    return store.compute_missing(o.select("o_orderkey", "o_custkey"), have, ["o_orderkey", "o_custkey"], lambda d: d.withColumn("result", F.lit(-1.0)))


@query("snk4_expire", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(ts) <= 86400")
def snk4(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", "ts")
    return store.expire(e, F.lit("2024-01-20 12:00:00").cast("timestamp"), 86400, "ts").select("event_id")


@query("snk5_export_overview", f"""WITH {REQ}, f AS (SELECT *, CASE format WHEN 'png' THEN 1 WHEN 'gif' THEN 2 ELSE 4 END AS n FROM req WHERE format IN ('png', 'gif', 'mp4')),
e AS (SELECT f.*, CAST(i AS INTEGER) AS frame FROM f, LATERAL (SELECT unnest(range(n)) AS i))
SELECT l_orderkey, l_linenumber, frame, CASE WHEN format = 'png' THEN 'overlay' WHEN frame % 2 = 0 THEN 'reference' ELSE 'aligned' END AS view,
 CASE WHEN format = 'png' THEN NULL WHEN frame % 2 = 0 THEN 'REFERENCE' WHEN l_linenumber % 2 = 0 THEN 'CANDIDATE · MATCHED' ELSE 'CANDIDATE · RAW' END AS label,
 CASE format WHEN 'png' THEN 'comparison-overlay.png' WHEN 'gif' THEN 'comparison.gif' ELSE 'comparison.mp4' END AS file_name,
 CASE WHEN format = 'gif' THEN frame_ms END AS duration_ms, CASE WHEN format = 'mp4' THEN CAST(greatest(1, round_even(1000.0 / frame_ms, 0)) AS INTEGER) END AS fps FROM e""")
def snk5(spark, sf):
    r = requests(spark, sf).select(*K, "format", "frame_ms", (F.col("l_linenumber") % 2 == 0).alias("appearance_match"))
    return exports.export_overview(r).drop("format", "frame_ms", "appearance_match")


@query("tk5_latest_per_session", f"WITH {R1} SELECT session, seq, ts, param, value FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM r1) WHERE k = 1")
def tk5(spark, sf):
    return recency.latest_per_session(A.event_requests(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("tk6_debounce", f"""WITH {R1}, l AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS nxt FROM r1)
SELECT session, seq, ts, param, value FROM l WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 7200000000""")
def tk6(spark, sf):
    return recency.debounce(A.event_requests(spark, sf), 7200.0, ["session"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("tk6_sessions", f"""WITH {R1}, l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 7200000000 THEN 1 ELSE 0 END AS b FROM r1 WINDOW w AS (PARTITION BY session ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY ts) AS k FROM l)
SELECT session, count(*) AS n, min(ts) AS first_access, max(ts) AS last_access FROM s GROUP BY session, k""")
def tk6s(spark, sf):
    s = recency.sessions(A.event_requests(spark, sf), 7200, ["session"])
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_access", "last_access")})


@query("ag6_appearance_report", f"""WITH {COLORS}, a AS (SELECT p_partkey, r, {lab_sql('b', 'g', 'r')} FROM colors),
c AS (SELECT p_partkey, {lab_sql('g', 'b', 'r', 'x')} FROM colors), d AS (SELECT p_partkey, {lab_sql('(b * 0.9 + g * 0.1)', '(g * 0.9 + b * 0.1)', 'r', 'z')} FROM colors),
j AS (SELECT p_partkey % 7 AS pair, sqrt((ll - xll)^2 + (aa - xaa)^2 + (bb - xbb)^2) AS d0, sqrt((ll - zll)^2 + (aa - zaa)^2 + (bb - zbb)^2) AS d1 FROM a JOIN c USING (p_partkey) JOIN d USING (p_partkey))
SELECT pair, count(*) AS sample_cells, round(avg(d0), 5) AS distance_before, round(avg(d1), 5) AS distance_after,
 round(CASE WHEN avg(d0) <= 0.001 THEN 0.0 ELSE greatest(0.0, 1 - avg(d1) / avg(d0)) END, 6) AS improvement FROM j GROUP BY 1""")
def ag6(spark, sf):
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    t, x = color.bgr_to_lab(b, g, r), color.bgr_to_lab(g, b, r)
    z = color.bgr_to_lab(color.blend(b, g, 0.1), color.blend(g, b, 0.1), r)
    c = A.part_colors(spark, sf).select((F.col("p_partkey") % 7).alias("pair"), t.alias("t"), x.alias("x"), z.alias("z"))
    rep = appearance_report(c, color.lab_distance(F.col("t"), F.col("x")), color.lab_distance(F.col("t"), F.col("z")), ["pair"])
    return rounded(rounded(rep, "distance_before", "distance_after", n=5), "improvement")


# every part as a picture of two pixels of one, three or four channels
@query("src3_to_grid", f"""WITH {COLORS}, px AS (SELECT p.p_partkey, CAST(0 AS INTEGER) AS x, b, g, r, p_size * 5 % 256 AS a FROM colors JOIN part p USING (p_partkey)
 UNION ALL SELECT p_partkey, CAST(1 AS INTEGER), r, g, b, 255 FROM colors),
v AS (SELECT p_partkey, x, p_partkey % 3 AS kind, a / 255.0 AS al, b, g, r FROM px)
SELECT CAST(p_partkey AS VARCHAR) AS grid_id, CAST(0 AS INTEGER) AS y, x,
 {', '.join(f"CASE kind WHEN 0 THEN b WHEN 1 THEN {c} ELSE floor({c} * al + 24.0 * (1.0 - al)) END AS {c}" for c in "bgr")} FROM v""")
def src3(spark, sf):
    size = A.table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 5 % 256).alias("a"))
    c = A.part_colors(spark, sf).join(size, "p_partkey")

    def text(*values):
        return F.concat(*[F.lpad(F.hex(v.cast("long")), 2, "0") for v in values])

    b, g, r, a = (F.col(k) for k in ("b", "g", "r", "a"))
    kind = F.col("p_partkey") % 3
    data = F.when(kind == 0, text(b, r)).when(kind == 1, text(b, g, r, r, g, b)).otherwise(text(b, g, r, a, r, g, b, F.lit(255)))
    channels = F.when(kind == 0, 1).when(kind == 1, 3).otherwise(4)
    pictures = c.select(F.col("p_partkey").alias("grid_id"), F.lit(1).alias("height"), F.lit(2).alias("width"), channels.alias("n_channels"), F.unhex(data).alias("data"))
    return images.to_grid(pictures)
