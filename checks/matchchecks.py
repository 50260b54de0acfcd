"""Profile, matching and consensus queries (JN-5..8, AG-11, TK-4, PL-2, PL-6)."""

from pyspark.sql import functions as F

from checks.base import C1, SECONDS, query
from checks.statistics import rounded
from kongrid.functions import geometry as geo
from kongrid.operators import consensus, matching, profiles as P
from kongrid.plans.descriptors import align_by_descriptors
from kongrid.sources import adapters as A


def xcorr_sql(prof, pairs, bins, max_lag):
    """`prof` (grid_id, bin, v) dense and z-scored, `pairs` (pair_id, ref_id, cand_id)."""
    return f"""xs AS (SELECT p.pair_id, p.ref_id, p.cand_id, lag, sum(a.v * b.v) / {bins} AS score
      FROM {pairs} p CROSS JOIN (SELECT CAST(unnest(range({-max_lag}, {max_lag + 1})) AS INTEGER) AS lag) l
      JOIN {prof} a ON a.grid_id = p.ref_id JOIN {prof} b ON b.grid_id = p.cand_id AND b.bin = ((a.bin - lag) % {bins} + {bins}) % {bins} GROUP BY 1, 2, 3, 4),
    live AS (SELECT grid_id, bool_or(v <> 0) AS live FROM {prof} GROUP BY 1),
    best AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY round(score, 9) DESC, ((lag % {bins}) + {bins}) % {bins}) AS k FROM xs)"""


def dense_sql(src, dst, bins):
    return f"""{dst}_d AS (SELECT i.grid_id, b.bin, coalesce(s.v, 0.0) AS v FROM (SELECT DISTINCT grid_id FROM {src}) i
      CROSS JOIN (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) b LEFT JOIN {src} s ON s.grid_id = i.grid_id AND s.bin = b.bin),
    {dst} AS (SELECT grid_id, bin, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6) AS v FROM {dst}_d WINDOW w AS (PARTITION BY grid_id))"""


# candidate: a user's hourly profile of one event type; reference: everybody's profile of that type
PL6 = f"""e AS (SELECT event_type, user_id, CAST(extract('hour' FROM ts) AS INTEGER) AS bin, value FROM events),
src AS (SELECT event_type AS grid_id, bin, sum(value) AS v FROM e GROUP BY 1, 2 UNION ALL SELECT event_type || '|' || user_id, bin, sum(value) FROM e GROUP BY 1, 2),
pr AS (SELECT DISTINCT event_type || '|' || user_id AS pair_id, event_type AS ref_id, event_type || '|' || user_id AS cand_id FROM e),
{dense_sql('src', 'z', 24)}, {xcorr_sql('z', 'pr', 24, 3)}"""


@query("pl6_align_profiles", f"""WITH {PL6} SELECT pair_id, ref_id, cand_id, lag, CAST(lag * 15 AS DOUBLE) AS degrees, round(score, 6) AS score,
 CASE WHEN greatest(0.0, least(1.0, score / 0.55)) >= 0.72 THEN 'high' WHEN greatest(0.0, least(1.0, score / 0.55)) >= 0.48 THEN 'medium' ELSE 'low' END AS confidence FROM best WHERE k = 1
 AND (SELECT live FROM live WHERE grid_id = cand_id)
UNION ALL SELECT pair_id, ref_id, cand_id, NULL, NULL, 0.0, 'low' FROM pr WHERE NOT (SELECT live FROM live WHERE grid_id = cand_id)""")
def pl6(spark, sf):
    cid = F.concat_ws("|", "event_type", F.col("user_id").cast("string"))
    mine = A.event_profile(spark, sf, 24, ["event_type", "user_id"])
    prof = mine.select(F.col("event_type").alias("grid_id"), "bin", "v").unionByName(mine.select(cid.alias("grid_id"), "bin", "v"))
    pairs = mine.select(cid.alias("pair_id"), F.col("event_type").alias("ref_id"), cid.alias("cand_id")).distinct()
    best = P.align_profiles(prof, pairs, 24, 45.0)
    return rounded(best, "score")


@query("jn8_circular_xcorr", f"""WITH e AS (SELECT event_type, CAST(floor({SECONDS} / 60) AS INTEGER) AS bin, value FROM events),
src AS (SELECT event_type AS grid_id, bin, sum(value) AS v FROM e GROUP BY 1, 2 UNION ALL SELECT '*', bin, sum(value) FROM e GROUP BY 1, 2),
pr AS (SELECT DISTINCT '*|' || event_type AS pair_id, '*' AS ref_id, event_type AS cand_id FROM e), {dense_sql('src', 'z', 1440)}, {xcorr_sql('z', 'pr', 1440, 60)}
SELECT pair_id, ref_id, cand_id, lag, round(score, 6) AS score FROM xs""")
def jn8(spark, sf):
    e = A.event_profile(spark, sf, 1440).withColumnRenamed("event_type", "grid_id")
    prof = e.unionByName(e.withColumn("grid_id", F.lit("*")))
    pairs = e.select(F.concat(F.lit("*|"), "grid_id").alias("pair_id"), F.lit("*").alias("ref_id"), F.col("grid_id").alias("cand_id")).distinct()
    packed = P.zscore_profiles(P.pack_profiles(prof, 1440))
    return rounded(P.circular_xcorr(packed, pairs, 1440, 15.0, every_lag=True), "score")


# one pair per range of 250 ids, so a larger table has more pairs and not larger ones
NEAR = f"""{C1}, dist AS (SELECT c.pair_id, c.kp_id AS cand_kp, r.kp_id AS ref_kp, bit_count(xor(c.d, r.d)) AS distance FROM c1 c JOIN c1 r USING (pair_id) WHERE c.grid_id = 'cand' AND r.grid_id = 'ref'),
fwd AS (SELECT *, row_number() OVER (PARTITION BY cand_kp ORDER BY distance, ref_kp) AS k FROM dist),
bwd AS (SELECT *, row_number() OVER (PARTITION BY ref_kp ORDER BY distance, cand_kp) AS k FROM dist),
ratio AS (SELECT a.pair_id, a.cand_kp, a.ref_kp, a.distance, a.distance < {{ratio}} * b.distance AS good FROM fwd a JOIN fwd b USING (cand_kp) WHERE a.k = 1 AND b.k = 2),
mutual AS (SELECT f.pair_id, f.cand_kp, f.ref_kp, f.distance, row_number() OVER (PARTITION BY f.pair_id ORDER BY f.distance, cand_kp, ref_kp) AS place FROM fwd f JOIN bwd b USING (cand_kp, ref_kp) WHERE f.k = 1 AND b.k = 1),
n AS (SELECT pair_id, count(*) FILTER (good) AS n FROM ratio GROUP BY 1)"""
FOUND = "pair_id, cand_kp, ref_kp, CAST(distance AS INTEGER) AS distance"


def range_pairs(spark, sf):
    part = F.floor(F.col("kp_id") / 250).cast("string")
    d = A.sign_descriptors(spark, sf).withColumn("grid_id", F.concat("grid_id", part))
    pairs = d.select(part.alias("pair_id"), F.concat(F.lit("ref"), part).alias("ref_id"), F.concat(F.lit("cand"), part).alias("cand_id")).distinct()
    return d, pairs


def matched(m):
    return m.select("pair_id", "cand_kp", "ref_kp", F.col("distance").cast("int").alias("distance"))


@query("jn5_knn_ratio", f"WITH {NEAR.format(ratio=0.9)} SELECT {FOUND} FROM ratio WHERE good")
def jn5(spark, sf):
    return matched(matching.knn_ratio(*range_pairs(spark, sf), ratio=0.9))


@query("jn6_mutual_nn", f"WITH {NEAR.format(ratio=0.9)} SELECT {FOUND} FROM mutual")
def jn6(spark, sf):
    return matched(matching.mutual_nn(*range_pairs(spark, sf), limit=None))


@query("tk4_nearest_matches_limit", f"WITH {NEAR.format(ratio=0.9)} SELECT {FOUND} FROM mutual WHERE place <= 20")
def tk4(spark, sf):
    return matched(matching.mutual_nn(*range_pairs(spark, sf), limit=20))


@query("jn7_match_descriptors", f"""WITH {NEAR.format(ratio=0.76)} SELECT {FOUND}, 'ratio' AS method FROM ratio JOIN n USING (pair_id) WHERE good AND n >= 10
UNION ALL SELECT {FOUND}, 'mutual' FROM mutual JOIN n USING (pair_id) WHERE n < 10 AND place <= 100""")
def jn7(spark, sf):
    m, _ = matching.match_descriptors(*range_pairs(spark, sf))
    return m.select("pair_id", "cand_kp", "ref_kp", F.col("distance").cast("int").alias("distance"), "method")


@query("jn7_match_status", f"""WITH {NEAR.format(ratio=0.9)}, m AS (SELECT pair_id, least(100, count(*)) AS m FROM mutual GROUP BY 1),
t AS (SELECT pair_id, n, CASE WHEN n >= 10 THEN n ELSE m END AS k FROM n JOIN m USING (pair_id))
SELECT pair_id, n AS good, k AS matches, CASE WHEN k < 8 THEN 422 ELSE 200 END AS status, CASE WHEN k < 8 THEN 'not enough matches' ELSE 'ok' END AS reason FROM t""")
def jn7s(spark, sf):
    _, s = matching.match_descriptors(*range_pairs(spark, sf), ratio=0.9)
    return s.select("pair_id", "good", "matches", "status", "reason")


# matches between two point sets per supplier: most follow one similarity, the rest are displaced
TRUE_A, TRUE_B = "0.9 * cos(radians(7))", "0.9 * sin(radians(7))"
MT = f"""mt AS (SELECT l_suppkey AS pair, l_quantity * 13 AS cx, l_extendedprice / 77.0 AS cy, l_linenumber >= 6 AS off, l_partkey % 211 AS j FROM lineitem),
mr AS (SELECT *, {TRUE_A} * cx + {TRUE_B} * cy + 31 + CASE WHEN off THEN 40 + j ELSE 0 END AS rx, -({TRUE_B}) * cx + {TRUE_A} * cy - 12 - CASE WHEN off THEN 25 + 2 * j ELSE 0 END AS ry FROM mt)"""


@query("ag11_consensus_transform", f"""WITH {MT} SELECT CAST(pair AS VARCHAR) AS pair_id, count(*) AS matches, count(*) FILTER (NOT off) AS inliers, round(count(*) FILTER (NOT off) / count(*), 6) AS inlier_ratio,
 CAST(0.9 AS DOUBLE) AS scale, CAST(7 AS DOUBLE) AS rotation, CAST(0 AS DOUBLE) AS median_error, 200 AS status, 'ok' AS reason FROM mr GROUP BY pair""")
def ag11(spark, sf):
    import math

    a, b = 0.9 * math.cos(math.radians(7)), 0.9 * math.sin(math.radians(7))
    li = A.table(spark, sf, "lineitem")
    off, j = F.col("l_linenumber") >= 6, F.col("l_partkey") % 211
    m = li.select(
        F.col("l_suppkey").cast("string").alias("pair_id"), F.col("l_orderkey").alias("cand_kp"), F.col("l_linenumber").cast("long").alias("ref_kp"),
        (F.col("l_partkey") % 64).cast("int").alias("distance"), (F.col("l_quantity") * 13).alias("cx"), (F.col("l_extendedprice") / 77.0).alias("cy"),
        F.when(off, 40 + j).otherwise(0).alias("_dx"), F.when(off, 25 + 2 * j).otherwise(0).alias("_dy"),
    )
    m = m.withColumns({"rx": a * F.col("cx") + b * F.col("cy") + 31 + F.col("_dx"), "ry": -b * F.col("cx") + a * F.col("cy") - 12 - F.col("_dy")}).drop("_dx", "_dy")
    c = consensus.consensus_transform(m)
    c = c.select("pair_id", "matches", "inliers", "inlier_ratio", geo.scale_of(F.col("m")).alias("scale"), geo.rotation_of(F.col("m")).alias("rotation"), "median_error", "status", "reason")
    return rounded(c, "inlier_ratio", "scale", "rotation", "median_error")


# per return flag and status, every line follows one shift; 64 more matches per pair are closer and follow nothing
@query("ag11_close_outliers", """SELECT l_returnflag || l_linestatus AS pair_id, count(*) + 64 AS matches, count(*) AS inliers, CAST(1 AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS rotation, CAST(0 AS DOUBLE) AS median_error,
 200 AS status FROM lineitem GROUP BY 1""")
def ag11_close(spark, sf):
    li = A.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("pair_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cand_kp"), F.col("l_partkey").alias("ref_kp"), F.lit(50).alias("distance"),
        (F.col("l_quantity") * 13).alias("cx"), (F.col("l_extendedprice") / 77.0).alias("cy"))
    good = li.withColumns({"rx": F.col("cx") + 31, "ry": F.col("cy") - 12})
    k = F.explode(F.sequence(F.lit(1), F.lit(64)))
    bad = li.select("pair_id").distinct().select("pair_id", k.alias("k")).select(
        "pair_id", (-F.col("k")).cast("long").alias("cand_kp"), F.col("k").cast("long").alias("ref_kp"), F.lit(1).alias("distance"), (F.col("k") * 9.0).alias("cx"), (F.col("k") * F.col("k") % 97 * 5.0).alias("cy"),
        (5000 + F.col("k") * F.col("k") * 40.0).alias("rx"), (9000 - F.col("k") * 130.0).alias("ry"))
    c = consensus.consensus_transform(good.unionByName(bad))
    c = c.select("pair_id", "matches", "inliers", geo.scale_of(F.col("m")).alias("scale"), geo.rotation_of(F.col("m")).alias("rotation"), "median_error", "status")
    return rounded(c, "scale", "rotation", "median_error")


# every embedding matched with a turned, scaled and bit-flipped copy of itself, one pair per label and range of 500 ids
@query("pl2_align_by_descriptors", """SELECT label || '-' || (vec_id // 500) AS pair_id, least(count(*), 100000) AS matches, count(*) AS inliers, CAST(1.25 AS DOUBLE) AS scale, CAST(-9 AS DOUBLE) AS rotation,
 'high' AS confidence, 200 AS status, 'ok' AS reason FROM embeddings GROUP BY 1""")
def pl2(spark, sf):
    e = A.sign_descriptors(spark, sf)
    x, y = F.col("embedding")[0].cast("double") * 900 + 300, F.col("embedding")[1].cast("double") * 900 + 300
    px, py = geo.apply_transform(x, y, geo.rotate_scale_about(300, 300, -9.0, 1.25, 14, -6))
    lab = F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("kp_id") / 500).cast("string"))
    cand = e.select(F.concat(F.lit("c"), lab).alias("grid_id"), "kp_id", x.alias("x"), y.alias("y"), "desc")
    flipped = F.transform("desc", lambda w: w.bitwiseXOR(F.lit(5).cast("long")))
    ref = e.select(F.concat(F.lit("r"), lab).alias("grid_id"), "kp_id", px.alias("x"), py.alias("y"), flipped.alias("desc"))
    pairs = e.select(lab.alias("pair_id"), F.concat(F.lit("r"), lab).alias("ref_id"), F.concat(F.lit("c"), lab).alias("cand_id")).distinct()
    out = align_by_descriptors(cand.unionByName(ref), pairs)
    return rounded(out.select("pair_id", "matches", "inliers", "scale", "rotation", "confidence", "status", "reason"), "scale", "rotation")
