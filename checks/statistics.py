"""Aggregation and selection queries (AG, PRD-6, NB-8, NB-9, TK-1)."""

from pyspark.sql import functions as F

from checks.base import D1, G1, V1, query, wrap
from kongrid.functions.geometry import wrap180
from kongrid.functions.regions import in_circle, in_sector, nearest_sector
from kongrid.operators import grids, stats
from kongrid.plans.appearance import match_distribution
from kongrid.sources import adapters as A



def rounded(df, *cols, n=6):
    return df.withColumns({c: F.round(F.col(c), n) for c in cols})


TONE_SQL = """SELECT {g}, count(*) AS n,
  CASE WHEN count(*) < 100 THEN 0.0 ELSE quantile_cont(v, 0.1) END AS p10,
  CASE WHEN count(*) < 100 THEN 127.5 ELSE quantile_cont(v, 0.5) END AS p50,
  CASE WHEN count(*) < 100 THEN 255.0 ELSE quantile_cont(v, 0.9) END AS p90 FROM {t} GROUP BY {g}"""


@query("ag1_robust_percentiles", f"WITH {V1}, t AS ({TONE_SQL.format(g='grp', t='v1')}) "
       "SELECT grp, n, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM t")
def ag1(spark, sf):
    t = stats.robust_percentiles(A.price_values(spark, sf), "v", ["grp"])
    return rounded(t.select("grp", "n", "tone.*"), "p10", "p50", "p90")


@query("ag1_small_groups", "WITH o AS (SELECT o_custkey AS k, o_totalprice AS v FROM orders), "
       f"t AS ({TONE_SQL.format(g='k', t='o')}) SELECT k, n, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM t")
def ag1_small(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return rounded(stats.robust_percentiles(o, "v", ["k"]).select("k", "n", "tone.*"), "p10", "p50", "p90")


@query("ag2_median_spread", f"WITH {V1} SELECT grp, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, "
       "round(greatest(4.0, quantile_cont(v, 0.9) - quantile_cont(v, 0.1)), 6) AS spread FROM v1 GROUP BY grp")
def ag2(spark, sf):
    return rounded(stats.median_spread(A.price_values(spark, sf), "v", ["grp"]).select("grp", "n", "stats.*"), "median", "spread")


SECTORS = f"""sectors AS (SELECT *, CAST(((CAST(floor(angle / 30 + 0.5) AS BIGINT) % 12) + 12) % 12 * 30 AS INTEGER) AS sector FROM d1),
inside AS (SELECT * FROM sectors WHERE abs({wrap('angle - sector')}) < 11.0)"""
MEANS = """means AS (SELECT grid_id, sector, count(*) AS n, sum(weight) AS weight_sum,
  CASE WHEN count(*) >= 50 AND sum(weight) > 1.0
       THEN ((degrees(atan2(sum(weight * sin(radians(angle))), sum(weight * cos(radians(angle))))) % 360) + 360) % 360 END AS mean_angle
  FROM inside GROUP BY 1, 2)"""


def sector_means(spark, sf):
    d = A.event_dial(spark, sf).withColumn("sector", nearest_sector(F.col("angle")))
    d = d.where(in_sector(F.col("angle"), F.col("sector")))
    return stats.circular_mean(d, "angle", "weight", ["grid_id", "sector"])


@query("ag3_circular_mean", f"WITH {D1}, {SECTORS}, {MEANS} SELECT grid_id, sector, n, round(weight_sum, 4) AS weight_sum, "
       "round(mean_angle, 6) AS mean_angle FROM means")
def ag3(spark, sf):
    return rounded(rounded(sector_means(spark, sf), "mean_angle"), "weight_sum", n=4)


@query("ag4_robust_offset", f"""WITH {D1}, {SECTORS}, {MEANS},
o AS (SELECT grid_id, {wrap('mean_angle - sector')} AS v FROM means WHERE mean_angle IS NOT NULL),
m AS (SELECT grid_id, median(v) AS m1, count(*) AS n FROM o GROUP BY 1),
k AS (SELECT o.grid_id, median(v) AS m2, count(*) AS kept FROM o JOIN m USING (grid_id) WHERE abs({wrap('v - m1')}) < 0.3 GROUP BY 1)
SELECT m.grid_id, n, CASE WHEN n >= 6 THEN coalesce(kept, 0) ELSE 0 END AS kept,
  round(CASE WHEN n < 6 THEN NULL WHEN coalesce(kept, 0) >= 5 THEN m2 ELSE m1 END, 6) AS "offset" FROM m LEFT JOIN k USING (grid_id)""")
def ag4(spark, sf):
    o = sector_means(spark, sf).withColumn("v", wrap180(F.col("mean_angle") - F.col("sector")))
    return rounded(stats.robust_offset(o, "v", ["grid_id"], tol=0.3), "offset")


@query("ag5_masked_corr", f"""WITH {G1}, p AS (SELECT a.grid_id AS pair, a.v AS a, b.v AS b FROM g1 a JOIN g1 b
  ON b.grid_id = a.grid_id AND b.y = a.y AND b.x = (a.x + 1) % 24 WHERE sqrt((a.x - 12)^2 + (a.y - 15)^2) <= 10.0)
SELECT pair, count(*) AS n, round(CASE WHEN count(*) < 100 THEN 0.0 ELSE coalesce(corr(a, b), 0.0) END, 6) AS score FROM p GROUP BY 1""")
def ag5(spark, sf):
    g = A.event_grid(spark, sf)
    a = g.select(F.col("grid_id").alias("pair"), "y", "x", F.col("v").alias("a"))
    b = g.select(F.col("grid_id").alias("pair"), "y", ((F.col("x") + 23) % 24).alias("x"), F.col("v").alias("b"))
    j = a.join(b, ["pair", "y", "x"])
    return rounded(stats.masked_corr(j, "a", "b", in_circle(F.col("x"), F.col("y"), 12, 15, 10), ["pair"]), "score")


@query("prd6_top_fraction", """WITH t AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.89) AS cut FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem JOIN t USING (l_returnflag) WHERE l_extendedprice >= cut""")
def prd6(spark, sf):
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return stats.top_fraction(li, "l_extendedprice", 0.89, ["l_returnflag"])


@query("nb8_zscore", f"""WITH {V1} SELECT l_orderkey, l_linenumber, grp,
  round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6), 6) AS z FROM v1 WINDOW w AS (PARTITION BY grp)""")
def nb8(spark, sf):
    return rounded(stats.zscore(A.price_values(spark, sf), "v", ["grp"], "z").drop("v"), "z")


@query("nb9_percentile_stretch", f"""WITH {G1}, q AS (SELECT grid_id, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.97) AS hi FROM g1 GROUP BY 1)
SELECT grid_id, y, x, round(CASE WHEN hi <= lo THEN 0.0 ELSE greatest(0.0, least(255.0, (v - lo) * 255.0 / (hi - lo))) END, 6) AS s
FROM g1 JOIN q USING (grid_id)""")
def nb9(spark, sf):
    return rounded(stats.percentile_stretch(A.event_grid(spark, sf), "v", ["grid_id"], out="s").drop("v"), "s")


@query("tk1_best_candidate", """WITH c AS (SELECT l_suppkey, l_orderkey, l_linenumber,
  round(1.4 * sqrt(((l_quantity - 25) / 50)^2 + ((l_discount * 1000 - 50) / 100)^2) + abs(l_tax * 250 / 50 - 0.30), 6) AS score FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score, l_orderkey, l_linenumber) AS k FROM c) WHERE k = 1""")
def tk1(spark, sf):
    li = A.table(spark, sf, "lineitem")
    s = stats.anchor_preference(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_tax") * 250, F.lit(50), F.lit(100))
    c = li.select("l_suppkey", "l_orderkey", "l_linenumber", F.round(s, 6).alias("score"))
    return stats.best_candidate(c, F.col("score"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


PL4_SQL = """, q AS (SELECT grp, count(*) AS n, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90 FROM v1 GROUP BY 1)
SELECT l_orderkey, l_linenumber, grp, round(v * 0.15 + 0.85 * greatest(0.0, least(255.0, t.p50 + (v - s.p50) *
  CASE WHEN v <= s.p50 THEN greatest(0.45, least(2.2, (t.p50 - t.p10) / greatest(8.0, s.p50 - s.p10)))
       ELSE greatest(0.45, least(2.2, (t.p90 - t.p50) / greatest(8.0, s.p90 - s.p50))) END)), 6) AS matched
FROM v1 JOIN q s USING (grp) CROSS JOIN (SELECT * FROM q WHERE grp = 'N') t"""
SCALED = "v1 AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, l_extendedprice / 397.0 AS v FROM lineitem)"


@query("pl4_match_distribution", f"WITH {SCALED}{PL4_SQL}")
def pl4(spark, sf):
    v = A.price_values(spark, sf).withColumn("v", F.col("v") / 397.0)
    return rounded(match_distribution(v, "v", "grp", "N", 0.85).drop("v"), "matched")
