import pytest
from pyspark.sql import functions as F

from kongrid.functions import color, geometry as geo
from kongrid.operators import detect, neighborhood as nb, search
from kongrid.operators.warp import warp
from kongrid.plans.appearance import match_appearance, match_distribution
from kongrid.sources import adapters as A
from kongrid.sources import store


@pytest.fixture(scope="module")
def dials(spark):
    rows = [("a", 48.0, 47.0, 30.0, 0.0, 1.0, 1.0, 0.0), ("b", 53.0, 44.0, 30.0, 0.0, 1.0, 1.0, 0.0), ("c", 48.0, 47.0, 30.0, 6.0, 1.0, 0.7, 30.0)]
    p = spark.createDataFrame(rows, "grid_id string, cx double, cy double, r double, rotation double, ratio double, gain double, offset double")
    return A.draw_dials(p, 96), p.select("grid_id", "cx", "cy", "r")


def test_identity_warp_returns_the_input(spark, dials):
    g, _ = dials
    t = g.select("grid_id").distinct().withColumn("m", geo.identity())
    j = warp(g, t, 96, 96, out=["grid_id"]).withColumnRenamed("v", "w").join(g, ["grid_id", "y", "x"])
    assert j.where("valid AND v = w").count() == g.count()


def test_known_shift_is_found(spark, dials):
    g, _ = dials
    pairs = spark.createDataFrame([("s", "a", "a"), ("m", "a", "b")], "pair_id string, ref_id string, cand_id string")
    r = {x["pair_id"]: x for x in search.shift_search(g, g, pairs, 8, outer=1e9, side=96).collect()}
    assert (r["s"]["dx"], r["s"]["dy"]) == (0, 0) and abs(r["s"]["score"] - 1) < 1e-6
    assert (r["m"]["dx"], r["m"]["dy"]) == (-5, 3)


def test_anchor_and_blank(spark, dials):
    g, a = dials
    blank = spark.range(96).select(F.lit("blank").alias("grid_id"), F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(95)))).withColumn("v", F.lit(7.0))
    found = {r["grid_id"]: r for r in detect.detect_anchor(g.unionByName(blank)).collect()}
    assert set(found) == {"a", "b", "c"}
    for r in a.collect():
        f = found[r["grid_id"]]
        assert abs(f["cx"] - r["cx"]) <= 2 and abs(f["cy"] - r["cy"]) <= 2 and abs(f["r"] - r["r"]) <= 2.5
    o = {r["grid_id"]: r for r in detect.orientation(blank, spark.createDataFrame([("blank", 48.0, 48.0, 30.0)], a.schema)).collect()}
    assert o["blank"]["angle"] is None and o["blank"]["markers"] == 0


def test_strength_zero_changes_nothing(spark, dials):
    g, _ = dials
    m = match_distribution(g, "v", "grid_id", "a", 0.0)
    assert m.where(F.abs(F.col("matched") - F.col("v")) > 1e-9).count() == 0
    pair = g.where("grid_id = 'a'").alias("p").join(g.where("grid_id = 'c'").alias("q"), ["y", "x"])
    cells = pair.select(F.lit("x").alias("pair_id"), "y", "x", *[F.col("p.v").alias(f"ref_{c}") for c in "bgr"], *[F.col("q.v").alias(f"cand_{c}") for c in "bgr"], F.lit(True).alias("valid"))
    same, rep = match_appearance(cells, 0.0, F.lit(True))
    assert same.where("abs(b - cand_b) > 1e-6").count() == 0
    _, rep = match_appearance(cells, 1.0, F.lit(True))
    assert rep.collect()[0]["improvement"] > 0.5


def test_lab_of_white_and_black(spark):
    r = spark.range(1).select(color.bgr_to_lab(F.lit(255), F.lit(255), F.lit(255)).alias("w"), color.bgr_to_lab(F.lit(0), F.lit(0), F.lit(0)).alias("k")).collect()[0]
    assert abs(r["w"]["l"] - 255) < 0.01 and abs(r["w"]["a"] - 128) < 0.05 and abs(r["k"]["l"]) < 1e-6


def test_short_lines_do_not_fail(spark):
    g = spark.createDataFrame([("g", y, x, 5.0) for y in range(2) for x in range(3)], "grid_id string, y int, x int, v double")
    assert nb.gaussian_blur(g, 3.0).where("abs(v - 5) > 1e-9").count() == 0


def test_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("aa-1", (0.5, True)), ("bb-2", (0.7, False))], "session_id string, metrics struct<score:double,ok:boolean>")
    store.write_results(df, str(tmp_path / "m"), ["session_id"], "2026-01-01")
    back = store.read_results(spark, str(tmp_path / "m"))
    assert {(r["session_id"], r["metrics"]["score"], r["metrics_json"]) for r in back.collect()} == {("aa-1", 0.5, '{"score":0.5,"ok":true}'), ("bb-2", 0.7, '{"score":0.7,"ok":false}')}
    views = spark.createDataFrame([("aa-1", "overlay", 0, 0, 1.0)], "session_id string, view string, y int, x int, b double")
    store.write_results(views, str(tmp_path / "v"), ["session_id"], "2026-01-01", views=True)
    assert store.read_results(spark, str(tmp_path / "v")).where("view = 'overlay'").count() == 1
