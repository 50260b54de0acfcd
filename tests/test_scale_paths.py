"""The paths taken only by large inputs, forced on small ones and compared with brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kongrid.operators.keys import attach, attach_small
from kongrid.operators.matching import knn_ratio, mutual_nn, nearest_codes
from kongrid.operators.neighborhood import link
from kongrid.operators.quantiles import group_quantiles


@pytest.mark.parametrize("kind", ["wide", "copies", "narrow", "signed"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(7)
    v = {
        "wide": rng.lognormal(0, 9, 1500), "copies": np.where(rng.random(1500) < 0.6, 5.0, rng.integers(0, 9, 1500)),
        "narrow": 1e6 + rng.random(1500) * 1e-3, "signed": rng.normal(0, 3, 1500),
    }[kind]
    g = np.where(np.arange(1500) < 1200, "hot", "cold")
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.853, "e": 1.0}
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs, limit=10).collect()}
    for key in ("hot", "cold"):
        want = np.quantile(v[g == key], list(probs.values()))
        assert np.allclose([got[key][k] for k in probs], want, rtol=1e-12, atol=0)
        assert got[key]["n"] == (g == key).sum()


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "g string, v double")
    assert group_quantiles(df, ["g"], "v", {"m": 0.5}, limit=0).collect()[0][1:] == (2, 2.0)


def test_attach_without_broadcast_keeps_every_row(spark):
    rows = spark.range(5000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 97)).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    a = sorted(map(tuple, attach(rows, stats, ["k"], "n").collect()))
    b = sorted(map(tuple, attach(rows, stats, ["k"], "n", limit=0).collect()))
    assert a == b and len(a) == 5000
    assert attach_small(rows, stats, ["k"], limit=0).count() == 5000


def test_blocked_matching_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    codes = rng.integers(-(2**63), 2**63 - 1, (60, 4), dtype=np.int64)
    cand = codes[rng.integers(0, 60, 150)]
    ref = np.concatenate([codes[:40] ^ (1 << 7), rng.integers(-(2**63), 2**63 - 1, (30, 4), dtype=np.int64), codes[:5] ^ (1 << 7)])
    rows = [("c", i, c.tolist()) for i, c in enumerate(cand)] + [("r", i, c.tolist()) for i, c in enumerate(ref)]
    desc = spark.createDataFrame(rows, "grid_id string, kp_id long, desc array<long>")
    pairs = spark.createDataFrame([("p", "r", "c")], "pair_id string, ref_id string, cand_id string")
    d = np.bitwise_count((cand[:, None, :] ^ ref[None, :, :]).view(np.uint64)).sum(-1).astype(int)
    order = np.sort(d, axis=1)
    want = {(i, int(d[i].argmin()), int(order[i, 0])) for i in range(len(cand)) if order[i, 0] < 0.76 * order[i, 1]}
    near = nearest_codes(desc, pairs, block=16)
    got = {(r["cand_kp"], r["ref_kp"], r["distance"]) for r in knn_ratio(desc, pairs, near=near).collect()}
    assert got == want and len(got) > 20
    both = {(i, int(d[i].argmin())) for i in range(len(cand)) if d[:, d[i].argmin()].argmin() == i}
    assert {(r["cand_kp"], r["ref_kp"]) for r in mutual_nn(desc, pairs, None, near).collect()} == both


@pytest.mark.parametrize("tile", [4, 128])
def test_linking_follows_a_long_chain(spark, tile):
    chain = [("g", 0, x) for x in range(1, 14)] + [("g", 5, x) for x in range(4)]
    weak = spark.createDataFrame(chain, "grid_id string, y int, x int")
    strong = spark.createDataFrame([("g", 1, 0)], "grid_id string, y int, x int")
    got = {(r["y"], r["x"]) for r in link(strong, weak, tile=tile).collect()}
    assert got == {(1, 0)} | {(0, x) for x in range(1, 14)}


@pytest.mark.parametrize("tile", [3, 8])
def test_tile_linking_equals_flood_fill(spark, tile):
    """Random ridges of two grids, and a spiral that crosses many tiles, against a walk cell by cell."""
    rng = np.random.default_rng(11)
    grids = {}
    for name in "ab":
        cells = {(int(y), int(x)) for y, x in rng.integers(0, 30, (330, 2))}
        grids[name] = (cells, {c for c in cells if rng.random() < 0.04})
    spiral, y, x, dy, dx = set(), 0, 0, 0, 1
    for n in (30, 30, 30, 26, 26, 22, 22, 18, 18, 14, 14, 10, 10):
        for _ in range(n):
            spiral.add((y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    grids["s"] = (spiral, {max(spiral, key=lambda c: -abs(c[0] - 14) - abs(c[1] - 14))})
    want = set()
    for name, (cells, strong) in grids.items():
        todo = list(strong)
        seen = set(strong)
        while todo:
            a, b = todo.pop()
            for c in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if c in cells and c not in seen:
                    seen.add(c)
                    todo.append(c)
        want |= {(name, *c) for c in seen}
    rows = [(n, *c, c in st) for n, (cells, st) in grids.items() for c in cells]
    df = spark.createDataFrame(rows, "grid_id string, y int, x int, s boolean").repartition(3)
    got = link(df.where("s").drop("s"), df.where("not s").drop("s"), tile=tile)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
