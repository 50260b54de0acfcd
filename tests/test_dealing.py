"""Which tiles a cell is dealt to."""

import pytest
from pyspark.sql import functions as F

from kongrid.operators import stencils

T = stencils.TILE


def plain(v, reach, up):
    if v is None:
        return []
    own, at = v // T, v % T
    return [own, *([own - 1] if at < reach and own else []), *([own + 1] if at >= T - up else [])]


@pytest.mark.parametrize("reach,up", [(3, 3), (1, 0), (300, 300), (0, 0), (0, 5)])
def test_cells_reach_every_tile_that_needs_them(spark, reach, up):
    places = [0, 1, 2, 3, T - 5, T - 1, T, T + 1, 700, 2 * T - 1, 2 * T, None]
    cells = spark.createDataFrame([(y, x) for y in places for x in places], "y int, x int")
    got = [tuple(r) for r in stencils.tiled(cells, reach, up).select("y", "x", "_ty", "_tx").collect()]
    expected = [(y, x, ty, tx) for y in places for x in places for ty in plain(y, reach, up) for tx in plain(x, reach, up)]
    assert sorted(got) == sorted(expected)


def test_dealing_is_generated_code(spark):
    cells = spark.range(100).select(F.col("id").cast("int").alias("y"), F.col("id").cast("int").alias("x"))
    lines = [x for x in stencils.tiled(cells, 3)._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate explode" in x]
    # a lambda in the arrays kept both steps out of it
    assert len(lines) == 2 and all("*(" in x for x in lines)
