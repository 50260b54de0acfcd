"""Neighbourhood operators on dense grids.

Blurs, derivatives and what follows from them are stencils on whole tiles (`stencils`): a chain of them is one shuffle, and
a cell is never multiplied by the number of kernel taps. Two-dimensional kernels are separable: one pass along x, one along
y. Borders are mirrored without repeating the edge cell. Openings are windows over lines.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kongrid.operators import packs
from kongrid.operators import stencils as st
from kongrid.operators.cut import cut, settled
from kongrid.operators.grids import dims, values_of
from kongrid.operators.keys import attach_small

KEYS = ["grid_id"]
OTHER = {"x": "y", "y": "x"}


def line(axis: str, keys: list[str]) -> Window:
    return Window.partitionBy(*keys, OTHER[axis]).orderBy(axis)


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    radius = math.ceil(3 * sigma) if radius is None else radius
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_blur(grid: DataFrame, sigma: float, radius: int | None = None, v: str = "v", keys: list[str] = KEYS) -> DataFrame:
    blur = st.smooth(v, gaussian_kernel(sigma, radius))
    return st.stencil(grid, [blur], [v], {v: T.DoubleType()}, keys).select(*grid.columns)


def _slope_type(grid: DataFrame, v: str) -> T.DataType:
    """Differences of whole numbers are whole numbers."""
    kind = grid.schema[v].dataType
    return kind if isinstance(kind, (T.IntegerType, T.LongType)) else T.DoubleType()


def sobel(grid: DataFrame, v: str = "v", keys: list[str] = KEYS, blur: tuple | None = None) -> DataFrame:
    """3x3 derivatives gx, gy, of the grid blurred by `blur` (sigma, radius) if given; v is the blurred value then."""
    return _derived(grid, v, keys, blur, [])


def gradient(grid: DataFrame, v: str = "v", keys: list[str] = KEYS, log: bool = False, blur: tuple | None = None) -> DataFrame:
    return _derived(grid, v, keys, blur, [st.magnitude(log)], mag=T.DoubleType())


def _derived(grid: DataFrame, v: str, keys: list[str], blur: tuple | None, more: list, **writes) -> DataFrame:
    """Blur, derivatives and what follows from them, in one shuffle."""
    before = [st.smooth(v, gaussian_kernel(*blur))] if blur else []
    kind = T.DoubleType() if blur else _slope_type(grid, v)
    names = [*grid.columns, *[c for c in ("gx", "gy", *writes) if c not in grid.columns]]
    writes = ({v: T.DoubleType()} if blur else {}) | {"gx": kind, "gy": kind} | writes
    return st.stencil(grid, [*before, st.slopes(v), *more], [v], writes, keys).select(*names)


def per_grid_max(grid: DataFrame, v: str, keys: list[str] = KEYS) -> DataFrame:
    """Divide by the largest value of the grid (+1e-6)."""
    top = grid.groupBy(*keys).agg(F.max(v).alias("_top"))
    return attach_small(grid, top, keys).withColumn(v, F.col(v) / (F.col("_top") + 1e-6)).drop("_top")


def highpass(grid: DataFrame, sigma: float = 3.0, radius: int | None = None, v: str = "v", keys: list[str] = KEYS) -> DataFrame:
    """What remains above a wide blur. The original value rides through both passes: no join."""
    blurred = gaussian_blur(grid.withColumn("_raw", F.col(v)), sigma, radius, v, keys)
    return blurred.withColumn(v, F.greatest(F.lit(0.0), F.col("_raw") - F.col(v))).drop("_raw")


def top_hat(grid: DataFrame, width: int = 13, height: int = 5, v: str = "v", keys: list[str] = KEYS) -> DataFrame:
    """v minus its opening by a rectangle, over 255. Cells outside the grid take no part."""
    hw, hh = width // 2, height // 2
    wx = line("x", keys).rowsBetween(-hw, hw)
    wy = line("y", keys).rowsBetween(-hh, hh)
    g = grid.withColumn("_o", F.min(v).over(wx)).withColumn("_o", F.min("_o").over(wy))
    # both vertical steps share one shuffle
    g = g.withColumn("_o", F.max("_o").over(wy)).withColumn("_o", F.max("_o").over(wx))
    return g.withColumn(v, (F.col(v) - F.col("_o")) / 255.0).drop("_o")


# ---------------------------------------------------------------- contrast-limited equalisation


def _tile_curves(levels: pd.Series, counts: pd.Series, limit: pd.Series, area: pd.Series) -> pd.Series:
    """Clipped and cumulated 256-bin histogram of each tile, scaled to 0-255."""
    out = []
    for lv, ct, top, n in zip(levels, counts, limit, area, strict=True):
        h = np.zeros(256, dtype=np.int64)
        h[np.asarray(lv)] = ct
        out.append(st.clipped_curve(h, top, n))
    return pd.Series(out)


def within_side(grid: DataFrame, side: int) -> bool:
    """Whether every grid lies within `side` x `side` cells."""
    e = grid.agg(F.least(F.min("y"), F.min("x")).alias("low"), F.greatest(F.max("y"), F.max("x")).alias("high")).first()
    return e["low"] is None or (e["low"] >= 0 and e["high"] < side)


def within_tile(grid: DataFrame) -> bool:
    """Whether every grid lies within one tile of the stencils."""
    return within_side(grid, st.TILE)


def _keyed(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that belong to a grid and to a place of it."""
    return grid.dropna(subset=[*keys, "y", "x"])


def tile_equalize(
    grid: DataFrame, clip: float = 2.0, tiles_y: int = 8, tiles_x: int = 8, v: str = "v", keys: list[str] = KEYS
) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of 0-255 values.

    Each tile's clipped histogram becomes a 256-entry curve. Cells between the same four tile centres
    share one row of four curves, so a cell meets its curves through a single join on (grid, quad).
    Grids within one tile of the stencils are equalised where they meet, in one shuffle.
    """
    if within_tile(grid):
        step = st.equalize(v, clip, tiles_y, tiles_x)
        return st.stencil(_keyed(grid, keys), [step], [v], {v: T.DoubleType()}, keys).select(*grid.columns)
    g = attach_small(grid, dims(grid, keys), keys)
    th, tw = F.ceil(F.col("height") / tiles_y), F.ceil(F.col("width") / tiles_x)
    g = g.withColumns({"_ty": F.floor(F.col("y") / th), "_tx": F.floor(F.col("x") / tw)})
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col(v)))).cast("int")
    hist = g.groupBy(*keys, "_ty", "_tx", level.alias("_l")).agg(F.count("*").alias("_c"))
    tile = hist.groupBy(*keys, "_ty", "_tx").agg(F.sum("_c").alias("_area"), F.sort_array(F.collect_list(F.struct("_l", "_c"))).alias("_h"))
    curve = F.pandas_udf(_tile_curves, "array<double>")
    limit = F.greatest(F.lit(1), F.floor(F.lit(float(clip)) * F.col("_area") / 256))
    tile = tile.select(*keys, "_ty", "_tx", curve(F.col("_h._l"), F.col("_h._c"), limit, F.col("_area")).alias("_curve"))
    tile = cut(tile)
    counts = tile.groupBy(*keys).agg(F.max("_ty").alias("_my"), F.max("_tx").alias("_mx"))
    tile = attach_small(tile.select(*keys, "_ty", "_tx", "_curve"), counts, keys)

    # quad q lies between tile centres q-1 and q; at the border both are the border tile
    def quads(t, top):
        return F.array_compact(F.array(
            F.when(F.col(t) >= 0, F.struct(F.col(t).alias("q"), F.lit(1).alias("s"))),
            F.struct((F.col(t) + 1).alias("q"), F.lit(0).alias("s")),
            F.when(F.col(t) == 0, F.struct(F.col(t).alias("q"), F.lit(0).alias("s"))),
            F.when(F.col(t) == F.col(top), F.struct((F.col(t) + 1).alias("q"), F.lit(1).alias("s"))),
        ))

    corner = tile.withColumn("_a", F.explode(quads("_ty", "_my"))).withColumn("_b", F.explode(quads("_tx", "_mx")))
    quad = corner.groupBy(*keys, F.col("_a.q").alias("_qy"), F.col("_b.q").alias("_qx")).agg(*[
        F.max(F.when((F.col("_a.s") == i) & (F.col("_b.s") == j), F.col("_curve"))).alias(f"_c{i}{j}") for i in (0, 1) for j in (0, 1)
    ])
    fy, fx = F.col("y") / th - 0.5, F.col("x") / tw - 0.5
    g = g.withColumns({"_qy": F.floor(fy) + 1, "_qx": F.floor(fx) + 1, "_wy": fy - F.floor(fy), "_wx": fx - F.floor(fx), "_l": level + 1})
    # the curves are wide rows: keep them on the shuffled side
    g = g.join(quad.hint("merge"), [*keys, "_qy", "_qx"])

    def look(i, j):
        return F.element_at(f"_c{i}{j}", F.col("_l"))

    wy, wx = F.col("_wy"), F.col("_wx")
    top = look(0, 0) * (1 - wx) + look(0, 1) * wx
    bottom = look(1, 0) * (1 - wx) + look(1, 1) * wx
    return g.withColumn(v, top * (1 - wy) + bottom * wy).select(*grid.columns)


# ---------------------------------------------------------------- edges


def thin_edges(grid: DataFrame, v: str = "v", keys: list[str] = KEYS, blur: tuple | None = None) -> DataFrame:
    """Gradient and non-maximum suppression: `mag`, `is_ridge`, plus gx, gy for voting."""
    return _derived(grid, v, keys, blur, [st.magnitude(), st.ridges()], mag=T.DoubleType(), is_ridge=T.BooleanType())


def linked_ridges(thinned: DataFrame, low: float, high: float, keys: list[str] = KEYS) -> DataFrame:
    """Places (keys, y, x) of ridges above `high`, and of ridges above `low` connected to them."""
    state = F.when(F.col("is_ridge") & (F.col("mag") > high), 2).when(F.col("is_ridge") & (F.col("mag") > low), 1)
    ridge = thinned.withColumn("state", state).where(F.col("state").isNotNull()).select(*keys, "y", "x", "state")
    return link(ridge.where("state = 2").drop("state"), ridge.where("state = 1").drop("state"), keys)


def thin_edges_and_blur(grid: DataFrame, of: list[str], v: str, sigma: float, keys: list[str] = KEYS) -> DataFrame:
    """`thin_edges` of each column `of` (`<column>_mag`, `<column>_is_ridge`) and the Gaussian blur of `v`, in one shuffle.

    `copies` tells how many rows the grid has at a cell's place. The columns `of` are not kept.
    """
    steps = [st.beside(of, lambda c: [st.slopes(c), st.magnitude(), st.ridges()], ["mag", "is_ridge"]), st.copies(), st.smooth(v, gaussian_kernel(sigma))]
    writes = {f"{c}_{n}": t for c in of for n, t in (("mag", T.DoubleType()), ("is_ridge", T.BooleanType()))}
    keep = [c for c in grid.columns if c not in of]
    return st.stencil(grid, steps, [*of, v], writes | {"copies": T.LongType(), v: T.DoubleType()}, keys, keep)


def edge_cells(grid: DataFrame, low: float = 70.0, high: float = 160.0, v: str = "v", keys: list[str] = KEYS) -> DataFrame:
    """Cells of the grid with `edge`: ridges above `high`, and ridges above `low` connected to them."""
    g = cut(thin_edges(grid, v, keys).select(*grid.columns, "mag", "is_ridge"))
    marks = linked_ridges(g, low, high, keys).withColumn("edge", F.lit(True))
    out = g.drop("mag", "is_ridge").join(marks, [*keys, "y", "x"], "left")
    return out.withColumn("edge", F.coalesce("edge", F.lit(False)))


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component under links (a, b): smallest labels meet at roots, chains are halved."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    return label


def _tile_parts(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Component (number of its first cell) of each cell of one tile under the 8-neighbourhood."""
    place = np.full((int(y.max()) + 3, int(x.max()) + 3), -1)
    place[y + 1, x + 1] = np.arange(len(y))
    pairs = [(np.arange(len(y)), place[y + 1 + dy, x + 1 + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = (np.concatenate(c) for c in zip(*pairs))
    return connected(len(y), a[b >= 0], b[b >= 0])


def link(strong: DataFrame, weak: DataFrame, keys: list[str] = KEYS, tile: int = 128) -> DataFrame:
    """All strong cells and every weak cell that touches them through weak cells (8-neighbourhood).

    Cells are joined to parts inside tiles, one group a tile. Only parts with a cell on their tile's border can go on in
    another one; their border cells are matched once, and the links between parts are contracted per grid. A grid has at
    most schemas.MAX_CELLS cells, and of those only border cells of ridges come here. So one round does whatever the length
    of a chain, and nothing is decided on the driver.
    """
    types = [f"`{k}` {strong.schema[k].dataType.simpleString()}" for k in keys]
    both = strong.select(*keys, "y", "x", F.lit(True).alias("strong")).unionByName(weak.select(*keys, "y", "x", F.lit(False).alias("strong")))
    cells = both.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "strong")
    cells = cells.withColumns({f"t{c}": F.floor(F.col(c) / tile).cast("int") for c in "yx"})

    def parts(table: pa.Table) -> pa.Table:
        ty, tx = table["ty"][0].as_py(), table["tx"][0].as_py()
        y, x = table["y"].to_numpy() - ty * tile, table["x"].to_numpy() - tx * tile
        strong = table["strong"].to_numpy()
        part = _tile_parts(y, x)
        border = (y == 0) | (x == 0) | (y == tile - 1) | (x == tile - 1)
        own, opened = np.zeros(len(y), bool), np.zeros(len(y), bool)
        own[part[strong]] = True
        opened[part[border]] = True
        # a part's name within its grid
        name = pa.array((np.int64(ty) << 40) + (np.int64(tx) << 20) + part)
        columns = {"part": name, "own": pa.array(own[part]), "open": pa.array(opened[part]), "border": pa.array(border)}
        return pa.table({k: table[k] for k in (*keys, "y", "x")} | columns)

    made = cut(cells.groupBy(*keys, "ty", "tx").applyInArrow(parts, f"{', '.join(types)}, y int, x int, part long, own boolean, open boolean, border boolean"))
    edge = made.where("border").select(*keys, "y", "x", "part", "own")
    near = F.sequence(F.lit(-1), F.lit(1))
    around = edge.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near)).select(*keys, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x"), F.col("part").alias("other"), F.col("own").alias("other_own"))
    touching = around.join(edge, [*keys, "y", "x"]).where("part < other").select(*keys, "part", "other", "own", "other_own").distinct()

    def contract(table: pa.Table) -> pa.Table:
        a, b = table["part"].to_numpy(), table["other"].to_numpy()
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = connected(len(names), at[: len(a)], at[len(a) :])
        seen = np.zeros(len(names), bool)
        seen[root[at[np.concatenate([table["own"].to_numpy(), table["other_own"].to_numpy()])]]] = True
        reached = names[seen[root]]
        one = pa.array(np.zeros(len(reached), np.int64))
        return pa.table({k: table[k].combine_chunks().take(one) for k in keys} | {"part": pa.array(reached)})

    reached = touching.groupBy(*keys).applyInArrow(contract, f"{', '.join(types)}, part long").withColumn("reached", F.lit(True))
    inside = made.where("own").select(*keys, "y", "x")
    other = made.where("open and not own").join(reached, [*keys, "part"], "left_semi").select(*keys, "y", "x")
    return inside.unionByName(other)


# ---------------------------------------------------------------- sampling and feature maps


def bilinear_sample(grid: DataFrame, points: DataFrame, keys: list[str] = KEYS, vals: list[str] | None = None) -> DataFrame:
    """Value at real-valued (px, py) points; points without all four neighbours are dropped."""
    return st.sample(grid, points, keys, vals or values_of(grid, keys))


def _whole_maps(grid: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """`feature_map` (gradient or dial) of grids within a tile: every step, and the statistic of the whole grid, where its cells meet."""
    dial = kind == "dial"
    steps = [st.equalize("v", 2.0, 8, 8), st.slopes("v"), st.magnitude(dial), st.smooth("mag", gaussian_kernel(0.65 if dial else 1.0))]
    schema = T.StructType([*[grid.schema[k] for k in keys], *packs.PACKED])
    none = to_arrow_schema(schema).empty_table()

    def run(key: pa.Table, y: np.ndarray, x: np.ndarray, cells: dict) -> pa.Table:
        if any(key[k].null_count for k in keys):
            return none
        if dial:
            y, x, (own,) = packs.merged(y, x, [cells["v"]])
        else:
            own = cells["v"][0].astype(np.float64), cells["v"][1]
        lines, of = st.Lines(y, x), {"v": own}
        for step in steps:
            step(of, lines)
        value, known = of["mag"]
        if known.any():
            seen = value[known]
            value = (value - seen.mean()) / (seen.std() + 1e-6) if dial else value / (seen.max() + 1e-6)
        return packs.row_of(key, keys, y, x, value, known)

    made = cut(packs.per_grid(grid, keys, ["v"], run, schema))
    whole = T.IntegerType() if dial else None
    return packs.opened(made, keys, *[whole or grid.schema[c].dataType for c in "yx"])


def feature_map(grid: DataFrame, kind: str, keys: list[str] = KEYS, side: int = 512, v: str = "v") -> DataFrame:
    """Lighting-resistant maps: `gradient`, `text` and `dial`.

    Steps that need a statistic of the whole grid read it twice, so the map is written before them.
    """
    from kongrid.operators.grids import area_downsample
    from kongrid.operators.stats import zscore

    base = grid.select(*keys, "y", "x", F.col(v).alias("v"))
    base = settled(base) if kind in ("gradient", "dial") else base
    if kind in ("gradient", "dial") and packs.packable(base, ["v"]) and within_tile(base) and (kind == "gradient" or side >= st.TILE or within_side(base, side)):
        return _whole_maps(base, kind, keys)
    if kind in ("gradient", "dial"):
        base = cut(base if kind == "gradient" else area_downsample(base, side, keys))
        if within_tile(base):
            steps = [st.equalize("v", 2.0, 8, 8), st.slopes("v"), st.magnitude(kind == "dial"), st.smooth("mag", gaussian_kernel(1.0 if kind == "gradient" else 0.65))]
            m = st.stencil(_keyed(base, keys), steps, ["v"], {"mag": T.DoubleType()}, keys, [*keys, "y", "x"]).withColumnRenamed("mag", "v")
            return per_grid_max(cut(m), "v", keys) if kind == "gradient" else zscore(cut(m), "v", keys)
    if kind == "gradient":
        m = gradient(tile_equalize(base, keys=keys), keys=keys).select(*keys, "y", "x", F.col("mag").alias("v"))
        return per_grid_max(cut(gaussian_blur(m, 1.0, keys=keys)), "v", keys)
    if kind == "text":
        eq = tile_equalize(base, 2.2, 6, 6, keys=keys)
        hat = top_hat(eq.withColumn("t", F.col("v")), v="t", keys=keys)
        m = per_grid_max(cut(gradient(hat, keys=keys)), "mag", keys)
        mixed = m.select(*keys, "y", "x", (F.col("mag") * 0.72 + F.col("t") * 0.28).alias("v"))
        return gaussian_blur(mixed, 0.8, keys=keys)
    if kind == "dial":
        m = gradient(tile_equalize(base, keys=keys), keys=keys, log=True).select(*keys, "y", "x", F.col("mag").alias("v"))
        return zscore(cut(gaussian_blur(m, 0.65, keys=keys)), "v", keys)
    raise ValueError(f"unknown feature map {kind!r}")
