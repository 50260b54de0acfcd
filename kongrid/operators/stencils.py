"""Stencils on whole tiles of grids: one shuffle for a chain of line passes.

Cells are dealt to tiles of TILE x TILE with the border that a chain of steps reaches, so a grid within TILE is one group and
a larger one spreads over its tiles. In a group the neighbours of a cell are found by their order along its line, as lag and
lead do, so that missing and repeated cells of a grid within one tile are treated as a window over the line treats them.
Grids above TILE are dense. Cells travel packed (`packs`); a group that is a full rectangle of known cells is worked on as one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kongrid.operators import packs

TILE = 512

# A column inside a task: values, and which of them are not null.
Cells = tuple[np.ndarray, np.ndarray]


class Lines:
    """Neighbours of cells along their lines."""

    def __init__(self, y: np.ndarray, x: np.ndarray):
        self.n, self.y, self.x = len(y), y, x

    @cached_property
    def sorted(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        out = {}
        for axis, along, across in (("x", self.x, self.y), ("y", self.y, self.x)):
            order = np.lexsort((along, across))
            out[axis] = order, across[order]
        return out

    @cached_property
    def shape(self) -> tuple[int, int] | None:
        """Height and width where the cells are a full rectangle, line after line."""
        order = packs.row_major(self.y, self.x)
        if order is None or (order != np.arange(self.n)).any():
            return None
        return int(self.y[-1] - self.y[0]) + 1, int(self.x[-1] - self.x[0]) + 1

    def plane(self, *of: Cells) -> list[np.ndarray] | None:
        """The values as planes, where nothing is missing."""
        if self.shape is None or not all(c[1].all() for c in of):
            return None
        return [c[0].reshape(self.shape) for c in of]

    def flat(self, plane: np.ndarray) -> Cells:
        return plane.reshape(-1), np.ones(self.n, bool)

    def at(self, axis: str, by: int) -> np.ndarray:
        """Place of the cell `by` steps further on this axis; the number of cells where there is none."""
        order, line = self.sorted[axis]
        out, k = np.full(self.n, self.n), abs(by)
        if k < self.n:
            same = line[k:] == line[: self.n - k]
            low, high = order[: self.n - k][same], order[k:][same]
            out[low if by > 0 else high] = high if by > 0 else low
        return out

    def take(self, cells: Cells, axis: str, by: int) -> Cells:
        place = self.at(axis, by)
        return np.append(cells[0], 0.0)[place], np.append(cells[1], False)[place]

    def step(self, cells: Cells, axis: str, by: int) -> Cells:
        """The neighbour `by` cells away; at the border its mirror image."""
        near, mirror = self.take(cells, axis, by), self.take(cells, axis, -by)
        value = np.where(near[1], near[0], np.where(mirror[1], mirror[0], cells[0]))
        return value, near[1] | mirror[1] | cells[1]


Step = Callable[[dict, Lines], None]


def beyond(a: np.ndarray, axis: int, by: int, mirror: bool = True) -> np.ndarray:
    """`Lines.step` (without `mirror`: `Lines.take`, 0 where there is none) of a plane, for a neighbour next to each cell."""
    a = a if axis else a.T
    out = np.empty_like(a)
    if by > 0:
        out[:, :-1], rest, inner = a[:, 1:], out[:, -1:], a[:, -2:-1]
    else:
        out[:, 1:], rest, inner = a[:, :-1], out[:, :1], a[:, 1:2]
    rest[:] = 0 if not mirror else inner if a.shape[1] > 1 else a
    return out if axis else out.T


def mirrored_sum(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sum along an axis that is longer than the reach of the kernel, with mirrored borders."""
    radius, n = len(weights) // 2, a.shape[axis]
    p = np.take(a, np.concatenate([np.arange(radius, 0, -1), np.arange(n), np.arange(n - 2, n - 2 - radius, -1)]), axis)
    total = np.zeros(a.shape)
    for k, wt in enumerate(weights):
        total += (p[:, k : k + n] if axis else p[k : k + n]) * wt
    return total


def smooth(v: str, weights: list[float]) -> Step:
    """Weighted sum along x, then along y, with mirrored borders; a tap outside the line is read from the mirrored
    tap inside it, and a line shorter than the kernel renormalises over the taps it has."""
    radius = len(weights) // 2

    def line(cells: Cells, lines: Lines, axis: str) -> Cells:
        taps = [lines.take(cells, axis, k) if k else cells for k in range(-radius, radius + 1)]
        before, after = (sum(ok.astype(np.int64) for _, ok in part) for part in (taps[:radius], taps[radius + 1 :]))
        total, weight = np.zeros(lines.n), np.zeros(lines.n)
        for k, wt in zip(range(-radius, radius + 1), weights, strict=True):
            value, have = taps[radius + k]
            if k and not have.all():
                value, have = value.copy(), have.copy()
                mirror = radius - k + (2 * after if k > 0 else -2 * before)
                for m in range(2 * radius + 1):
                    where = np.flatnonzero(~taps[radius + k][1] & (mirror == m))
                    if len(where):
                        value[where], have[where] = taps[m][0][where], taps[m][1][where]
            total += np.where(have, value * wt, 0.0)
            weight += np.where(have, wt, 0.0)
        short = before + after < radius
        if short.any():
            with np.errstate(invalid="ignore", divide="ignore"):
                total = np.where(short, total / weight, total)
        return total, np.ones(lines.n, bool)

    def run(cells: dict, lines: Lines) -> None:
        full = lines.plane(cells[v])
        if full and min(lines.shape) > radius:
            cells[v] = lines.flat(mirrored_sum(mirrored_sum(full[0], weights, 1), weights, 0))
        else:
            cells[v] = line(line(cells[v], lines, "x"), lines, "y")

    run.reach = radius
    return run


def equalize(v: str, clip: float, tiles_y: int, tiles_x: int) -> Step:
    """`neighborhood.tile_equalize` of a grid that is one group."""

    def run(cells: dict, lines: Lines) -> None:
        y, x, (value, known) = lines.y.astype(np.int64), lines.x.astype(np.int64), cells[v]
        th, tw = -(-(int(y.max()) + 1) // tiles_y), -(-(int(x.max()) + 1) // tiles_x)
        level = np.clip(np.floor(np.where(known & ~np.isnan(value), value, 0.0)), 0, 255).astype(np.int64)
        ty, tx = y // th, x // tw
        ny, nx = int(ty.max()) + 1, int(tx.max()) + 1
        hist = np.bincount((ty * nx + tx) * 256 + level, minlength=ny * nx * 256).reshape(ny * nx, 256)
        area = hist.sum(axis=1)
        limit = np.maximum(1, np.floor(clip * area / 256)).astype(np.int64)
        curve = clipped_curves(hist, limit, np.maximum(area, 1)).reshape(ny, nx, 256)
        have = (area > 0).reshape(ny, nx)
        fy, fx = y / th - 0.5, x / tw - 0.5
        qy, qx = np.floor(fy).astype(np.int64) + 1, np.floor(fx).astype(np.int64) + 1
        wy, wx = fy - np.floor(fy), fx - np.floor(fx)
        rows, columns = [np.maximum(qy - 1, 0), np.minimum(qy, ny - 1)], [np.maximum(qx - 1, 0), np.minimum(qx, nx - 1)]
        top, bottom = (curve[r, columns[0], level] * (1 - wx) + curve[r, columns[1], level] * wx for r in rows)
        ok = np.logical_and.reduce([have[r, c] for r in rows for c in columns])
        cells[v] = top * (1 - wy) + bottom * wy, ok

    run.reach = 0
    return run


def clipped_curves(h: np.ndarray, top: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Clipped and cumulated 256-bin histograms, one row each of `n` cells, scaled to 0-255."""
    kept = np.minimum(h, top[:, None])
    share, rest = np.divmod(h.sum(axis=1) - kept.sum(axis=1), 256)
    # the excess is spread evenly; the remainder goes one count each to regularly spaced bins
    every, bins = 256 // np.maximum(1, rest), np.arange(256)
    kept = kept + share[:, None] + ((bins % every[:, None] == 0) & (bins // every[:, None] < rest[:, None]))
    return np.cumsum(kept, axis=1) * 255.0 / n[:, None]


def clipped_curve(h: np.ndarray, top: int, n: int) -> np.ndarray:
    """`clipped_curves` of a single histogram."""
    return clipped_curves(np.asarray(h)[None], np.array([top]), np.array([n]))[0]


def slopes(v: str) -> Step:
    """3x3 derivatives gx, gy."""

    def run(cells: dict, lines: Lines) -> None:
        own = cells[v]
        full = lines.plane(own)
        if full:
            a = full[0]
            left, right = beyond(a, 1, -1), beyond(a, 1, 1)
            d, s = right - left, left + 2 * a + right
            cells["gx"] = lines.flat(beyond(d, 0, -1) + 2 * d + beyond(d, 0, 1))
            cells["gy"] = lines.flat(beyond(s, 0, 1) - beyond(s, 0, -1))
            return
        left, right = lines.step(own, "x", -1), lines.step(own, "x", 1)
        ok = left[1] & right[1]
        d, s = (right[0] - left[0], ok), (left[0] + 2 * own[0] + right[0], ok & own[1])
        up, down = lines.step(d, "y", -1), lines.step(d, "y", 1)
        cells["gx"] = up[0] + 2 * d[0] + down[0], up[1] & d[1] & down[1]
        up, down = lines.step(s, "y", -1), lines.step(s, "y", 1)
        cells["gy"] = down[0] - up[0], up[1] & down[1]

    run.reach = 1
    return run


def magnitude(log: bool = False) -> Step:
    def run(cells: dict, lines: Lines) -> None:
        mag = np.hypot(cells["gx"][0], cells["gy"][0])
        cells["mag"] = np.log1p(mag) if log else mag, cells["gx"][1] & cells["gy"][1]

    run.reach = 0
    return run


def ridges() -> Step:
    """`is_ridge`: no neighbour along the gradient is stronger."""

    def run(cells: dict, lines: Lines) -> None:
        def known(c: Cells) -> np.ndarray:
            return np.where(c[1], c[0], 0.0)

        (gx, _), (gy, _), mag = cells["gx"], cells["gy"], cells["mag"]
        full = lines.plane(mag)
        if full:
            side = {"l": beyond(full[0], 1, -1, False), "c": full[0], "r": beyond(full[0], 1, 1, False)}
            around = {n + s: beyond(a, 0, k, False).reshape(-1) for n, a in side.items() for s, k in (("u", -1), ("d", 1))}
            ax, ay = np.abs(gx), np.abs(gy)
            which = [ay < ax * 0.41421356237, ay > ax * 2.41421356237, gx * gy > 0]
            before = np.select(which, [side["l"].reshape(-1), around["cu"], around["lu"]], around["ru"])
            after = np.select(which, [side["r"].reshape(-1), around["cd"], around["rd"]], around["ld"])
            cells["is_ridge"] = (mag[0] > before) & (mag[0] >= after), mag[1]
            return
        left, right = lines.take(mag, "x", -1), lines.take(mag, "x", 1)
        around = {n + s: known(lines.take(c, "y", k)) for c, n in ((left, "l"), (mag, "c"), (right, "r")) for s, k in (("u", -1), ("d", 1))}
        ax, ay = np.abs(gx), np.abs(gy)
        # Tangents of 22.5 and 67.5 degrees, the borders of the four directions.
        which = [ay < ax * 0.41421356237, ay > ax * 2.41421356237, gx * gy > 0]
        before = np.select(which, [known(left), around["cu"], around["lu"]], around["ru"])
        after = np.select(which, [known(right), around["cd"], around["rd"]], around["ld"])
        cells["is_ridge"] = (mag[0] > before) & (mag[0] >= after), mag[1]

    run.reach = 1
    return run


def beside(of: list[str], steps: Callable[[str], list[Step]], names: list[str]) -> Step:
    """The same steps for each of several columns; what they make under `names` is called `<column>_<name>`."""
    chains = {v: steps(v) for v in of}

    def run(cells: dict, lines: Lines) -> None:
        for v, chain in chains.items():
            own = {v: cells[v]}
            for step in chain:
                step(own, lines)
            cells.update({f"{v}_{c}": own[c] for c in names})

    run.reach = max(sum(step.reach for step in chain) for chain in chains.values())
    return run


def highpass(v: str, weights: list[float]) -> Step:
    """What remains above a blur; 0 where the value is not known."""
    blur = smooth(v, weights)

    def run(cells: dict, lines: Lines) -> None:
        value, known = cells[v]
        blur(cells, lines)
        cells[v] = np.where(known, np.maximum(0.0, value - cells[v][0]), 0.0), np.ones(lines.n, bool)

    run.reach = blur.reach
    return run


def copies() -> Step:
    """`copies`: how many rows of the grid lie at a cell's place."""

    def run(cells: dict, lines: Lines) -> None:
        if lines.shape is not None:
            cells["copies"] = np.ones(lines.n, np.int64), np.ones(lines.n, bool)
            return
        order, line = lines.sorted["x"]
        along = lines.x[order]
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (along[1:] != along[:-1])])
        n = np.diff(np.append(np.flatnonzero(new), lines.n))
        out = np.empty(lines.n, np.int64)
        out[order] = np.repeat(n, n)
        cells["copies"] = out, np.ones(lines.n, bool)

    run.reach = 0
    return run


def _places(axis: str, reach: int, up: int):
    """The tiles that need a cell: its own, and those whose border it is part of. A grid starts at 0.

    Only plain arrays, no lambda: that would take the whole step out of the generated code. A cell without a place has none.
    """
    own, at = F.floor(F.col(axis) / TILE).cast("int"), F.pmod(F.col(axis), F.lit(TILE))
    lower, upper = (at < reach) & (own != 0), at >= TILE - up
    return F.explode(
        F.when(~lower & ~upper, F.array(own)).when(lower & upper, F.array(own, own - 1, own + 1)).when(lower, F.array(own, own - 1)).when(upper, F.array(own, own + 1))
    )


def tiled(grid: DataFrame, reach: int, up: int | None = None) -> DataFrame:
    """Cells with the tiles _ty, _tx that need them: `reach` cells behind a tile and `up` before it."""
    up = reach if up is None else up
    return grid.withColumn("_ty", _places("y", reach, up)).withColumn("_tx", _places("x", reach, up))


def column(table: pa.Table, name: str) -> Cells:
    c = table[name].cast(pa.float64())
    return c.to_numpy(), np.asarray(pc.is_valid(table[name]))


def stencil(grid: DataFrame, steps: list[Step], reads: list[str], writes: dict[str, T.DataType], keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all) of the grid with `writes` set by the steps, which start from the columns `reads`."""
    keep = [c for c in (grid.columns if keep is None else keep) if c not in writes]
    grid = grid.select(*dict.fromkeys([*keep, *reads, *keys, "y", "x"]))
    schema = T.StructType([*[grid.schema[c] for c in keep], *[T.StructField(c, t) for c, t in writes.items()]])
    arrow = {T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
    types = {c: arrow[t] for c, t in writes.items()}

    kept = [c for c in keep if c not in (*keys, "y", "x")]
    if packs.packable(grid, [*kept, *reads]):
        moved = list(dict.fromkeys([*kept, *reads]))
        whole = {c: pa.int64() if isinstance(grid.schema[c].dataType, T.LongType) else packs.KINDS[grid.schema[c].dataType][0] for c in "yx"}
        kinds = {c: packs.KINDS[grid.schema[c].dataType][0] for c in kept}

        def run_packed(key: pa.Table, y: np.ndarray, x: np.ndarray, had: dict) -> pa.Table:
            lines, cells = Lines(y, x), {c: (had[c][0].astype(np.float64), had[c][1]) for c in reads}
            for step in steps:
                step(cells, lines)
            own = (y // TILE == key["_ty"][0].as_py()) & (x // TILE == key["_tx"][0].as_py())
            own = slice(None) if own.all() else own
            y, x = y[own], x[own]
            out = packs.repeated(key, [k for k in keys if k in keep], len(y))
            out |= {c: pa.array(a).cast(whole[c]) for c, a in (("y", y), ("x", x)) if c in keep}
            out |= {c: _arrow(had[c], own, kinds[c]) for c in kept} | {c: _arrow(cells[c], own, t) for c, t in types.items()}
            return pa.table({c: out[c] for c in (*keep, *types)})

        return packs.per_grid(grid, keys, moved, run_packed, schema, tile=TILE, reach=sum(s.reach for s in steps))

    def run(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy(), table["x"].to_numpy()
        lines, cells = Lines(y, x), {c: column(table, c) for c in reads}
        for step in steps:
            step(cells, lines)
        own = (y // TILE == table["_ty"][0].as_py()) & (x // TILE == table["_tx"][0].as_py())
        out = {c: table[c] for c in keep}
        out |= {c: pa.array(cells[c][0], mask=~cells[c][1]).cast(t) for c, t in types.items()}
        made = pa.table(out)
        return made if own.all() else made.filter(pa.array(own))

    return tiled(grid, sum(s.reach for s in steps)).groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)


def _arrow(cells: Cells, own, kind: pa.DataType) -> pa.Array:
    value, known = cells[0][own], cells[1][own]
    return (pa.array(value) if known.all() else pa.array(value, mask=~known)).cast(kind)


def bilinear(lines: Lines, values: list[Cells], px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, list[Cells]]:
    """The points that have all four neighbours, once for each cell at their place, and the values there."""
    fx, fy = np.floor(px), np.floor(py)
    if lines.plane(*values):
        (h, w), y0, x0 = lines.shape, int(lines.y[0]), int(lines.x[0])
        point = np.flatnonzero((fx >= x0) & (fx < x0 + w - 1) & (fy >= y0) & (fy < y0 + h - 1))
        cell = (fy[point] - y0).astype(np.int64) * w + (fx[point] - x0).astype(np.int64)
        dx, dy = px[point] - fx[point], py[point] - fy[point]
        known = np.ones(len(point), bool)
        return point, [((v[cell] * (1 - dx) + v[cell + 1] * dx) * (1 - dy) + (v[cell + w] * (1 - dx) + v[cell + w + 1] * dx) * dy, known) for v, _ in values]
    y, x = lines.y, lines.x
    order = lines.sorted["x"][0]
    low = int(x.min()) if len(x) else 0
    wide = (int(x.max()) if len(x) else 0) - low + 1
    code = (y[order].astype(np.int64)) * wide + x[order] - low
    inside = (fx >= low) & (fx < low + wide)
    want = np.where(inside, fy * wide + fx - low, -1e15).astype(np.int64)
    first, last = np.searchsorted(code, want), np.searchsorted(code, want, "right")
    hits = last - first
    point = np.repeat(np.arange(len(px)), hits)
    cell = order[first[point] + np.arange(len(point)) - (np.cumsum(hits) - hits)[point]]
    out, kept = [], None
    for own in values:
        right, lower = lines.take(own, "x", 1), lines.take(own, "y", 1)
        corner = lines.take(right, "y", 1)
        if kept is None:
            kept = corner[1][cell]
            point, cell = point[kept], cell[kept]
            dx, dy = px[point] - fx[point], py[point] - fy[point]
        v01, v10 = (np.where(c[1], c[0], own[0])[cell] for c in (right, lower))
        v11 = np.where(corner[1], corner[0], np.where(right[1], right[0], np.where(lower[1], lower[0], own[0])))[cell]
        out.append(((own[0][cell] * (1 - dx) + v01 * dx) * (1 - dy) + (v10 * (1 - dx) + v11 * dx) * dy, own[1][cell]))
    return point, out


def sample(grid: DataFrame, points: DataFrame, keys: list[str], vals: list[str]) -> DataFrame:
    """Value at real-valued (px, py) points; points without all four neighbours are dropped."""
    cells = tiled(grid.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(v) for v in vals]), 1, 0)
    at = {f"_t{c}": F.floor(F.col(f"p{c}") / TILE).cast("int") for c in "yx"}
    schema = T.StructType([*points.schema.fields, *[T.StructField(v, T.DoubleType()) for v in vals]])
    names = points.columns

    def run(p: pa.Table, g: pa.Table) -> pa.Table:
        px, py = (p[c].cast(pa.float64()).to_numpy() for c in ("px", "py"))
        point, made = bilinear(Lines(g["y"].to_numpy(), g["x"].to_numpy()), [column(g, v) for v in vals], px, py)
        out = {v: pa.array(value, mask=~known) for v, (value, known) in zip(vals, made)}
        return pa.table({c: p[c].take(pa.array(point)) for c in names} | out)

    by = [*keys, "_ty", "_tx"]
    return points.withColumns(at).groupBy(*by).cogroup(cells.groupBy(*by)).applyInArrow(run, schema)
