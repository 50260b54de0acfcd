"""Coordinate and transform arithmetic as Column expressions (nothing here shuffles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kongrid import schemas as S

CELLS = [(i, j) for i in range(3) for j in range(3)]


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def dbl(v) -> Column:
    return lit(v).cast("double")


# ---------------------------------------------------------------- angles


def radius(x, y, cx, cy) -> Column:
    return F.hypot(dbl(x) - dbl(cx), dbl(y) - dbl(cy))


def angle(x, y, cx, cy) -> Column:
    """Degrees clockwise from twelve o'clock, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dbl(x) - dbl(cx), dbl(cy) - dbl(y))), F.lit(360.0))


def polar(x, y, cx, cy) -> tuple[Column, Column]:
    return radius(x, y, cx, cy), angle(x, y, cx, cy)


def wrap180(a) -> Column:
    return F.pmod(dbl(a) + 180.0, F.lit(360.0)) - 180.0


# ---------------------------------------------------------------- matrices


def matrix(*rows) -> Column:
    """A 3x3 struct from nine values in row-major order."""
    return F.struct(*[dbl(v).alias(f"m{i}{j}") for (i, j), v in zip(CELLS, rows, strict=True)])


def at(m: Column, i: int, j: int) -> Column:
    return m.getField(f"m{i}{j}")


def identity() -> Column:
    return matrix(1, 0, 0, 0, 1, 0, 0, 0, 1)


def translate(dx, dy) -> Column:
    return matrix(1, 0, dx, 0, 1, dy, 0, 0, 1)


def rotate_scale_about(cx, cy, degrees, scale, dx=0.0, dy=0.0) -> Column:
    """Rotation by `degrees` (counter-clockwise on screen) and scale about a point, then a shift."""
    a = dbl(scale) * F.cos(F.radians(dbl(degrees)))
    b = dbl(scale) * F.sin(F.radians(dbl(degrees)))
    cx, cy = dbl(cx), dbl(cy)
    return matrix(a, b, cx - a * cx - b * cy + dbl(dx), -b, a, cy + b * cx - a * cy + dbl(dy), 0, 0, 1)


def adjustment(width, height, rotation, scale, x, y) -> Column:
    return rotate_scale_about(dbl(width) / 2, dbl(height) / 2, rotation, scale, x, y)


def compose(after: Column, before: Column) -> Column:
    return matrix(*[
        sum((at(after, i, k) * at(before, k, j) for k in range(1, 3)), at(after, i, 0) * at(before, 0, j))
        for i, j in CELLS
    ])


def invert(m: Column) -> Column:
    """Inverse through cofactors; NULL when singular."""

    def cofactor(i, j):
        r = [k for k in range(3) if k != i]
        c = [k for k in range(3) if k != j]
        minor = at(m, r[0], c[0]) * at(m, r[1], c[1]) - at(m, r[0], c[1]) * at(m, r[1], c[0])
        return minor if (i + j) % 2 == 0 else -minor

    det = sum((at(m, 0, k) * cofactor(0, k) for k in range(1, 3)), at(m, 0, 0) * cofactor(0, 0))
    return F.when(F.abs(det) > 1e-300, matrix(*[cofactor(j, i) / det for i, j in CELLS]))


def similarity_from_anchors(ref: Column, cand: Column, degrees) -> Column:
    """Map the candidate anchor onto the reference anchor: centre to centre, radius to radius."""
    scale = ref["r"] / F.greatest(F.lit(1e-6), cand["r"])
    return rotate_scale_about(
        cand["cx"], cand["cy"], degrees, scale, ref["cx"] - cand["cx"], ref["cy"] - cand["cy"]
    )


def ellipse_to_circle(ellipse: Column, cx, cy, r) -> Column:
    """Affine map that squeezes an ellipse along its own axes into a circle of radius r at (cx, cy)."""
    t = F.radians(ellipse["angle"])
    c, s = F.cos(t), F.sin(t)
    kx = dbl(r) / F.greatest(F.lit(1.0), ellipse["semi_major"])
    ky = dbl(r) / F.greatest(F.lit(1.0), ellipse["semi_minor"])
    a, b, d = kx * c * c + ky * s * s, (kx - ky) * c * s, kx * s * s + ky * c * c
    ex, ey = ellipse["cx"], ellipse["cy"]
    return matrix(a, b, dbl(cx) - a * ex - b * ey, b, d, dbl(cy) - b * ex - d * ey, 0, 0, 1)


def decompose(m: Column) -> Column:
    """Rotation, ordered singular values and their ratio for the 2x2 linear part."""
    a, b, c, d = at(m, 0, 0), at(m, 0, 1), at(m, 1, 0), at(m, 1, 1)
    even = F.hypot((a + d) / 2, (c - b) / 2)
    odd = F.hypot((a - d) / 2, (c + b) / 2)
    sx, sy = even + odd, F.abs(even - odd)
    return F.struct(
        F.degrees(F.atan2(c - b, a + d)).alias("rotation"),
        sx.alias("sx"),
        sy.alias("sy"),
        (sx / F.greatest(F.lit(1e-6), sy)).alias("anisotropy"),
    )


def scale_of(m: Column) -> Column:
    return F.hypot(at(m, 0, 0), at(m, 0, 1))


def rotation_of(m: Column) -> Column:
    """Degrees in the sense of `rotate_scale_about`."""
    return F.degrees(F.atan2(at(m, 0, 1), at(m, 0, 0)))


def apply_transform(x, y, m: Column) -> tuple[Column, Column]:
    x, y = dbl(x), dbl(y)
    w = at(m, 2, 0) * x + at(m, 2, 1) * y + at(m, 2, 2)
    return (
        (at(m, 0, 0) * x + at(m, 0, 1) * y + at(m, 0, 2)) / w,
        (at(m, 1, 0) * x + at(m, 1, 1) * y + at(m, 1, 2)) / w,
    )


def corner_report(m: Column, width, height) -> Column:
    """How far a near-identity projective map moves the frame: corners, keystone size, mean scale."""
    moves = []
    for x, y in [(0.0, 0.0), (width, 0.0), (width, height), (0.0, height)]:
        px, py = apply_transform(x, y, m)
        moves += [F.abs(px - dbl(x)), F.abs(py - dbl(y))]
    parts = decompose(m)
    return F.struct(
        F.greatest(*moves).alias("max_displacement"),
        (F.hypot(at(m, 2, 0), at(m, 2, 1)) * F.greatest(dbl(width), dbl(height))).alias("perspective"),
        F.abs((parts["sx"] + parts["sy"]) / 2 - 1.0).alias("scale_deviation"),
    )


def max_corner_displacement(m: Column, width, height) -> Column:
    return corner_report(m, width, height)["max_displacement"]


# ---------------------------------------------------------------- anchors and canvas


def parse_anchor(arr: Column) -> Column:
    """(cx, cy, r) from a three-element array, NULL unless all are numbers and r > 5."""
    num = F.transform(arr, lambda v: v.cast("string").try_cast("double"))
    ok = (F.size(arr) == 3) & F.forall(num, lambda v: v.isNotNull()) & (F.get(num, F.lit(2)) > 5)
    return F.when(ok, anchor(F.get(num, F.lit(0)), F.get(num, F.lit(1)), F.get(num, F.lit(2))))


def anchor(cx, cy, r) -> Column:
    return F.struct(dbl(cx).alias("cx"), dbl(cy).alias("cy"), dbl(r).alias("r"))


def default_anchor(width, height) -> Column:
    return anchor(dbl(width) / 2, dbl(height) / 2, F.least(dbl(width), dbl(height)) * 0.30)


def canvas(ref: Column, cand_r=None, minimum: int = S.CANVAS_MIN, maximum: int = S.CANVAS_MAX) -> Column:
    """Common square canvas for a pair: size, target radius, render scale and centring matrix."""
    sharper = F.greatest(ref["r"], F.coalesce(dbl(cand_r), F.lit(0.0)))
    wanted = F.bround(sharper * S.CANVAS_MARGIN * 2.0).cast("int")
    size = F.greatest(F.lit(minimum), F.least(F.lit(maximum), wanted))
    size = size + size % 2
    target = size / (S.CANVAS_MARGIN * 2.0)
    scale = target / F.greatest(F.lit(1e-6), ref["r"])
    return F.struct(
        size.cast("int").alias("size"),
        target.alias("target_r"),
        scale.alias("render_scale"),
        matrix(scale, 0, size / 2 - scale * ref["cx"], 0, scale, size / 2 - scale * ref["cy"], 0, 0, 1).alias("m"),
    )
