"""Region predicates. Masks are never stored: each is a boolean Column over coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.functions.geometry import dbl, radius, wrap180


def in_ellipse(x, y, cx, cy, ax, ay) -> Column:
    return F.pow((dbl(x) - dbl(cx)) / dbl(ax), 2) + F.pow((dbl(y) - dbl(cy)) / dbl(ay), 2) <= 1.0


def center_ellipse(x, y, width, height) -> Column:
    def half(side):
        return F.greatest(F.lit(20), F.floor(dbl(side) * 0.46).cast("int"))

    return in_ellipse(x, y, F.floor(dbl(width) / 2), F.floor(dbl(height) / 2), half(width), half(height))


def in_circle(x, y, cx, cy, r) -> Column:
    return radius(x, y, cx, cy) <= dbl(r)


def central_disc(x, y, width, height) -> Column:
    r = F.greatest(F.lit(20), F.floor(F.least(dbl(width), dbl(height)) * 0.36).cast("int"))
    return in_circle(x, y, F.floor(dbl(width) / 2), F.floor(dbl(height) / 2), r)


def in_annulus(x, y, anchor: Column, inner: float, outer: float, strict: bool = True) -> Column:
    """Band between `inner` and `outer` multiples of the anchor radius."""
    d = radius(x, y, anchor["cx"], anchor["cy"])
    lo, hi = anchor["r"] * inner, anchor["r"] * outer
    return ((d > lo) & (d < hi)) if strict else ((d >= lo) & (d <= hi))


def in_sector(angle, target, half_width=11.0) -> Column:
    return F.abs(wrap180(dbl(angle) - dbl(target))) < dbl(half_width)


def suppressed(angle) -> Column:
    """Lower and right sectors that crystal sizing ignores."""
    a = dbl(angle)
    return ((a > 135) & (a < 225)) | ((a > 70) & (a < 110))


def nearest_sector(angle, step: int = 30) -> Column:
    """Centre of the sector an angle falls in. Sectors are disjoint, so one cell has one sector."""
    return (F.pmod(F.floor(dbl(angle) / step + 0.5), F.lit(360 // step)) * step).cast("int")


def roi_crop(grid: DataFrame, x0, y0, x1, y1) -> DataFrame:
    """Half-open box with coordinates shifted to its origin; the origin is kept as (x0, y0)."""
    x0, y0 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return (
        grid.where(inside)
        .withColumns({"x0": x0.cast("int"), "y0": y0.cast("int")})
        .withColumns({"x": (F.col("x") - F.col("x0")).cast("int"), "y": (F.col("y") - F.col("y0")).cast("int")})
    )


def anchor_box(anchor: Column, margin: float = 1.65) -> dict[str, Column]:
    half = F.floor(F.greatest(anchor["r"] * margin, anchor["r"] * 1.45))
    return {
        "x0": F.bround(anchor["cx"] - half).cast("int"), "y0": F.bround(anchor["cy"] - half).cast("int"),
        "x1": F.bround(anchor["cx"] + half).cast("int"), "y1": F.bround(anchor["cy"] + half).cast("int"),
    }


def text_box(anchor: Column) -> dict[str, Column]:
    cx, cy, r = anchor["cx"], anchor["cy"], anchor["r"]
    return {
        "x0": F.bround(cx - r * 0.45).cast("int"), "y0": F.bround(cy - r * 0.43).cast("int"),
        "x1": F.bround(cx + r * 0.45).cast("int"), "y1": F.bround(cy - r * 0.05).cast("int"),
    }


def text_box_ok(box: dict[str, Column], min_width: int = 80, min_height: int = 45) -> Column:
    return (box["x1"] - box["x0"] >= min_width) & (box["y1"] - box["y0"] >= min_height)
