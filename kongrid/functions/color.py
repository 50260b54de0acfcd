"""Value and colour arithmetic as Column expressions on the 0-255 scale, unrounded DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.functions.geometry import dbl

# Luma weights, sRGB primaries (D65 white) and the CIE L*a*b* constants.
LUMA = {"b": 0.114, "g": 0.587, "r": 0.299}
SRGB_TO_XYZ = [
    [0.412453, 0.357580, 0.180423],
    [0.212671, 0.715160, 0.072169],
    [0.019334, 0.119193, 0.950227],
]
XYZ_TO_SRGB = [
    [3.240479, -1.537150, -0.498535],
    [-0.969256, 1.875991, 0.041556],
    [0.055648, -0.204043, 1.057311],
]
WHITE = [0.950456, 1.0, 1.088754]
LAB_EPSILON = 0.008856
LAB_SLOPE = 7.787
LAB_KAPPA = 903.3


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def luma(b, g, r) -> Column:
    return LUMA["b"] * dbl(b) + LUMA["g"] * dbl(g) + LUMA["r"] * dbl(r)


def _dot(row, parts):
    return row[0] * parts[0] + row[1] * parts[1] + row[2] * parts[2]


def bgr_to_lab(b, g, r) -> Column:
    """CIE L*a*b* scaled to 8-bit ranges: L*255/100, a+128, b+128."""

    def linear(c):
        c = dbl(c) / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def f(t):
        return F.when(t > LAB_EPSILON, F.cbrt(t)).otherwise(LAB_SLOPE * t + 16.0 / 116.0)

    rgb = [linear(r), linear(g), linear(b)]
    xyz = [_dot(row, rgb) / white for row, white in zip(SRGB_TO_XYZ, WHITE, strict=True)]
    fx, fy, fz = (f(t) for t in xyz)
    ell = F.when(xyz[1] > LAB_EPSILON, 116.0 * fy - 16.0).otherwise(LAB_KAPPA * xyz[1])
    return F.struct(
        (ell * 255.0 / 100.0).alias("l"),
        (500.0 * (fx - fy) + 128.0).alias("a"),
        (200.0 * (fy - fz) + 128.0).alias("b"),
    )


def lab_to_bgr(l, a, b) -> Column:  # noqa: E741
    ell = dbl(l) * 100.0 / 255.0
    fy = (ell + 16.0) / 116.0
    y = F.when(ell > LAB_KAPPA * LAB_EPSILON, fy * fy * fy).otherwise(ell / LAB_KAPPA)
    fy = F.when(y > LAB_EPSILON, fy).otherwise(LAB_SLOPE * y + 16.0 / 116.0)

    def g(t):
        cube = t * t * t
        return F.when(cube > LAB_EPSILON, cube).otherwise((t - 16.0 / 116.0) / LAB_SLOPE)

    xyz = [g(fy + (dbl(a) - 128.0) / 500.0) * WHITE[0], y, g(fy - (dbl(b) - 128.0) / 200.0) * WHITE[2]]

    def gamma(c):
        s = F.when(c <= 0.0031308, 12.92 * c).otherwise(
            1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055
        )
        return clip(s * 255.0, 0, 255)

    red, green, blue = (gamma(_dot(row, xyz)) for row in XYZ_TO_SRGB)
    return F.struct(blue.alias("b"), green.alias("g"), red.alias("r"))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.pow(p["l"] - q["l"], 2) + F.pow(p["a"] - q["a"], 2) + F.pow(p["b"] - q["b"], 2))


def abs_diff(a, b) -> Column:
    return F.abs(dbl(a) - dbl(b))


def blend(a, b, weight) -> Column:
    return dbl(a) * (1.0 - dbl(weight)) + dbl(b) * dbl(weight)


def alpha_blend(src, dst, valid: Column, strength) -> Column:
    """Mix `dst` into `src` where the cell is valid, limited to 0-255."""
    alpha = F.when(valid, dbl(strength)).otherwise(F.lit(0.0))
    return clip(blend(src, dst, alpha), 0, 255)


def tone_map(v, s: Column, t: Column) -> Column:
    """Piecewise-linear curve through three points: `s`, `t` are structs (p10, p50, p90)."""
    lower = clip((t["p50"] - t["p10"]) / F.greatest(F.lit(8.0), s["p50"] - s["p10"]), 0.45, 2.20)
    upper = clip((t["p90"] - t["p50"]) / F.greatest(F.lit(8.0), s["p90"] - s["p50"]), 0.45, 2.20)
    v = dbl(v)
    return clip(t["p50"] + (v - s["p50"]) * F.when(v <= s["p50"], lower).otherwise(upper), 0, 255)


def spread_transfer(v, src: Column, ref: Column) -> Column:
    """Median and spread transfer: `src`, `ref` are structs (median, spread)."""
    gain = clip(ref["spread"] / src["spread"], 0.55, 1.80)
    return clip((dbl(v) - src["median"]) * gain + ref["median"], 0, 255)


def color_map(df: DataFrame, v: str, lut: DataFrame) -> DataFrame:
    """Palette colour of a 0-255 value. `lut` has `level` 0..255 (256 rows by definition) and b, g, r."""
    lut = lut.where(F.col("level").between(0, 255)).dropDuplicates(["level"])
    keyed = df.withColumn("level", clip(F.floor(F.col(v)).cast("double"), 0, 255).cast("int"))
    return keyed.join(F.broadcast(lut), "level", "left").drop("level")
