"""Parameter validation, plausibility gates and confidence labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kongrid.functions.color import clip
from kongrid.functions.geometry import dbl, wrap180

# Request defaults, bounds and formats.
DEFAULTS = {
    "rotation": 0.0, "scale": 1.0, "x": 0.0, "y": 0.0, "opacity": 0.5, "appearance_match": True,
    "match_strength": 0.85, "logo_lock": True, "perspective_correction": True, "frame_ms": 900,
}
BOUNDS = {
    "rotation": (-15.0, 15.0), "scale": (0.6, 1.4), "x": (-400.0, 400.0), "y": (-400.0, 400.0),
    "opacity": (0.0, 1.0), "match_strength": (0.0, 1.0), "frame_ms": (250, 3000),
}
FORMATS = ["gif", "mp4", "png"]

# Gate bounds. Each row is (column, comparison, bound); a column may be an expression.
GATES = {
    "refine": [
        ("score", ">=", 0.18), ("shift / min_side", "<=", 0.10), ("abs(rotation)", "<=", 2.0),
        ("scale", ">=", 0.97), ("scale", "<=", 1.03), ("anisotropy", "<=", 1.03),
    ],
    "text_lock": [("score", ">=", 0.34), ("shift - least(18.0D, greatest(10.0D, 0.105D * r))", "<=", 0.0)],
    "scale_lock": [
        ("score", ">=", 0.34), ("scale", ">", 0.705), ("scale", "<", 1.495), ("shift / min_side", "<=", 0.14),
    ],
    "homography": [
        ("score", ">=", 0.22), ("perspective / min_side", "<=", 0.10),
        ("max_displacement / min_side", "<=", 0.06), ("scale_deviation", "<=", 0.04),
    ],
    "post_circle_a": [
        ("scale", ">=", 0.96), ("scale", "<=", 1.04), ("anisotropy", "<=", 1.02), ("shift / min_side", "<=", 0.10),
    ],
    "post_circle_b": [
        ("scale", ">=", 0.94), ("scale", "<=", 1.06), ("anisotropy", "<=", 1.025), ("shift / min_side", "<=", 0.10),
    ],
    "ellipse": [
        ("semi_major / r", ">", 0.70), ("semi_major / r", "<", 1.30), ("semi_minor / r", ">=", 0.40),
        ("inlier_share", ">=", 0.65),
    ],
    "dewarp": [("axis_ratio", "<", 0.90), ("axis_ratio", ">=", 0.78)],
}
OUTSIDE = "correction outside safety bounds"

_COMPARE = {
    ">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b,
}


def gate(df: DataFrame, rules: str | list, reasons: dict[int, str] | str = OUTSIDE) -> DataFrame:
    """Accept a correction only when every bound holds. A NULL measurement fails its rule.

    Adds `applied` and `reason`; `reasons` may name the reason of a rule by its position.
    """
    rules = GATES[rules] if isinstance(rules, str) else rules
    failed = [~F.coalesce(_COMPARE[op](F.expr(c), F.lit(b)), F.lit(False)) for c, op, b in rules]
    named = reasons if isinstance(reasons, dict) else {}
    default = reasons if isinstance(reasons, str) else OUTSIDE
    reason = F.lit("applied")
    for i in reversed(range(len(failed))):
        reason = F.when(failed[i], named.get(i, default)).otherwise(reason)
    applied = F.lit(True)
    for bad in failed:
        applied = applied & ~bad
    return df.withColumns({"applied": applied, "reason": reason})


def with_defaults(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in requests.columns else F.lit(v) for c, v in DEFAULTS.items()
    })


def validate_params(requests: DataFrame, need_format: bool = True) -> DataFrame:
    """Fill defaults, then list every field that is out of bounds in `errors`."""
    df = with_defaults(requests)
    checks = [
        F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)) | F.isnan(F.col(c).cast("double")), F.lit(c))
        for c, (lo, hi) in BOUNDS.items()
    ]
    if need_format:
        checks.append(F.when(~F.coalesce(F.col("format").isin(FORMATS), F.lit(False)), F.lit("format")))
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def confidence_anchor(markers_ref, markers_cand, polar_corr, refine_score) -> Column:
    score = clip(
        0.40 * F.least(dbl(markers_ref), dbl(markers_cand)) / 12.0
        + 0.20 * clip(dbl(polar_corr) / 0.55, 0, 1)
        + 0.40 * clip(dbl(refine_score) / 0.55, 0, 1),
        0, 1,
    )
    return _labelled(score, 0.72, 0.48)


def confidence_match(inlier_ratio, inliers, median_error) -> Column:
    score = clip(
        0.65 * dbl(inlier_ratio)
        + 0.25 * F.least(dbl(inliers), F.lit(35.0)) / 35.0
        + 0.10 * F.greatest(F.lit(0.0), 1.0 - dbl(median_error) / 8.0),
        0, 1,
    )
    return _labelled(score, 0.68, 0.42)


def _labelled(score: Column, high: float, medium: float) -> Column:
    label = F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
    return F.struct(score.alias("score"), label.alias("label"))


def combine_rotation(marker, polar) -> Column:
    """Fuse two rotation estimates: blend when they agree within 2 degrees, else trust the markers."""
    m, p = dbl(marker), dbl(polar)
    fused = F.when(F.abs(wrap180(m - p)) <= 2.0, m * 0.70 + p * 0.30).otherwise(F.coalesce(m, p, F.lit(0.0)))
    return clip(fused, -15, 15)
