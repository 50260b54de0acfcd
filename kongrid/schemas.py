"""Schemas and fixed limits shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Limits, margins and defaults that decide results.
MAX_BYTES = 20 * 1024 * 1024
MAX_CELLS = 30_000_000
MAX_WORKING_SIDE = 2200
SESSION_TTL_SECONDS = 24 * 60 * 60
CANVAS_MARGIN = 1.72
CANVAS_MIN = 640
CANVAS_MAX = 1600
ALPHA_BACKGROUND = 24
FILL_CANDIDATE = 18.0
FILL_REFERENCE = 245.0

D, I, L, S, B = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


GRID = _struct(grid_id=S, y=I, x=I, v=D)
COLOR_GRID = _struct(grid_id=S, y=I, x=I, b=D, g=D, r=D)
ANCHORS = _struct(grid_id=S, cx=D, cy=D, r=D)
PROFILES = _struct(grid_id=S, bin=I, v=D)
PAIRS = _struct(pair_id=S, ref_id=S, cand_id=S)
DESCRIPTORS = _struct(grid_id=S, kp_id=L, x=D, y=D, desc=T.ArrayType(L))
MATCHES = _struct(pair_id=S, cand_kp=L, ref_kp=L, distance=I)
MATRIX = _struct(**{f"m{i}{j}": D for i in range(3) for j in range(3)})
TRANSFORMS = _struct(pair_id=S, m=MATRIX)
ELLIPSE = _struct(cx=D, cy=D, semi_major=D, semi_minor=D, angle=D)
REQUESTS = _struct(
    session_id=S, seq=L, rotation=D, scale=D, x=D, y=D, opacity=D, appearance_match=B,
    match_strength=D, logo_lock=B, perspective_correction=B, format=S, frame_ms=I,
)
METRICS = _struct(
    alignment_method=S, matches=L, inliers=L, inlier_ratio=D, median_error_px=D,
    detected_scale=D, detected_rotation_deg=D, initial_marker_rotation_deg=D,
    initial_polar_rotation_deg=D, polar_correlation=D, confidence=S, confidence_score=D,
    reference_circle=T.ArrayType(D), candidate_circle=T.ArrayType(D),
    refine_score=D, refine_applied=B, text_lock_score=D, text_lock_applied=B,
    perspective_dewarp_applied=B, perspective_axis_ratio=D, perspective_dewarp_reason=S,
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at plan time when a column an operator depends on is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
