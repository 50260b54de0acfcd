"""What an export contains, as a manifest table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File names and labels.
FILES = {"png": "comparison-overlay.png", "gif": "comparison.gif", "mp4": "comparison.mp4"}
REFERENCE_LABEL = "REFERENCE"
MATCHED_LABEL = "CANDIDATE · MATCHED"
RAW_LABEL = "CANDIDATE · RAW"


def export_overview(requests: DataFrame) -> DataFrame:
    """One row per frame: png holds the overlay, gif two timed frames, mp4 two rounds at a whole fps."""
    cand = F.when(F.col("appearance_match"), MATCHED_LABEL).otherwise(RAW_LABEL)

    def frame(view, label):
        return F.struct(F.lit(view).alias("view"), label.alias("label"))

    pair = F.array(frame("reference", F.lit(REFERENCE_LABEL)), frame("aligned", cand))
    frames = (
        F.when(F.col("format") == "png", F.array(frame("overlay", F.lit(None).cast("string"))))
        .when(F.col("format") == "gif", pair)
        .when(F.col("format") == "mp4", F.concat(pair, pair))
    )
    names = F.create_map(*[F.lit(x) for kv in FILES.items() for x in kv])
    fps = F.greatest(F.lit(1), F.bround(1000 / F.col("frame_ms")).cast("int"))
    out = requests.select("*", F.posexplode(frames).alias("frame", "_f"))
    return out.select(
        *requests.columns, "frame", "_f.view", "_f.label", F.try_element_at(names, F.col("format")).alias("file_name"),
        F.when(F.col("format") == "gif", F.col("frame_ms")).alias("duration_ms"),
        F.when(F.col("format") == "mp4", fps).alias("fps"),
    )
