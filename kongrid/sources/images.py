"""Image files as grids: reading, ingest guards, unpacking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.schemas import ALPHA_BACKGROUND, MAX_BYTES, MAX_CELLS

UNPACKED = "grid_id string, y int, x int, c0 int, c1 int, c2 int, c3 int, n_channels int"


def _key(path: Column) -> Column:
    """Files are named in URI form; the scheme of local ones is left out."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_images(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Decoded pixels with file size and time, from one scan. Undecodable files stay, with height -1.

    Files over `max_bytes` are left out of that scan by their size and listed without being read.
    """
    meta = F.col("_metadata")
    facts = [meta["file_path"].alias("path"), meta["file_size"].alias("length"), meta["file_modification_time"].alias("modificationTime")]
    img = spark.read.format("image").option("dropInvalid", False).load(path).where(meta["file_size"] <= max_bytes)
    img = img.select(*facts, "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.mode", "image.data")
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > max_bytes).select("path", "length", "modificationTime")
    every = img.unionByName(large, allowMissingColumns=True)
    return every.select(_key(F.col("path")).alias("grid_id"), "path", "length", "modificationTime", "height", "width", "n_channels", "mode", "data")


def image_size(content: bytes | None) -> tuple[int, int]:
    """(height, width) stated in the header of a PNG, GIF, BMP or JPEG file; (-1, -1) for anything else."""
    c = content or b""
    if c.startswith(b"\x89PNG\r\n\x1a\n") and len(c) >= 24:
        return int.from_bytes(c[20:24], "big"), int.from_bytes(c[16:20], "big")
    if c[:6] in (b"GIF87a", b"GIF89a") and len(c) >= 10:
        return int.from_bytes(c[8:10], "little"), int.from_bytes(c[6:8], "little")
    if c.startswith(b"BM") and len(c) >= 26:
        return abs(int.from_bytes(c[22:26], "little", signed=True)), int.from_bytes(c[18:22], "little", signed=True)
    at = 2 if c.startswith(b"\xff\xd8") else len(c)
    while at + 9 <= len(c) and c[at] == 0xFF:
        kind = c[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # start of frame
            return int.from_bytes(c[at + 5 : at + 7], "big"), int.from_bytes(c[at + 7 : at + 9], "big")
        # fill bytes and markers without a length
        at += 1 if kind == 0xFF else 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(c[at + 2 : at + 4], "big")
    return -1, -1


def validate_ingest(
    df: DataFrame, length: str = "length", height: str = "height", width: str = "width",
    max_bytes: int = MAX_BYTES, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """First failing rule wins: too many bytes 413, undecodable 400, too many cells 413, else 200."""
    h, w = F.col(height), F.col(width)
    broken = h.isNull() | w.isNull() | (h <= 0) | (w <= 0)
    large = h.cast("long") * w.cast("long") > max_cells
    too_long = F.coalesce(F.col(length) > max_bytes, F.lit(False))
    status = F.when(too_long, 413).when(broken, 400).when(large, 413).otherwise(200)
    reason = F.when(too_long, "too many bytes").when(broken, "undecodable").when(large, "too many cells").otherwise("ok")
    return df.withColumns({"status": status, "reason": reason})


def split_ingest(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rows for quarantine."""
    return checked.where("status = 200"), checked.where("status <> 200")


# Cells of one output batch of `_unpack`, about.
BAND = 65536


def _unpack(batches):
    """Raw image bytes to one row per cell: bands of lines of large images, many small images together in one output batch."""

    def joined(held: list) -> pa.RecordBatch:
        ids, ys, xs, channels, counts = zip(*held)
        sizes = [len(y) for y in ys]
        flat = np.concatenate(channels)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.string()).take(pa.array(np.repeat(np.arange(len(ids)), sizes))),
                pa.array(np.concatenate(ys)), pa.array(np.concatenate(xs)),
                *[pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)],
                pa.array(np.repeat(np.array(counts, dtype=np.int32), sizes)),
            ],
            names=["grid_id", "y", "x", "c0", "c1", "c2", "c3", "n_channels"],
        )

    for batch in batches:
        data = batch.column("data")
        held, cells = [], 0
        for i, (gid, h, w, c) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("grid_id", "height", "width", "n_channels")])):
            px = np.frombuffer(data[i].as_buffer(), dtype=np.uint8)[: h * w * c].reshape(h, w, c)
            band = max(1, BAND // w)
            for y0 in range(0, h, band):
                part = px[y0 : y0 + band]
                n = part.shape[0] * w
                flat = part.reshape(n, c)[:, [min(k, c - 1) for k in range(4)]].astype(np.int32)
                y = np.repeat(np.arange(y0, y0 + part.shape[0], dtype=np.int32), w)
                held.append((gid, y, np.tile(np.arange(w, dtype=np.int32), part.shape[0]), flat, c))
                cells += n
                if cells >= BAND:
                    yield joined(held)
                    held, cells = [], 0
        if held:
            yield joined(held)


def to_grid(images: DataFrame, background: float = ALPHA_BACKGROUND) -> DataFrame:
    """Colour grid (grid_id, y, x, b, g, r): grey is replicated, alpha is laid over a neutral background."""
    raw = images.select(F.col("grid_id").cast("string").alias("grid_id"), "height", "width", "n_channels", "data")
    cells = raw.mapInArrow(_unpack, UNPACKED)
    alpha = F.col("c3") / 255.0

    def channel(i: int) -> Column:
        c = F.col(f"c{i}").cast("double")
        over = F.floor(c * alpha + F.lit(float(background)) * (1.0 - alpha)).cast("double")
        return F.when(F.col("n_channels") == 4, over).when(F.col("n_channels") == 1, F.col("c0").cast("double")).otherwise(c)

    return cells.select("grid_id", "y", "x", channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))
