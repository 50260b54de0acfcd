"""Whole-grid operators: canvas completion, reduction, pairing and cell-wise comparison."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kongrid.operators import packs
from kongrid.operators.cut import cut
from kongrid.operators.keys import multicast
from kongrid.schemas import MAX_WORKING_SIDE

# Side of the tiles in which cells of one place meet.
TILE = 512

# A grid never exceeds schemas.MAX_CELLS cells (validate_ingest), so plain joins on the grid key meet
# a bounded number of rows per key; AQE turns them into broadcast joins when the key side is small.


def values_of(grid: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in grid.columns if c not in (*keys, "y", "x")]


def dims(grid: DataFrame, keys: list[str] = ["grid_id"]) -> DataFrame:
    return grid.groupBy(*keys).agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))


def canvas_cells(frames: DataFrame, height: Column, width: Column) -> DataFrame:
    """One row per cell of a frame. Rows of cells are dealt to all tasks before columns are added, so that few frames, or
    frames that lie in one partition, still fill the cluster."""
    rows = frames.withColumns({"y": F.explode(F.sequence(F.lit(0), (height - 1).cast("int"))), "_canvas_w": width})
    tasks = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, F.xxhash64(*frames.columns, "y"))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("_canvas_w") - 1).cast("int")))).drop("_canvas_w")


def densify(cells: DataFrame, height, width, fill: float, keys: list[str] = ["grid_id"], ids: DataFrame | None = None) -> DataFrame:
    """Full canvas from sparse cells, missing cells set to `fill`.

    The missing cells are appended rather than joined: blanks and data meet in one aggregation whose
    key holds the position, so nothing depends on the size of a grid.
    """
    vals = values_of(cells, keys)
    frames = (cells if ids is None else ids).select(*keys).distinct()
    blank = canvas_cells(frames, F.lit(height), F.lit(width)).select(*keys, "y", "x", *[F.lit(None).cast(cells.schema[v].dataType).alias(v) for v in vals])
    inside = cells.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    both = inside.select(*keys, "y", "x", *vals).unionByName(blank)
    agg = both.groupBy(*keys, "y", "x").agg(*[F.max(v).alias(v) for v in vals])
    return agg.withColumns({v: F.coalesce(F.col(v), F.lit(fill).cast(cells.schema[v].dataType)) for v in vals})


def _merged(grid: DataFrame, keys: list[str], vals: list[str]) -> DataFrame:
    """Cells at one place become their mean. They meet by tiles; cells without a place meet by themselves."""
    schema = T.StructType([*[grid.schema[k] for k in keys], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *[T.StructField(v, T.DoubleType()) for v in vals]])

    def run(key, y, x, cells):
        y, x, columns = packs.merged(y, x, [cells[v] for v in vals])
        values = {v: pa.array(value, mask=~known) for v, (value, known) in zip(vals, columns)}
        return pa.table(packs.repeated(key, keys, len(y)) | {"y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32())} | values)

    lost = grid.where(F.col("y").isNull() | F.col("x").isNull()).groupBy(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(
        *[(F.sum(F.col(v) * F.lit(1.0)) / F.sum(F.lit(1.0))).alias(v) for v in vals]
    )
    return packs.per_grid(grid, keys, vals, run, schema, tile=TILE).unionByName(lost)


def area_downsample(grid: DataFrame, max_side: int = MAX_WORKING_SIDE, keys: list[str] = ["grid_id"]) -> DataFrame:
    """Area-average so that the longer side is at most `max_side`; smaller grids are unchanged."""
    vals = values_of(grid, keys)
    size = cut(dims(grid, keys))
    largest = size.agg(F.max(F.greatest("height", "width"))).first()[0]
    if largest is None or largest <= max_side:  # every cell is one cell of the result
        if packs.packable(grid, vals):
            return _merged(grid, keys, vals)
        return grid.groupBy(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(
            *[(F.sum(F.col(v) * F.lit(1.0)) / F.sum(F.lit(1.0))).alias(v) for v in vals]
        )
    g = grid.join(size, keys)
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("height", "width"))

    def spans(pos, side):
        new = F.bround(F.col(side) * scale)
        f = new / F.col(side)
        lo, hi = F.col(pos) * f, (F.col(pos) + 1) * f
        first = F.floor(lo + 1e-9)
        last = F.least(F.ceil(hi - 1e-9), new) - 1
        return F.transform(
            F.sequence(first.cast("int"), F.greatest(first, last).cast("int")),
            lambda t: F.struct(t.alias("at"), (F.least(hi, t + 1.0) - F.greatest(lo, t * 1.0)).alias("w")),
        )

    g = g.withColumn("_y", F.explode(spans("y", "height"))).withColumn("_x", F.explode(spans("x", "width")))
    w = F.col("_y.w") * F.col("_x.w")
    return g.groupBy(*keys, F.col("_y.at").alias("y"), F.col("_x.at").alias("x")).agg(
        *[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in vals]
    )


# Members of a group in which every grid may be paired with every later one.
MOST_MEMBERS = 1_000


def make_pairs(refs: DataFrame, cands: DataFrame, on: list[str], rule: str = "equal") -> DataFrame:
    """Pair each candidate with the reference that shares its key (a request names one of each).

    Rule "before" pairs it with every reference of its group whose id is smaller than its own. Pairs then grow with the square of
    a group, so groups of more than MOST_MEMBERS references or candidates are refused (ValueError) before anything is joined.
    """
    r = refs.select(*on, F.col("grid_id").alias("ref_id"))
    c = cands.select(*on, F.col("grid_id").alias("cand_id"))
    if rule == "before":
        for side in (r, c):
            most = side.groupBy(*on).count().agg(F.max("count").alias("n")).first()["n"]
            if most is not None and most > MOST_MEMBERS:
                raise ValueError(f"a group has {most} members; at most {MOST_MEMBERS} are paired with each other")
    elif rule != "equal":
        raise ValueError(f"unknown rule {rule!r}")
    p = c.join(r, on)
    if rule == "before":
        p = p.where("ref_id < cand_id")
    return p.withColumn("pair_id", F.concat_ws("|", F.col("ref_id").cast("string"), F.col("cand_id").cast("string")))


def compare_cells(ref: DataFrame, cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """Co-located cells of each pair: ref_* and cand_* values, NULL where one side has no cell."""
    keys = ["grid_id"]
    r = ref.select(F.col("grid_id").alias("ref_id"), "y", "x", *[F.col(v).alias(f"ref_{v}") for v in values_of(ref, keys)])
    c = cand.select(F.col("grid_id").alias("cand_id"), "y", "x", *[F.col(v).alias(f"cand_{v}") for v in values_of(cand, keys)])
    p = pairs.select("pair_id", "ref_id", "cand_id")
    # a reference of very many pairs is sent in counted copies
    left = multicast(p.select("pair_id", "ref_id"), r, "ref_id").drop("ref_id")
    right = multicast(p.select("pair_id", "cand_id"), c, "cand_id").drop("cand_id")
    return left.join(right, ["pair_id", "y", "x"], "full")


def edge_overlap(cells: DataFrame, ref_edge: str, cand_edge: str) -> DataFrame:
    """Edge class of each co-located cell with the display colour (b, g, r)."""
    r, c = F.coalesce(F.col(ref_edge), F.lit(False)), F.coalesce(F.col(cand_edge), F.lit(False))
    kind = F.when(r & c, "both").when(c, "candidate").when(r, "reference").otherwise("none")
    # Display colours in b, g, r order.
    colors = {"both": (255, 255, 255), "candidate": (255, 0, 255), "reference": (255, 255, 0), "none": (18, 18, 18)}
    out = cells.withColumn("edge_class", kind)
    for i, ch in enumerate("bgr"):
        value = F.lit(None).cast("double")
        for name, color in colors.items():
            value = F.when(F.col("edge_class") == name, F.lit(float(color[i]))).otherwise(value)
        out = out.withColumn(f"edge_{ch}", value)
    return out


def edge_counts(classes: DataFrame, by: list[str] = ["pair_id"]) -> DataFrame:
    def n(k):
        return F.count_if(F.col("edge_class") == k)

    return classes.groupBy(*by).agg(
        n("both").alias("edges_both"), n("reference").alias("edges_reference"),
        n("candidate").alias("edges_candidate"), n("none").alias("edges_none"),
    )
