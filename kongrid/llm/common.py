"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.operators.cut import cut, shared_dir
from kongrid.operators.keys import BROADCAST_ROWS, HOT_PARTS

# Rows that one call of a kernel gets. Batches that Spark sends are cut to it, so memory follows the texts of a few rows.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/kongrid-{what}-{uuid.uuid4().hex}"


def utf8(column: Column | str) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def map_rows(df: DataFrame, kernel: Callable[[list[list]], list[list]], schema: str, size: int = SLICE_ROWS) -> DataFrame:
    """Run `kernel` over slices of `size` rows of each Arrow batch: lists of input columns in, lists of output columns out."""
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                out = kernel([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, target)


def filter_rows(df: DataFrame, text: Column, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of `df`, all columns as they are, for whose `text` (bytes) the kernel says True."""
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                mask = pa.array(keep(part.column(n).to_pylist()), pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[:n], names=batch.schema.names[:n]).filter(mask)

    return df.select("*", text.alias("_filter_text")).mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text has remainder 2 by 4: labels of such rows are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(labels: DataFrame, rows: int, value: str = "quality") -> DataFrame:
    """At most `rows` labelled ids outside the held-out quarter, chosen by hash; repeated ids take their largest label."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(value).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(rows)
    )


# Bits of the map that `likely` broadcasts: 16 MB whatever the number of keys, in rows of MAP_ROW bits.
MAP_BITS, MAP_ROW = 27, 1 << 11


def likely(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose `column`, a hash, may be among those of `keys`, rows whose isn't), so that a join moves only the former.

    The bits that the keys' hashes begin with are set in a map of fixed size, which Spark builds and broadcasts: no key is
    missed, and a row is let through by chance with the share of bits that are set. No row goes through Python for it.
    """
    spot = F.shiftrightunsigned(F.col(column), 64 - MAP_BITS)
    buckets = keys.select((spot + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    n = 32768 // MAP_ROW
    shared = cut(buckets.select("b", "bits", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(
        ((F.col("b") - 1) * n + F.col("k")).alias("_map"), F.substring("bits", F.col("k") * (MAP_ROW // 8) + 1, F.lit(MAP_ROW // 8)).alias("_bits")))
    at = (spot % MAP_ROW).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("long")
    seen = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    marked = rows.withColumn("_map", F.shiftright(spot, 11)).join(F.broadcast(shared), "_map", "left").withColumn("_likely", seen)
    marked = marked.select(*[F.col(f"`{c}`") for c in rows.columns], "_likely")
    return marked.where("_likely").drop("_likely"), marked.where("not _likely").drop("_likely")


def attach_left(rows: DataFrame, stats: DataFrame, on: list[str], count: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left-join one row per key (narrow, `count` = rows of that key) onto `rows`.

    The stats are written and counted; up to `limit` of them are broadcast. Beyond it only keys that hold more than
    1/HOT_PARTS of the rows are (at most HOT_PARTS keys), and the other rows are joined by a shuffle without a large key.
    """
    stats = cut(stats)
    if stats.count() <= limit:
        return rows.join(F.broadcast(stats), on, "left")
    hot = F.col(count) * F.lit(HOT_PARTS) > F.lit(stats.agg(F.sum(count)).first()[0])
    few, rest = F.broadcast(stats.where(hot)), stats.where(~hot)
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(rest, on, "left"))
