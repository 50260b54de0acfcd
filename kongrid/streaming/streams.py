"""The same operators over unbounded inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kongrid.sources.images import image_size, validate_ingest

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(
    arrivals: DataFrame, accepted: str, quarantine: str, checkpoint: str, max_bytes: int, max_cells: int,
) -> StreamingQuery:
    """Check arriving rows (length, height, width, ...) and append them to one of two tables.

    Each micro-batch is checked once and written with its batch id as a partition, overwriting only
    that partition, so a batch that is run again after a failure does not leave duplicates.
    """

    def route(batch: DataFrame, batch_id: int) -> None:
        checked = validate_ingest(batch, max_bytes=max_bytes, max_cells=max_cells).withColumn("batch_id", F.lit(batch_id)).persist()
        for where, path in (("status = 200", accepted), ("status <> 200", quarantine)):
            part = checked.where(where).drop("batch_id")
            part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        checked.unpersist()

    return arrivals.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def image_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """New files under a folder with the size their header states, without their content; -1 where no header is known."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(path)

    @F.pandas_udf("height int, width int")
    def sizes(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(c) for c in content], columns=["height", "width"])

    return files.select("path", "modificationTime", "length", sizes("content").alias("_s")).select("path", "modificationTime", "length", "_s.*")


def session_stream(events: DataFrame, ttl_seconds: int, by: str = "session", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Closed sessions: activity of one key with no gap of `ttl_seconds`, emitted once the watermark passes."""
    win = F.session_window(F.col(ts), f"{ttl_seconds} seconds")
    g = events.withWatermark(ts, late).groupBy(by, win).agg(F.count("*").alias("n"), F.min(ts).alias("first_access"), F.max(ts).alias("last_access"))
    return g.drop("session_window")


def latest_stream(requests: DataFrame, session: str = "session", seq: str = "seq", ts: str = "ts", ttl: str = "24 hours") -> DataFrame:
    """Newest request per session and span of `ttl`, for update mode; `newest` reads the table that it fills.

    State holds the sessions of the spans that the watermark (`ttl` behind) has not passed.
    """
    rest = [c for c in requests.columns if c not in (session, seq)]
    best = requests.withWatermark(ts, ttl).groupBy(session, F.window(ts, ttl)).agg(F.max(F.struct(seq, *rest)).alias("_b"))
    return best.select(session, *[F.col(f"_b.{c}").alias(c) for c in [seq, *rest]])


def newest(table: DataFrame, session: str = "session", seq: str = "seq") -> DataFrame:
    """One row per session, by the largest `seq`, of what update batches have appended."""
    rest = [c for c in table.columns if c not in (session, seq)]
    best = table.groupBy(session).agg(F.max(F.struct(seq, *rest)).alias("_b"))
    return best.select(session, *[F.col(f"_b.{c}").alias(c) for c in [seq, *rest]])


def debounce_stream(events: DataFrame, quiet_seconds: int, by: list[str] = ["session"], ts: str = "ts", tie: str = "seq", late: str = "10 minutes") -> DataFrame:
    """The last event before each quiet interval, emitted once the watermark shows the interval is over."""
    rest = [c for c in events.columns if c not in (*by, ts, tie)]
    win = F.session_window(F.col(ts), f"{quiet_seconds} seconds")
    g = events.withWatermark(ts, late).groupBy(*by, win).agg(F.max(F.struct(ts, tie, *rest)).alias("_b"))
    return g.select(*by, *[F.col(f"_b.{c}").alias(c) for c in [ts, tie, *rest]])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and read the table.

    In update mode a batch appends its changed rows as a partition of its own, which running it again overwrites.
    """
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:

        def upsert(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

        q = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    table = spark.read.parquet(path)
    return table if mode == "append" else table.drop("batch_id")
