"""Streaming queries (ST-1..4): the tables are read as streams and must equal the batch result in SQL."""

import uuid

from pyspark.sql import functions as F

from checks.base import R1, query
from kongrid.operators.cut import shared_dir
from kongrid.sources import adapters as A
from kongrid.streaming import streams as S


def stream(spark, sf, name):
    """A table as a stream of files. A pattern, and not the path itself, matches one file as well as a folder of them."""
    schema = A.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.[p]arquet")


def requests(spark, sf):
    return stream(spark, sf, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("param"), "value"
    )


def places(spark, n=2):
    base = f"{shared_dir(spark).rstrip('/')}/kongrid-stream-{uuid.uuid4().hex}"
    return [f"{base}/{i}" for i in range(n)]


def plain(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("st1_ingest_stream", """SELECT page_id, CASE WHEN n > 6000 THEN 413 WHEN page_id % 7 = 0 THEN 400 WHEN n * 40 > 150000 THEN 413 ELSE 200 END AS status
FROM (SELECT page_id, length(html) AS n FROM pages)""")
def st1(spark, sf):
    p = stream(spark, sf, "pages")
    n = F.length("html")
    p = p.select("page_id", n.alias("length"), F.when(F.col("page_id") % 7 == 0, -1).otherwise(n).alias("height"), F.lit(40).alias("width"))
    good, bad, check = places(spark, 3)
    S.ingest_stream(p, good, bad, check, 6000, 150_000).awaitTermination()
    return spark.read.parquet(good).unionByName(spark.read.parquet(bad)).select("page_id", "status")


# a session is closed once the watermark (newest event minus ten minutes) has passed its end
@query("st2_session_stream", f"""WITH {R1}, l AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 86400000000 THEN 1 ELSE 0 END AS b FROM r1 WINDOW w AS (PARTITION BY session ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY session ORDER BY ts) AS k FROM l), g AS (SELECT session, count(*) AS n, min(ts) AS first_access, max(ts) AS last_access FROM s GROUP BY session, k)
SELECT * FROM g WHERE last_access + INTERVAL 24 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM r1)) - INTERVAL 10 MINUTE""")
def st2(spark, sf):
    out, check = places(spark)
    return plain(S.run_to_table(S.session_stream(requests(spark, sf), 86400), out, check), "first_access", "last_access")


@query("st3_latest_stream", f"WITH {R1} SELECT session, seq, ts, param, value FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS k FROM r1) WHERE k = 1")
def st3(spark, sf):
    out, check = places(spark)
    return plain(S.newest(S.run_to_table(S.latest_stream(requests(spark, sf)), out, check, "update")), "ts")


@query("st4_debounce_stream", f"""WITH {R1}, l AS (SELECT *, lead(ts) OVER (PARTITION BY session ORDER BY ts, seq) AS nxt FROM r1)
SELECT session, seq, ts, param, value FROM l WHERE (nxt IS NULL OR epoch_us(nxt) - epoch_us(ts) >= 7200000000)
AND ts + INTERVAL 2 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM r1)) - INTERVAL 10 MINUTE""")
def st4(spark, sf):
    out, check = places(spark)
    return plain(S.run_to_table(S.debounce_stream(requests(spark, sf), 7200), out, check), "ts")
