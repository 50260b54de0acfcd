"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.llm.archives import archive_round_trip
from kongrid.llm.common import table
from kongrid.llm.crosswalk import align_tokens
from kongrid.llm.forest import nearest
from kongrid.llm.latent import find_leaks
from kongrid.llm.licenses import scan_licenses
from kongrid.llm.lines import judge_lines, train_field
from kongrid.llm.mixing import fit_mixture, fitted_rates, label_domains
from kongrid.llm.orchard import compress
from kongrid.llm.quality import score_quality, train_quality
from kongrid.llm.repeats import strip_repeats
from kongrid.llm.sharding import shard_minimax
from kongrid.llm.simhash import near_duplicates
from kongrid.llm.urls import filter_urls, label_urls, mine_rules

SHARDS = 16
# Target weights of tokens by domain; the first one's tokens set the scale.
TARGETS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}


def op1_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), 0.7)


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, mine_rules(label_urls(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_lines(docs, train_field(docs, table(spark, sf_dir, "labels"))).drop("labels")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_minimax(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fitted_rates(fit_mixture(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS))


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 4)


def op9_prefix_free_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(table(spark, sf_dir, "documents"), 400).withColumn("kept", F.make_valid_utf8(F.col("kept").cast("string")))


def op10_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), 0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), 5, 50)


def op12_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


FIRST = (op1_quality_pu, op2_url_rules, op3_line_crf, op4_minimax_shards, op5_license_join, op6_soft_mixing, op7_latent_leaks, op8_simhash_popcount, op9_prefix_free_parse, op10_arc_to_warc)
QUERIES = {f.__name__: f for f in (*FIRST, op11_prefix_forest, op12_merge_path, op13_orchard_codes)}
SQL: dict[str, str] = {}
