"""Five stages from raw documents to shards; each takes what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kongrid.llm.common import likely, scratch, table
from kongrid.llm.latent import without_leaks
from kongrid.llm.mixing import fit_mixture, label_domains, mixed
from kongrid.llm.quality import accepted, train_quality
from kongrid.llm.queries import SHARDS
from kongrid.llm.sharding import shard_minimax
from kongrid.llm.simhash import near_duplicates
from kongrid.operators.cut import cut

# Token weights by domain; the quality stage has removed the third one.
TARGETS = {"clean": 0.99, "toxic": 0.01}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return accepted(docs, train_quality(docs, table(spark, sf_dir, "labels")), 0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, of rows that share it the smallest text hash.

    A row is named by its doc_id and its text, so rows that repeat an id with other texts are documents of their own, and
    rows repeated in full are copies. Null ids count as larger than any, null texts as empty. Columns may have any name.
    """
    text = F.coalesce("text", F.lit(""))
    keys = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_h1": F.xxhash64(text), "_h2": F.xxhash64(text, F.lit(1))}
    named = docs.select(F.struct(*[c.alias(k) for k, c in keys.items()]).alias("name"), "text")
    names = near_duplicates(named, 4, id_col="name").groupBy("name").agg(F.min("component_id").alias("least"), F.count("*").alias("n"))
    doubtful = cut(names.where("n > 1 or name <> least").select("name.*", (F.col("name") != F.col("least")).alias("goes")))
    # Rows of a name that is alone and stays are finished where they lie; only the others' texts are moved.
    mark = F.xxhash64(*keys)
    maybe, sure = likely(docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(k) for k, c in keys.items()]).withColumn("_mark", mark), doubtful.select(mark.alias("_mark")), "_mark")
    judged = maybe.dropDuplicates(list(keys)).join(doubtful.where("goes"), list(keys), "left_anti")
    return sure.select("_row").union(judged.select("_row")).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet the target weights; rates within 5 % of 1 keep a document once."""
    return mixed(docs, fit_mixture(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document that is left."""
    return shard_minimax(docs, SHARDS).drop("digest")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

# The first stages fit models; no SQL states their rows. tests/llm/test_pipeline.py holds near_dedup and shard against plain
# versions, and quality, decontaminate and mix to what they must keep and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
