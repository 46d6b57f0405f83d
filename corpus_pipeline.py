"""The corpus pipeline: stages over the documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hostpulse.llm import decontamination, jaccard, mixing, quality, sharding
from hostpulse.llm.common import fresh_name, table
from hostpulse.llm.queries import SHARDS, domain, weight
from hostpulse.session import materialised, prepare, shared_dir

#: Part of the tokens that reach the mixing stage which the mix holds; each document is used once at most.
MIX_SHARE = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(docs, model).filter("kept").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    prepare(spark)
    return jaccard.one_of_each_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget."""
    prepare(spark)
    tokens, top = fresh_name(docs, "mix_words"), fresh_name(docs, "mix_domain")
    rows = materialised(docs.withColumn(tokens, mixing.word_tokens()).withColumn(top, domain()), "pipeline-mix")
    all_tokens = rows.agg({tokens: "sum"}).first()[0] or 0
    mix = mixing.mix(rows, [top, "lang", "source"], tokens, weight, total=MIX_SHARE * all_tokens, epochs=1)
    return mix.select(*[f"`{c}`" for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it."""
    prepare(spark)
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed_sources),
    ("sharding", sharded),
]

#: SQL can express neither the trained classifier nor the seeded bounded-load ring; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
