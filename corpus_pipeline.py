"""From raw documents to shards: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyrion.llm import decontaminate, mixing, quality, sharding, simhash
from papyrion.llm.common import cut, remove, table, tables_made

#: Nine tenths of the tokens that reach the mixing stage, each document once at most.
MIXTURE = mixing.Params(share=900, max_epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the adaptive thresholds."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by domain, language and source."""
    return mixing.mix(docs, MIXTURE)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of their shard."""
    return sharding.assign(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: SQL cannot express the fingerprints' hash; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    Once a stage's result is written, what it and its predecessor wrote before is deleted.
    """
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_made() as made:
            docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove(spark, [*last, *made[:-1]])
        last = made[-1:]
    return docs
