"""Documents as a stream: classify and scan as files arrive, keep the newest result of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrion.operators.store import newest
from papyrion.plans.extraction import classified

SCHEMA = "doc_id long, filename string, text string, seq long"


def documents(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines of documents as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).json(path)


def enrich(docs: DataFrame) -> DataFrame:
    """Type, language and personal data of each document; the same plan serves batches and streams."""
    return classified(docs)


def to_history(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch as its own table under ``path``: a repeated batch overwrites itself."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return enrich(docs).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, path: str, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """The newest row of each document over all batches."""
    return newest(spark.read.parquet(path), key, order)


def counts_by_hour(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Extension: events per type and hour, with late rows up to a watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "event_type").agg(F.count("*").alias("n"))
