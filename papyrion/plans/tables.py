"""Input tables of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, small: int = 1 << 30) -> DataFrame:
    """Small tables, by the planner's estimate, over all cores; larger ones stay as their files split them."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < small else df  # the bridge gives a number or, in some versions, its Java object
