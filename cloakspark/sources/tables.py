"""Tables of a folder of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts, whose rows are worth a task's time.
TEXTS = {"documents", "pages"}
#: Bytes up to which a table counts as small. Its row groups may be too few for the cores, and moving it costs little.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is small and comes in fewer splits than there are; larger tables are never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL
    return df.repartition(cores) if small and df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
