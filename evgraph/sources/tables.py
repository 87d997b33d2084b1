"""Typed table load."""

from pyspark.sql import DataFrame, SparkSession

from evgraph import schemas


def load(spark: SparkSession, directory: str, names=None) -> dict[str, DataFrame]:
    """Evidence-graph tables stored as `<directory>/<name>.parquet`, with their declared schemas."""
    return {
        name: spark.read.schema(schemas.TABLES[name]).parquet(f"{directory}/{name}.parquet")
        for name in (names or schemas.TABLES)
    }


def load_raw(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.RAW[name]).parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Input for costly expressions: files with fewer splits than cores are dealt out to all of them.

    Large inputs have many splits and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
