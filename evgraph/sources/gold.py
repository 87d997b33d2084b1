"""Gold annotation files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph import schemas


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file, named after the file."""
    files = spark.read.text(path, wholetext=True)
    return parse_gold(
        files.select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), F.col("value").alias("raw"))
    )


def parse_gold(texts: DataFrame) -> DataFrame:
    """Same rows from a table of (name, raw)."""
    return texts.select("name", F.from_json("raw", schemas.GOLD_JSON).alias("g")).select("name", "g.*")
