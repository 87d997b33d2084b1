"""Session helpers."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: spark.checkpoint.dir, or else the session's warehouse.

    A local warehouse is shared only where everything runs in one process: elsewhere it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    alone = spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")
    if warehouse.startswith(("file:", "/")) and not alone:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/evgraph/{label}-{uuid.uuid4().hex}"


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Write `df` in a folder; the shuffles behind it leave the disks."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")  # else they stay until the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage and shuffles end there."""
    path = fresh_path(df.sparkSession, label)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote and that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder = folder.getParent() if "=" in folder.getName() else folder
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
