"""Table maintenance without a table format: upsert, insert-ignore, bounded top-k."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evgraph.session import fresh_path, written


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a one-row generator.

    Later filters cannot be pushed through it, so the optimizer does not copy long expressions into
    every predicate that mentions the column.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """Rows partitioned by `keys` into a number of parts that adaptive execution does not lower.

    For the input of a step that multiplies rows: its own size says little about the work ahead, and
    its parts would be merged into a few. spark.sql.shuffle.partitions decides where it was raised
    above Spark's default; below that a few parts per core are enough.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts <= 200:
        parts = min(parts, 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def in_rounds(rows: DataFrame, key: str, rounds: int, label: str, step: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """`step` on the rows of some keys after the other, as one table: the disks hold the shuffles of one round at a time.

    `step` gets the rows of a round, and a function that picks the same keys from another table's column.
    """
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, label)
    for n in range(rounds):
        turn = lambda df, column=key, n=n: df if rounds == 1 else df.where(F.pmod(F.xxhash64(column, F.lit("round")), F.lit(rounds)) == n)
        done = step(turn(rows), turn)
        written(done, f"{path}/round={n}")
    return spark.read.schema(done.schema).parquet(*[f"{path}/round={n}" for n in range(rounds)])


def crowded(rows: DataFrame, key: str, per_part: int) -> DataFrame:
    """(key, parts) of the keys with more than `per_part` rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / per_part).cast("long").alias("parts"))
    return counts.where("parts > 1")


def in_parts(rows: DataFrame, key: str, crowds: DataFrame, *spread_by: str) -> DataFrame:
    """Adds `part`: the rows of a crowded key are dealt by a hash of `spread_by`, those of others have part 0."""
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce("parts", F.lit(1)))
    return rows.join(crowds, key, "left").withColumn("part", part).drop("parts")


def in_every_part(rows: DataFrame, key: str, crowds: DataFrame) -> DataFrame:
    """Adds `part`: one copy of each row for every part of its key, to meet the rows of `in_parts`."""
    last = F.coalesce("parts", F.lit(1)) - 1
    copies = F.explode(F.sequence(F.lit(0).cast("long"), last))
    return rows.join(crowds, key, "left").withColumn("part", copies).drop("parts")


def left_known(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join whose rows without a key, which match nothing, are spread instead of meeting in one task."""
    unknown = F.col(keys[0]).isNull()
    for k in keys[1:]:
        unknown = unknown | F.col(k).isNull()
    salted = left.withColumn("_salt", F.when(unknown, 1 + F.monotonically_increasing_id() % 4096).otherwise(0))
    return salted.join(right.withColumn("_salt", F.lit(0).cast("long")), [*keys, "_salt"], "left").drop("_salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per key. Spark prunes to k per task before the shuffle, so a hot key stays small."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def upsert_latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by `order`. An aggregate, so repeats are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    winner = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(winner).select(*key, "_row.*").select(*df.columns)


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Changes replace stored rows of the same key; among changes the last by `order` wins."""
    columns = current.columns
    latest = upsert_latest(changes, key, order).select(*columns)
    return current.join(latest.select(*key), key, "left_anti").unionByName(latest).select(*columns)


def insert_ignore(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key is not stored yet; of several with one key, the least by the other columns."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*") if rest else new.distinct()
    return first.join(current.select(*key), key, "left_anti").select(*new.columns)


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(offset, 0)).limit(limit)


def add_to_graph(graph_works: DataFrame, work_ids: DataFrame, graph_id, added_by) -> DataFrame:
    """Memberships really added when `work_ids` are put into one graph."""
    like = graph_works.schema
    wanted = work_ids.select(
        F.lit(graph_id).cast(like["graph_id"].dataType).alias("graph_id"),
        "work_id",
        F.lit(added_by).cast(like["added_by"].dataType).alias("added_by"),
    )
    return insert_ignore(graph_works, wanted, ["graph_id", "work_id"])
