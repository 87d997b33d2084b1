"""Helpers shared by the operators: rows in and out of Arrow batches, and the held-out fold."""

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_FOLDS = 5


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the UTF-8 bytes of text, and `more`: extra columns of the input stay behind."""
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), *more)


def held_out(doc_id: str = "doc_id") -> Column:
    """One id in five is never learned from; a null id is learned from like the others."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_FOLDS
    return F.coalesce(fold == 0, F.lit(False))


_model: dict = {}


def worker_model(key, build):
    """The model of `key` in this Python worker: built at first use, kept until another one is asked for."""
    if key not in _model:
        free_model()
        _model[key] = build()
    return _model[key]


def free_model() -> None:
    """Drops what `worker_model` keeps: workers are used again by the stages that follow."""
    if _model:
        _model.clear()
        gc.collect()  # a model may refer to itself
        pa.default_memory_pool().release_unused()


ROWS_AT_ONCE = 500


def map_documents(docs: DataFrame, fn, schema: str) -> DataFrame:
    """`fn` gets the columns of some rows as a dict of lists and returns a dict of columns named in `schema`."""
    fields = docs.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                out = fn({n: rows.column(n).to_pylist() for n in rows.schema.names})
                yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in shape], schema=shape)

    return docs.mapInArrow(run, fields)


def _array(values, kind):
    return values if isinstance(values, pa.Array) else pa.array(values, kind)
