"""Training-data pipeline over documents: STAGES in order, each written as a table and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Empty tables pass through; null and empty texts leave at the first stage, since no language is recognised in them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm import decontaminate, language_id, near_copies, secrets, sentence_pieces
from evgraph.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: those without a letter go."""
    found = language_id.identify(docs, carry=COLUMNS[1:])
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, linked=near_copies.links) -> DataFrame:
    """The row with the smallest id of each component of near copies (five-word Jaccard of 0.8 or more); equal rows count once.

    A null id stays only where a component has no other. `linked` may find other links.
    """
    kept = near_copies.representatives(docs, linked).select(F.col("doc_id").alias("kept"), F.col("node").alias("kept_node"))
    rows = docs.select(*COLUMNS, near_copies.text_key().alias("node"))
    same = F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("node") == F.col("kept_node"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "node"]).select(*COLUMNS)


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As `without_near_duplicates`, and texts are linked by SimHash as well (op10: fingerprints 4 or fewer bits apart)."""
    return without_near_duplicates(spark, docs, sf_dir, near_copies.all_links)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are told apart by their text, so that ids may be null or repeated."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("key"))
    texts = rows.select(F.col("key").alias("doc_id"), "text")
    found = decontaminate.contamination(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias("key")), "key", "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    ledger = secrets.fresh_ledger(spark)
    secrets.scan(docs.select(F.col("doc_id").alias("path"), "text"), ledger)
    named = secrets.address(docs.select(*COLUMNS)).join(secrets.blob_spans(ledger), "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("spans")))
    changed = named.withColumn("text", clean)
    return changed.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the text that the ids decode to."""
    encoder = sentence_pieces.Encoder(spark, sentence_pieces.read_pieces())
    rows = encoder.decode(encoder.encode(docs, carry=("lang", "source")), carry=("lang", "source", "ids"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("language_id", known_language),
    ("simhash", without_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("sentence_pieces", encoded),
]

ORACLE_SQL = None  # languages, fingerprints and pieces are beyond SQL; tests/llm/test_pipeline.py has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
