"""Text of a paper: stored markup where there is some, else its metadata."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions import text as tf

# Longest text given to a model, by request kind; shortest useful markup.
SINGLE_CHARS, BATCH_CHARS, MARKUP_CHARS = 120_000, 80_000, 200


def extraction_text(versions: DataFrame, markup: DataFrame, max_chars: int = SINGLE_CHARS) -> DataFrame:
    """(version_id, source_kind, text, original_chars) for every version.

    `markup`: version_id, path, html. Markup counts when its text has more than 200 characters; the
    request takes at most `max_chars`, `original_chars` tells the length of the whole.
    """
    stored = markup.select("version_id", "path", tf.html_to_text(F.col("html")).alias("_body"))
    useful = F.length("_body") > MARKUP_CHARS
    whole = F.when(useful, F.col("_body")).otherwise(F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    kind = F.when(useful, F.concat(F.lit("file:"), "path")).otherwise("title_abstract")
    return versions.join(stored, "version_id", "left").select(
        "version_id", kind.alias("source_kind"), F.substring(whole, 1, max_chars).alias("text"),
        F.length(whole).alias("original_chars"))


def chosen_versions(works: DataFrame, versions: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Version to read per work: the requested one, else the primary one, else the earliest.

    A requested or primary version of another work gives no row. `requested`: work_id, version_id.
    """
    wanted = works.select("work_id", F.col("primary_version_id").alias("_primary"))
    if requested is not None:
        wanted = wanted.join(requested.select("work_id", F.col("version_id").alias("_asked")), "work_id", "left")
    else:
        wanted = wanted.withColumn("_asked", F.lit(None).cast(versions.schema["version_id"].dataType))
    first = versions.groupBy("work_id").agg(F.min_by("version_id", F.struct("created_at", "version_id")).alias("_first"))
    pick = wanted.join(first, "work_id", "left").select(
        "work_id", F.coalesce("_asked", "_primary", "_first").alias("version_id"))
    return versions.join(pick, ["work_id", "version_id"], "left_semi")


def read_sources(chosen: DataFrame, markup: DataFrame, max_chars: int = 50_000) -> DataFrame:
    """(work_id, version_id, source_kind, original_chars, truncated, text) of the chosen versions."""
    limit = max(1_000, min(max_chars, 200_000))
    stored = markup.select(
        "version_id", tf.strip_markup_spaced(F.col("html")).alias("_body"),
        F.when(F.endswith("path", F.lit(".html")), "html").otherwise("tei").alias("_kind"))
    whole = F.coalesce("_body", F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    return chosen.join(stored, "version_id", "left").select(
        "work_id", "version_id", F.coalesce("_kind", F.lit("metadata")).alias("source_kind"),
        F.length(whole).alias("original_chars"), (F.length(whole) > limit).alias("truncated"),
        F.substring(whole, 1, limit).alias("text"))
