"""Reading lists: free text lines with titles, links and identifiers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions import text as tf
from evgraph.operators.linkage import assign_new_works, resolve_works
from evgraph.operators.tables import computed_once

UNKNOWN_URL = "unrecognized URL; metadata will be best-effort"
NO_IDENTIFIER = "no identifier; needs manual URL/DOI"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds raw, title, url, arxiv_id, doi, error to `line`; blank and # lines are left out.

    A line splits at the first `|`, else the first tab, else before `http`; without a split it is a
    link, an identifier or a title.
    """
    raw = computed_once(lines, raw=tf.strip(F.col("line"))).where("raw <> '' AND NOT startswith(raw, '#')")
    line = F.col("raw")
    at = F.locate("http", line)
    cut = lambda sep: F.array(
        tf.strip(F.substring_index(line, sep, 1)), tf.strip(F.substring(line, F.locate(sep, line) + 1, F.length(line))))
    parts = (
        F.when(F.contains(line, F.lit("|")), cut("|"))
        .when(F.contains(line, F.lit("\t")), cut("\t"))
        .when(
            at > 1,
            F.array(
                F.regexp_replace(F.substring(line, F.lit(1), at - 1), "[, ;]+$", ""),
                F.substring(line, at, F.length(line)),
            ),
        )
        .otherwise(F.array(line))
    )
    split = computed_once(raw, _parts=parts)
    two, token = F.size("_parts") == 2, F.element_at("_parts", -1)
    found = computed_once(
        split, _two=two, _token=token, _arxiv=tf.parse_arxiv_id(token), _doi=tf.parse_doi(token))
    two, token, arxiv, doi = (F.col(c) for c in ("_two", "_token", "_arxiv", "_doi"))
    linked = two | arxiv.isNotNull() | doi.isNotNull() | F.startswith(token, F.lit("http"))
    return found.select(
        *raw.columns,
        F.when(two, F.element_at("_parts", 1)).when(~linked, token).alias("title"),
        F.when(linked, token).alias("url"),
        arxiv.alias("arxiv_id"),
        # a single token that is an arXiv id is not read as a DOI as well
        F.when(two | arxiv.isNull(), doi).alias("doi"),
        F.when(~two & ~linked, F.lit(NO_IDENTIFIER))
        .when(~two & arxiv.isNull() & doi.isNull(), F.lit(UNKNOWN_URL)).alias("error"),
    )


def importable(parsed: DataFrame) -> DataFrame:
    """Parsed lines with an identifier, with the title and kind their version gets."""
    return parsed.where("arxiv_id IS NOT NULL OR doi IS NOT NULL").select(
        *[c for c in parsed.columns if c != "title"],
        F.coalesce(
            "title", F.concat(F.lit("arXiv:"), "arxiv_id"), F.concat(F.lit("DOI:"), "doi"), "raw"
        ).alias("title"),
        F.when(F.col("arxiv_id").isNotNull(), "arxiv").otherwise("other").alias("kind"),
        F.lit(None).cast("int").alias("year"),
    )


def confirm(parsed: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """Outcome of every parsed line (seq orders them): created, matched or skipped."""
    resolved = resolve_works(importable(parsed), works, versions)
    unmatched = resolved.where("match_kind = 'new'")
    placed = assign_new_works(unmatched).select(
        "seq", F.when(F.col("link_kind") == "new", "created").otherwise("matched").alias("outcome"))
    matched = resolved.where("match_kind <> 'new'").select("seq", F.lit("matched").alias("outcome"))
    skipped = parsed.where("arxiv_id IS NULL AND doi IS NULL").select("seq", F.lit("skipped").alias("outcome"))
    return placed.unionByName(matched).unionByName(skipped)


def confirm_counts(outcomes: DataFrame) -> DataFrame:
    """Lines that created a work, and all others."""
    return outcomes.agg(
        F.count_if(F.col("outcome") == "created").alias("created"),
        F.count_if(F.col("outcome") != "created").alias("skipped"),
    )
