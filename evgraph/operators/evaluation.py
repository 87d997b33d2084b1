"""Checks against hand-made gold annotations. `gold`: name plus the columns of schemas.GOLD_JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import taxonomy as tx


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def gold_errors(gold: DataFrame) -> DataFrame:
    """(name, error, value): everything wrong with the annotations, one row per mistake."""
    known = lambda c: c.isNotNull() & c.isin(tx.RELATION_TYPES)

    def inside(items: str, bad, error: str, value=None) -> DataFrame:
        x = F.col("x")
        rows = gold.select("name", F.explode(items).alias("x")).where(bad(x))
        return rows.select("name", F.lit(error).alias("error"), (value(x) if value else F.lit(None)).cast("string").alias("value"))

    return (
        gold.where("arxiv_id IS NULL").select("name", F.lit("missing arxiv_id").alias("error"), F.lit(None).cast("string").alias("value"))
        .unionByName(inside("dna.claims", lambda x: _missing(x["text"]), "claim missing text"))
        .unionByName(inside("dna.methods", lambda x: _missing(x["name"]), "method missing name"))
        .unionByName(inside("relations", lambda x: ~known(x["type"]), "invalid relation type", lambda x: x["type"]))
        .unionByName(inside("relations", lambda x: _missing(x["target_arxiv"]), "relation missing target_arxiv"))
        .unionByName(
            inside("citation_contexts", lambda x: ~known(x["gold_type"]), "invalid cite gold_type", lambda x: x["gold_type"])
        )
    )


def gold_counts(gold: DataFrame) -> DataFrame:
    size = lambda c: F.sum(F.greatest(F.size(F.col(c)), F.lit(0)).cast("long"))
    return gold.agg(
        F.count("*").alias("papers"), size("dna.claims").alias("claims"), size("dna.methods").alias("methods"),
        size("relations").alias("relations"), size("citation_contexts").alias("contexts"))


def relation_coverage(gold: DataFrame, versions: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """Every gold relation of a known paper with outcome hit, target unknown or not found."""
    known = versions.where("arxiv_id IS NOT NULL").groupBy("arxiv_id").agg(F.max("work_id").alias("work_id"))
    source = known.select("arxiv_id", F.col("work_id").alias("source_work_id"))
    target = known.select(F.col("arxiv_id").alias("target_arxiv"), F.col("work_id").alias("target_work_id"))
    end = lambda role: members.where(F.col("role") == role).select(
        "relation_id", F.col("anchor_work_id").alias(f"{role}_work_id"))
    existing = (
        relations.select("relation_id", "type").join(end("source"), "relation_id").join(end("target"), "relation_id")
        .select("type", "source_work_id", "target_work_id").distinct().withColumn("_hit", F.lit(True))
    )
    wanted = gold.select("name", "arxiv_id", F.posexplode("relations").alias("item_no", "x")).select(
        "name", "arxiv_id", "item_no", F.col("x.type").alias("type"), F.col("x.target_arxiv").alias("target_arxiv"))
    outcome = (
        F.when(F.col("target_work_id").isNull(), "target unknown").when(F.col("_hit"), "hit").otherwise("not found")
    )
    return (
        wanted.join(source, "arxiv_id").join(target, "target_arxiv", "left")
        .join(existing, ["type", "source_work_id", "target_work_id"], "left")
        .select("name", "item_no", "type", "target_arxiv", outcome.alias("outcome"))
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.agg(F.count_if(F.col("outcome") == "hit").alias("hits"), F.count("*").alias("total"))
