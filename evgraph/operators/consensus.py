"""Votes, status and team state."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions import text as tf
from evgraph.functions.scores import synthetic_id
from evgraph.operators.tables import upsert_latest

SUBJECT = ["subject_kind", "subject_id"]


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """One vote per (subject, user): the latest, late arrivals of older votes change nothing."""
    return upsert_latest(reviews, SUBJECT + ["user_id"], ["created_at", "review_id"])


def _vote_flags(reviews: DataFrame, *keys) -> DataFrame:
    return reviews.groupBy(*keys).agg(
        F.bool_or(F.col("verdict") == "agree").alias("agreed"),
        F.bool_or(F.col("verdict") == "disagree").alias("disagreed"),
    )


def status_of(agreed: Column, disagreed: Column) -> Column:
    both = F.when(agreed & disagreed, "disputed")
    return both.when(disagreed, "rejected").when(agreed, "confirmed").otherwise("unreviewed")


def relation_status(latest: DataFrame) -> DataFrame:
    """(subject_id, review_status) of every relation that has votes; the others are unreviewed."""
    status = status_of(F.col("agreed"), F.col("disagreed"))
    votes = _vote_flags(latest.where(F.col("subject_kind") == "relation"), "subject_id")
    return votes.select("subject_id", status.alias("review_status"))


def apply_status(relations: DataFrame, status: DataFrame) -> DataFrame:
    """Relations with the status of their votes; relations without votes keep the stored one."""
    voted = status.select(F.col("subject_id").alias("relation_id"), F.col("review_status").alias("_voted"))
    return (
        relations.join(voted, "relation_id", "left")
        .withColumn("review_status", F.coalesce("_voted", "review_status"))
        .drop("_voted")
    )


def override_status(reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """Final (subject_id, review_status) after votes and status overrides, in time order.

    `overrides`: subject_id, user_id, status, created_at, review_id. Confirmed and rejected
    are the caller's vote; unreviewed discards every vote cast before it; disputed holds until
    the next vote or override.
    """
    as_vote = overrides.where(F.col("status").isin("confirmed", "rejected")).select(
        "subject_id", "user_id",
        F.when(F.col("status") == "confirmed", "agree").otherwise("disagree").alias("verdict"),
        "created_at", "review_id")
    votes = (
        reviews.where(F.col("subject_kind") == "relation")
        .select("subject_id", "user_id", "verdict", "created_at", "review_id")
        .unionByName(as_vote)
    )
    marks = overrides.groupBy("subject_id").agg(
        F.max(F.when(F.col("status") == "unreviewed", F.struct("created_at", "review_id"))).alias("cleared"),
        F.max(F.when(F.col("status") == "disputed", F.struct("created_at", "review_id"))).alias("disputed"),
    )
    moment = F.struct("created_at", "review_id")
    kept = votes.join(marks.select("subject_id", "cleared"), "subject_id", "left").where(
        F.col("cleared").isNull() | (moment > F.col("cleared"))
    )
    last_vote = kept.groupBy("subject_id").agg(F.max(moment).alias("last_vote"))
    voted = relation_status(
        upsert_latest(
            kept.drop("cleared").withColumn("subject_kind", F.lit("relation")),
            SUBJECT + ["user_id"], ["created_at", "review_id"]))
    subjects = votes.select("subject_id").union(overrides.select("subject_id")).distinct()
    held = F.col("disputed").isNotNull() & (
        F.coalesce(F.col("disputed") > F.col("last_vote"), F.lit(True))
        & F.coalesce(F.col("disputed") > F.col("cleared"), F.lit(True))
    )
    return (
        subjects.join(voted, "subject_id", "left")
        .join(last_vote, "subject_id", "left")
        .join(marks, "subject_id", "left")
        .select(
            "subject_id",
            F.when(held, "disputed").otherwise(F.coalesce("review_status", F.lit("unreviewed"))).alias("review_status"),
        )
    )


def judgment_disputes(judgments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Judgments with their vote counts and whether both verdicts occur."""
    votes = (
        reviews.where(F.col("subject_kind") == "claim_judgment")
        .groupBy(F.col("subject_id").alias("judgment_id"))
        .agg(
            F.count_if(F.col("verdict") == "agree").alias("agrees"),
            F.count_if(F.col("verdict") == "disagree").alias("disagrees"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        judgments.join(votes, "judgment_id", "left")
        .withColumn("agrees", F.coalesce("agrees", zero))
        .withColumn("disagrees", F.coalesce("disagrees", zero))
        .withColumn("disputed", (F.col("agrees") > 0) & (F.col("disagrees") > 0))
    )


def propagate_claim_disputes(claims: DataFrame, judgments: DataFrame, reviews: DataFrame) -> DataFrame:
    """A claim with a disputed judgment becomes disputed; every other claim keeps its status."""
    flags = judgment_disputes(judgments, reviews).groupBy("claim_id").agg(F.bool_or("disputed").alias("_hit"))
    return (
        claims.join(flags, "claim_id", "left")
        .withColumn("review_status", F.when(F.col("_hit"), "disputed").otherwise(F.col("review_status")))
        .drop("_hit")
    )


def upsert_reading(changes: DataFrame, order: list[str]) -> DataFrame:
    return upsert_latest(changes, ["user_id", "work_id"], order)


def promote_selections(selections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marked passages -> confirmed team claims and their evidence.

    `selections`: selection_id, work_id, version_id, user_id, claim_text, source_text, page.
    A claim without text is refused; blank evidence is dropped while its claim stays.
    """
    valid = selections.where(tf.strip(F.col("claim_text")) != "").withColumn(
        "claim_id", synthetic_id(F.lit("claim"), F.col("selection_id"))
    )
    claims = valid.select(
        "claim_id", "work_id", F.col("claim_text").alias("text"), F.lit("team_record").alias("source"),
        F.lit("confirmed").alias("review_status"), F.col("user_id").alias("created_by"))
    evidence = valid.where(tf.strip(F.col("source_text")) != "").select(
        synthetic_id(F.lit("evidence"), F.col("selection_id")).alias("evidence_id"), "claim_id",
        F.lit("promoted_claim").alias("extraction_field"), "version_id", "page",
        F.col("source_text").alias("text"))
    return claims, evidence
