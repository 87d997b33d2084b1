"""Model output (JSON per document) -> aspect, method, claim, citation and evidence rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import schemas
from evgraph import taxonomy as tx
from evgraph.functions import text as tf
from evgraph.functions.scores import synthetic_id
from evgraph.operators.linkage import clean_references, replace_citations, resolve_citations

METHOD_NAME_CHARS = 120


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def aspect_objects(outputs: DataFrame) -> DataFrame:
    """(work_id, version_id, aspect, object) for the aspects present in `outputs` (work_id, version_id, raw)."""
    parsed = F.from_json(tf.lenient_json(F.col("raw")), schemas.aspect_json(tx.ASPECTS))
    listed = F.array(*[F.struct(F.lit(k).alias("aspect"), F.col(f"_dna.{k}").alias("object")) for k in tx.ASPECTS])
    return (
        outputs.select("work_id", "version_id", parsed.alias("_dna"))
        .select("work_id", "version_id", F.inline(listed))
        .where("object IS NOT NULL")
    )


def _page(obj: Column) -> Column:
    return F.greatest(F.coalesce(obj["page"], F.lit(0)), F.lit(0)).cast("int")


def aspect_rows(objects: DataFrame) -> DataFrame:
    o = F.col("object")
    return objects.select(
        "work_id", "aspect", tf.strip(_text(o["summary"])).alias("summary"),
        F.coalesce(o["bullets"], F.array().cast("array<string>")).alias("bullets"),
        _text(o["source_text"]).alias("source_text"), _page(o).alias("page"))


def _bulleted(objects: DataFrame, aspect: str, summary_chars: int | None) -> DataFrame:
    """One row per bullet of an aspect, or one for its summary when there is no bullet at all."""
    o = F.col("object")
    summary = tf.strip(_text(o["summary"]))
    head = summary if summary_chars is None else F.substring(summary, 1, summary_chars)
    bullets = F.coalesce(o["bullets"], F.array().cast("array<string>"))
    kept = F.filter(F.transform(bullets, tf.strip), lambda b: b != "")
    single = F.when(summary != "", F.array(head)).otherwise(F.array().cast("array<string>"))
    return objects.where(F.col("aspect") == aspect).select(
        "work_id", "version_id", summary.alias("summary"), _text(o["source_text"]).alias("source_text"),
        _page(o).alias("page"),
        F.posexplode(F.when(F.size(bullets) > 0, kept).otherwise(single)).alias("item_no", "item"))


def method_rows(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(methods, evidence): a method per bullet, named by it and described by the summary."""
    rows = _bulleted(objects, "methods", METHOD_NAME_CHARS)
    methods = rows.select(
        synthetic_id(F.lit("method"), F.col("version_id"), F.col("item_no")).alias("method_id"), "work_id",
        F.col("item").alias("name"),
        F.when(F.col("item") == F.col("summary"), "").otherwise(F.col("summary")).alias("description"),
        F.lit("ai_candidate").alias("source"), F.lit("unreviewed").alias("review_status"))
    evidence = rows.where("source_text <> ''").select(
        "version_id", "page", F.col("source_text").alias("text"),
        F.concat(F.lit("method:"), "item").alias("extraction_field"))
    return methods, evidence


def claim_rows(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence): a claim per bullet of the findings."""
    rows = _bulleted(objects, "findings", None).withColumn(
        "claim_id", synthetic_id(F.lit("claim"), F.col("version_id"), F.col("item_no")))
    claims = rows.select(
        "claim_id", "work_id", F.col("item").alias("text"), F.lit("ai_candidate").alias("source"),
        F.lit("unreviewed").alias("review_status"))
    evidence = rows.where("source_text <> ''").select(
        "claim_id", "version_id", "page", F.col("source_text").alias("text"), F.lit("claim").alias("extraction_field"))
    return claims, evidence


def field_evidence(objects: DataFrame) -> DataFrame:
    """Evidence per aspect with a source text; the quote is the first of summary, text, name, source text."""
    o = F.col("object")
    return objects.where(_text(o["source_text"]) != "").select(
        "version_id", _page(o).alias("page"),
        F.coalesce(o["summary"], o["text"], o["name"], o["source_text"]).alias("text"),
        F.col("aspect").alias("extraction_field"))


def replace_generated(
    processed: DataFrame, claims: DataFrame, methods: DataFrame, aspects: DataFrame, evidence: DataFrame,
    objects: DataFrame,
) -> dict[str, DataFrame]:
    """Tables after re-reading the `processed` works (work_id, version_id).

    Their generated claims, methods, aspects and field evidence are replaced; what people wrote stays.
    """
    works = processed.select("work_id").distinct()
    versions = processed.select("version_id").distinct()
    generated = F.col("source") == "ai_candidate"

    def keep(df):
        return df.where(~generated).unionByName(df.where(generated).join(works, "work_id", "left_anti"))

    kept_claims = keep(claims)
    gone_claims = claims.where(generated).join(works, "work_id", "left_semi").select("claim_id")
    is_field = F.col("relation_id").isNull() & F.col("claim_id").isNull() & F.col("extraction_field").isNotNull()
    kept_evidence = (
        evidence.where(~is_field).unionByName(evidence.where(is_field).join(versions, "version_id", "left_anti"))
        .join(gone_claims, "claim_id", "left_anti")
    )
    new_methods, method_evidence = method_rows(objects)
    new_claims, claim_evidence = claim_rows(objects)
    fresh_evidence = (
        field_evidence(objects).unionByName(method_evidence).unionByName(claim_evidence, allowMissingColumns=True)
    )
    as_text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    return {
        "claims": as_text(kept_claims, "claim_id").unionByName(new_claims, allowMissingColumns=True),
        "methods": as_text(keep(methods), "method_id").unionByName(new_methods, allowMissingColumns=True),
        "aspects": aspects.join(works, "work_id", "left_anti").unionByName(aspect_rows(objects), allowMissingColumns=True),
        "evidence": as_text(kept_evidence, "claim_id").unionByName(fresh_evidence, allowMissingColumns=True),
    }


def claims_and_methods(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The other output layout: lists of claims and methods, each with its own quote and page >= 1."""
    parsed = outputs.select(
        "work_id", "version_id", F.from_json(tf.lenient_json(F.col("raw")), schemas.CLAIM_METHOD_JSON).alias("o"))
    item = F.col("item")
    quoted = (_text(item["source_text"]) != "") & (F.coalesce(item["page"], F.lit(0)) >= 1)
    listed = lambda field: parsed.select("work_id", "version_id", F.posexplode(F.col(f"o.{field}")).alias("item_no", "item"))
    claims = listed("claims").where((_text(item["text"]) != "") & quoted).select(
        "work_id", "version_id", "item_no", item["text"].alias("text"), item["source_text"].alias("source_text"),
        item["page"].alias("page"), F.lit("claim").alias("extraction_field"))
    methods = listed("methods").where((_text(item["name"]) != "") & quoted).select(
        "work_id", "version_id", "item_no", item["name"].alias("name"), _text(item["description"]).alias("description"),
        item["source_text"].alias("source_text"), item["page"].alias("page"),
        F.concat(F.lit("method:"), item["name"]).alias("extraction_field"))
    return claims, methods


def refresh_citations(outputs: DataFrame, citations: DataFrame, versions: DataFrame) -> DataFrame:
    """Citations after the reference lists of `outputs` replaced those of their works."""
    parsed = F.from_json(tf.lenient_json(F.col("raw")), schemas.aspect_json(tx.ASPECTS))
    lists = outputs.select("work_id", parsed["references"].alias("references")).where("references IS NOT NULL")
    fresh = resolve_citations(clean_references(lists), versions).drop("position")
    return replace_citations(citations, lists, fresh)


def triage_results(requested: DataFrame, results: DataFrame) -> DataFrame:
    """Outcome of every requested id: missing, provider error, no message, no text, invalid JSON or ok.

    `results`: custom_id, error, message (JSON or null), text.
    """
    found = results.withColumn("_found", F.lit(True))
    outcome = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("error").isNotNull(), "provider error")
        .when(F.col("message").isNull(), "no message")
        .when(F.col("text").isNull(), "no text")
        .when(~tf.is_json(F.col("text")), "invalid JSON")
        .otherwise("ok")
    )
    return requested.join(found, "custom_id", "left").withColumn("outcome", outcome).drop("_found")


def rerun_list(works: DataFrame) -> DataFrame:
    """An extraction job for every work with a primary version."""
    payload = F.to_json(F.struct(F.col("primary_version_id").alias("version_id"), "work_id"))
    return works.where("primary_version_id IS NOT NULL").select(
        F.lit("extract_dna").alias("kind"), payload.alias("payload"), F.lit("queued").alias("status"))
