"""F: votes, status, team state."""

from pyspark.sql import functions as F

from evgraph.operators import consensus as con
from evgraph.plans.registry import query


@query("f1_latest_reviews", "SELECT subject_id, user_id, review_id, verdict FROM reviews")
def _(t):
    return con.latest_reviews(t.reviews_raw).select("subject_id", "user_id", "review_id", "verdict")


@query("f2_relation_status", "SELECT relation_id, review_status FROM relations")
def _(t):
    start = t.relations_raw.withColumn("review_status", F.lit("unreviewed"))
    return con.apply_status(start, con.relation_status(t.reviews)).select("relation_id", "review_status")


_OVERRIDES = """
    SELECT event_id AS oid, ((event_id * 11 + user_id) % ((SELECT count(*) FROM orders) // 5)) AS subject_id, user_id,
           ['confirmed', 'rejected', 'unreviewed', 'disputed', 'confirmed'][event_id % 5 + 1] AS status, ts,
           event_id + 10000000 AS rid FROM events"""


def _overrides(t):
    from evgraph.sources.bindings import pick

    n = F.floor(t.size("orders") / 5)
    return t.raw("events").select(
        ((F.col("event_id") * 11 + F.col("user_id")) % n).alias("subject_id"), "user_id",
        pick(["confirmed", "rejected", "unreviewed", "disputed", "confirmed"], F.col("event_id") % 5).alias("status"),
        F.col("ts").alias("created_at"), (F.col("event_id") + 10_000_000).alias("review_id"))


@query("f3_status_overrides", f"""
    WITH ov AS ({_OVERRIDES}),
    log AS (SELECT subject_id, user_id, verdict AS what, created_at AS ts, review_id AS rid, 'vote' AS k FROM reviews_raw
            UNION ALL SELECT subject_id, user_id, CASE status WHEN 'confirmed' THEN 'agree' WHEN 'rejected' THEN 'disagree' ELSE status END,
                ts, rid, CASE WHEN status IN ('confirmed', 'rejected') THEN 'vote' ELSE 'mark' END FROM ov),
    num AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts, rid) AS i FROM log),
    mk AS (SELECT subject_id, max(CASE WHEN what = 'unreviewed' THEN i END) AS cleared,
                  max(CASE WHEN what = 'disputed' THEN i END) AS held FROM num GROUP BY 1),
    live AS (SELECT n.* FROM num n JOIN mk USING (subject_id) WHERE k = 'vote' AND i > coalesce(cleared, 0)
             QUALIFY row_number() OVER (PARTITION BY n.subject_id, user_id ORDER BY i DESC) = 1),
    fin AS (SELECT subject_id, bool_or(what = 'agree') AS ag, bool_or(what = 'disagree') AS di, max(i) AS last FROM live GROUP BY 1)
    SELECT subject_id, CASE WHEN coalesce(held, 0) > coalesce(last, 0) AND coalesce(held, 0) > coalesce(cleared, 0) THEN 'disputed'
        WHEN ag AND di THEN 'disputed' WHEN di THEN 'rejected' WHEN ag THEN 'confirmed' ELSE 'unreviewed' END AS review_status
    FROM mk LEFT JOIN fin USING (subject_id)""")
def _(t):
    return con.override_status(t.reviews_raw, _overrides(t))


_VOTED = """
    SELECT subject_id, count(*) FILTER (verdict = 'agree') AS agrees, count(*) FILTER (verdict = 'disagree') AS disagrees
    FROM judgment_reviews GROUP BY 1"""


@query("f4_judgment_disputes", f"""
    SELECT j.judgment_id, j.claim_id, j.verdict, coalesce(agrees, 0) AS agrees, coalesce(disagrees, 0) AS disagrees,
           coalesce(agrees > 0 AND disagrees > 0, false) AS disputed
    FROM claim_judgments j LEFT JOIN ({_VOTED}) v ON v.subject_id = j.judgment_id""")
def _(t):
    out = con.judgment_disputes(t.claim_judgments, t.judgment_reviews)
    return out.select("judgment_id", "claim_id", "verdict", "agrees", "disagrees", "disputed")


@query("f5_claim_disputes", f"""
    SELECT c.claim_id, CASE WHEN c.claim_id IN (
        SELECT j.claim_id FROM claim_judgments j JOIN ({_VOTED}) v ON v.subject_id = j.judgment_id
        WHERE agrees > 0 AND disagrees > 0) THEN 'disputed' ELSE review_status END AS review_status FROM claims c""")
def _(t):
    out = con.propagate_claim_disputes(t.claims, t.claim_judgments, t.judgment_reviews)
    return out.select("claim_id", "review_status")


@query("f6_reading_state", "SELECT user_id, work_id, status, starred FROM reading_status")
def _(t):
    out = con.upsert_reading(t.reading_raw, ["updated_at", "event_id"])
    return out.select("user_id", "work_id", "status", "starred")


_SELECTIONS = r"""
    SELECT conv_id * 1000 + turn AS sid, conv_id AS work_id, conv_id * 2 AS version_id, conv_id % 7 AS user_id,
           CASE WHEN turn = 3 THEN ' ' ELSE text END AS claim_text, CASE WHEN role = 'user' THEN text ELSE '  ' END AS source_text,
           turn AS page FROM conversations"""


@query("f7_promoted_claims", f"""
    SELECT sha256('claim|' || sid)[:32] AS claim_id, work_id, user_id, md5(claim_text) AS text_md5,
           CASE WHEN trim(source_text) <> '' THEN sha256('evidence|' || sid)[:32] END AS evidence_id
    FROM ({_SELECTIONS}) WHERE trim(claim_text) <> ''""")
def _(t):
    c = F.col
    selections = t.raw("conversations").select(
        (c("conv_id") * 1000 + c("turn")).alias("selection_id"), c("conv_id").alias("work_id"),
        (c("conv_id") * 2).alias("version_id"), (c("conv_id") % 7).alias("user_id"),
        F.when(c("turn") == 3, " ").otherwise(c("text")).alias("claim_text"),
        F.when(c("role") == "user", c("text")).otherwise("  ").alias("source_text"), c("turn").alias("page"))
    claims, evidence = con.promote_selections(selections)
    return claims.join(evidence.select("claim_id", "evidence_id"), "claim_id", "left").select(
        "claim_id", "work_id", F.col("created_by").alias("user_id"), F.md5("text").alias("text_md5"), "evidence_id")
