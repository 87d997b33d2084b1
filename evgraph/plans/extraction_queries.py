"""H and J: extracted rows, gold checks."""

from pyspark.sql import functions as F

from evgraph.operators import evaluation, extraction
from evgraph.plans import derived
from evgraph.plans.oracle_views import VIEWS, in_list
from evgraph import taxonomy as tx
from evgraph.plans.ingest_queries import _REFERENCES
from evgraph.plans.registry import query
from evgraph.sources import gold as gold_source

VIEWS |= {
    "aspect_objects": """
        SELECT *, regexp_replace(summary, '^\\s+|\\s+$', '', 'g') AS head FROM aspect_raw""",
    "bulleted": """
        SELECT work_id, version_id, aspect, head, source_text, page, i - 1 AS item_no, items[i] AS item FROM (
            SELECT *, generate_subscripts(items, 1) AS i FROM (
                SELECT *, CASE WHEN len(bullets) > 0
                    THEN list_filter(list_transform(bullets, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')
                    WHEN head <> '' THEN [CASE aspect WHEN 'methods' THEN head[1:120] ELSE head END] ELSE [] END AS items
                FROM aspect_objects))""",
}


def objects(t):
    return extraction.aspect_objects(t.document_dna)


@query("h1_aspect_rows", """
    SELECT work_id, aspect, md5(head) AS summary_md5, len(bullets)::INTEGER AS n_bullets, md5(array_to_string(bullets, '|')) AS bullets_md5,
           source_text, page FROM aspect_objects""")
def _(t):
    return extraction.aspect_rows(objects(t)).select(
        "work_id", "aspect", F.md5("summary").alias("summary_md5"), F.size("bullets").alias("n_bullets"),
        F.md5(F.array_join("bullets", "|")).alias("bullets_md5"), "source_text", "page")


@query("h2_method_rows", """
    SELECT sha256('method|' || version_id || '|' || item_no)[:32] AS method_id, work_id, md5(item) AS name_md5,
           md5(CASE WHEN item = head THEN '' ELSE head END) AS description_md5 FROM bulleted WHERE aspect = 'methods'""")
def _(t):
    methods, _ = extraction.method_rows(objects(t))
    return methods.select("method_id", "work_id", F.md5("name").alias("name_md5"), F.md5("description").alias("description_md5"))


@query("h2_method_evidence", """
    SELECT version_id, page, source_text AS text, md5('method:' || item) AS field_md5 FROM bulleted
    WHERE aspect = 'methods' AND source_text <> ''""")
def _(t):
    _, evidence = extraction.method_rows(objects(t))
    return evidence.select("version_id", "page", "text", F.md5("extraction_field").alias("field_md5"))


@query("h3_claim_rows", """
    SELECT sha256('claim|' || version_id || '|' || item_no)[:32] AS claim_id, work_id, md5(item) AS text_md5,
           CASE WHEN source_text <> '' THEN source_text END AS quote FROM bulleted WHERE aspect = 'findings'""")
def _(t):
    claims, evidence = extraction.claim_rows(objects(t))
    quotes = evidence.select("claim_id", F.col("text").alias("quote"))
    return claims.join(quotes, "claim_id", "left").select("claim_id", "work_id", F.md5("text").alias("text_md5"), "quote")


@query("h4_field_evidence", """
    SELECT version_id, page, md5(summary) AS text_md5, aspect AS extraction_field FROM aspect_raw WHERE source_text <> ''""")
def _(t):
    rows = extraction.field_evidence(objects(t))
    return rows.select("version_id", "page", F.md5("text").alias("text_md5"), "extraction_field")


@query("h5_replaced_rows", """
    SELECT 'claims' AS name, work_id, md5(text) AS what FROM claims WHERE source <> 'ai_candidate' OR work_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'claims', work_id, md5(item) FROM bulleted WHERE aspect = 'findings'
    UNION ALL SELECT 'methods', work_id, md5(item) FROM bulleted WHERE aspect = 'methods'
    UNION ALL SELECT 'methods', c_custkey, md5(c_name) FROM customer WHERE c_custkey % 2 = 0 OR c_custkey NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'aspects', work_id, md5(head) FROM aspect_objects
    UNION ALL SELECT 'evidence', version_id, md5(text) FROM evidence WHERE claim_id IS NULL OR claim_id NOT IN (
        SELECT claim_id FROM claims WHERE source = 'ai_candidate' AND work_id IN (SELECT doc_id FROM documents))
    UNION ALL SELECT 'evidence', version_id, md5(summary) FROM aspect_raw WHERE source_text <> ''
    UNION ALL SELECT 'evidence', version_id, md5(source_text) FROM bulleted WHERE aspect IN ('methods', 'findings') AND source_text <> ''""")
def _(t):
    obj = objects(t)
    methods = t.raw("customer").select(
        F.col("c_custkey").alias("method_id"), F.col("c_custkey").alias("work_id"), F.col("c_name").alias("name"),
        F.lit("").alias("description"),
        F.when(F.col("c_custkey") % 2 == 0, "team_record").otherwise("ai_candidate").alias("source"),
        F.lit("confirmed").alias("review_status"))
    aspects = extraction.aspect_rows(obj)
    out = extraction.replace_generated(
        t.document_dna.select("work_id", "version_id"), t.claims, methods, aspects, t.evidence, obj)
    row = lambda name, key, c: out[name].select(F.lit(name).alias("name"), F.col(key).alias("work_id"), F.md5(c).alias("what"))
    return (
        row("claims", "work_id", "text").unionByName(row("methods", "work_id", "name"))
        .unionByName(row("aspects", "work_id", "summary")).unionByName(row("evidence", "version_id", "text"))
    )


@query("h6_claims_and_methods", """
    WITH l AS (SELECT doc_id, lang, source, i, ls[i + 1] AS s FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents) d,
        range(0, 20000) r(i) WHERE i < len(ls))
    SELECT doc_id AS work_id, 'claim' AS kind, i::INTEGER AS item_no, md5(s) AS text_md5, (i % 4)::INTEGER AS page FROM l
        WHERE s <> '' AND i % 3 <> 0 AND i % 4 >= 1
    UNION ALL SELECT doc_id, 'method', i::INTEGER, md5(s), (i % 2)::INTEGER FROM l WHERE i % 5 <> 0 AND s <> '' AND i % 2 >= 1""")
def _(t):
    claims, methods = extraction.claims_and_methods(derived.claim_method_outputs(t))
    row = lambda df, kind, c: df.select("work_id", F.lit(kind).alias("kind"), "item_no", F.md5(c).alias("text_md5"), "page")
    return row(claims, "claim", "text").unionByName(row(methods, "method", "name"))


@query("h7_replaced_citations", f"""
    SELECT citing_work_id, cited_work_id::VARCHAR AS cited_work_id, false AS external FROM citations
        WHERE citing_work_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT r.work_id, CASE WHEN r.arxiv_id IS NOT NULL THEN a.work_id ELSE d.work_id END::VARCHAR,
           CASE WHEN r.arxiv_id IS NOT NULL THEN a.work_id ELSE d.work_id END IS NULL
    FROM ({_REFERENCES}) r LEFT JOIN versions a ON a.arxiv_id = r.arxiv_id LEFT JOIN versions d ON d.doi = r.doi""")
def _(t):
    out = extraction.refresh_citations(t.document_dna, t.citations, t.versions)
    return out.select(
        "citing_work_id", F.col("cited_work_id").cast("string").alias("cited_work_id"),
        F.col("cited_external").isNotNull().alias("external"))


@query("h8_result_triage", """
    SELECT event_id AS custom_id, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_type = 'error' THEN 'provider error'
        WHEN event_id % 5 = 0 THEN 'no message' WHEN event_id % 11 = 0 THEN 'no text' WHEN event_id % 3 = 0 THEN 'invalid JSON' ELSE 'ok' END AS outcome
    FROM events""")
def _(t):
    key = F.col("event_id")
    results = t.raw("events").where(key % 7 != 0).select(
        key.alias("custom_id"), F.when(F.col("event_type") == "error", "overloaded").alias("error"),
        F.when(key % 5 != 0, "{}").alias("message"),
        F.when(key % 11 != 0, F.when(key % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("text"))
    requested = t.raw("events").select(key.alias("custom_id"))
    return extraction.triage_results(requested, results).select("custom_id", "outcome")


@query("h9_rerun_list", """
    SELECT 'extract_dna' AS kind, '{"version_id":' || primary_version_id || ',"work_id":' || work_id || '}' AS payload, 'queued' AS status FROM works""")
def _(t):
    return extraction.rerun_list(t.works)


_KNOWN = in_list(tx.RELATION_TYPES)


@query("j1_gold_errors", f"""
    SELECT name, 'missing arxiv_id' AS error, NULL AS value FROM gold WHERE arxiv_id IS NULL
    UNION ALL SELECT name, 'claim missing text', NULL FROM gold WHERE k % 3 = 0
    UNION ALL SELECT name, 'method missing name', NULL FROM gold WHERE k % 5 = 0
    UNION ALL SELECT name, 'invalid relation type', type FROM gold_relations WHERE type NOT IN {_KNOWN}
    UNION ALL SELECT name, 'relation missing target_arxiv', NULL FROM gold_relations WHERE target_arxiv = ''
    UNION ALL SELECT name, 'invalid cite gold_type', 'none' FROM gold WHERE k % 4 = 2""")
def _(t):
    return evaluation.gold_errors(gold_source.parse_gold(derived.gold(t)))


@query("j1_gold_counts", """
    SELECT count(*) AS papers, 2 * count(*) AS claims, count(*) AS methods, 2 * count(*) AS relations,
           count(*) FILTER (k % 2 = 0) AS contexts FROM gold""")
def _(t):
    return evaluation.gold_counts(gold_source.parse_gold(derived.gold(t)))


VIEWS["coverage"] = """
    WITH known AS (SELECT arxiv_id, work_id FROM versions WHERE arxiv_id IS NOT NULL),
    ex AS (SELECT DISTINCT r.type, s.anchor_work_id AS a, x.anchor_work_id AS b FROM relations_raw r
           JOIN relation_members s ON s.relation_id = r.relation_id AND s.role = 'source'
           JOIN relation_members x ON x.relation_id = r.relation_id AND x.role = 'target')
    SELECT g.name, g.item_no, g.type, g.target_arxiv, CASE WHEN t.work_id IS NULL THEN 'target unknown'
           WHEN ex.type IS NOT NULL THEN 'hit' ELSE 'not found' END AS outcome
    FROM gold_relations g JOIN known s ON s.arxiv_id = g.arxiv_id LEFT JOIN known t ON t.arxiv_id = g.target_arxiv
    LEFT JOIN ex ON ex.type = g.type AND ex.a = s.work_id AND ex.b = t.work_id"""


def coverage(t):
    parsed = gold_source.parse_gold(derived.gold(t))
    return evaluation.relation_coverage(parsed, t.versions, t.relations_raw, t.relation_members)


@query("j2_relation_coverage", "SELECT * FROM coverage")
def _(t):
    return coverage(t)


@query("j2_coverage_summary", "SELECT count(*) FILTER (outcome = 'hit') AS hits, count(*) AS total FROM coverage")
def _(t):
    return evaluation.coverage_summary(coverage(t))
