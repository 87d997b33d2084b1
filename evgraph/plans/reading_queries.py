"""D: listings, access scope, comments."""

from pyspark.sql import functions as F

from evgraph.operators import reads
from evgraph.plans.oracle_views import VIEWS
from evgraph.plans.registry import query

VIEWS |= {
    "titled": """
        SELECT w.work_id, coalesce(v.title, w.title_norm) AS title, v.year, v.arxiv_id, w.title_norm, w.created_at
        FROM works w LEFT JOIN versions v ON v.version_id = w.primary_version_id""",
    "work_authors": """
        SELECT w.work_id, x.position, x.author_id, a.full_name FROM works w
        JOIN version_authors x ON x.version_id = w.primary_version_id JOIN authors a ON a.author_id = x.author_id""",
    "work_evidence": """
        SELECT DISTINCT w.work_id, e.* FROM evidence e JOIN (
            SELECT e.evidence_id, v.work_id FROM evidence e JOIN versions v ON v.version_id = e.version_id
            UNION SELECT e.evidence_id, c.work_id FROM evidence e JOIN claims c ON c.claim_id = e.claim_id
            UNION SELECT e.evidence_id, m.anchor_work_id FROM evidence e JOIN relation_members m ON m.relation_id = e.relation_id
                WHERE m.anchor_work_id IS NOT NULL) w ON w.evidence_id = e.evidence_id""",
    "work_relations": """
        SELECT DISTINCT m.work_id, r.* FROM relations r JOIN (
            SELECT relation_id, anchor_work_id AS work_id FROM relation_members WHERE anchor_work_id IS NOT NULL
            UNION SELECT relation_id, entity_id FROM relation_members WHERE entity_kind = 'work') m
            ON m.relation_id = r.relation_id WHERE r.type <> 'cites'""",
    "work_jobs": """
        SELECT DISTINCT work_id, job_id, kind FROM (
            SELECT w.work_id, j.job_id, j.kind FROM jobs j JOIN works w ON w.work_id = j.k_work
            UNION ALL SELECT v.work_id, j.job_id, j.kind FROM jobs j JOIN versions v ON v.version_id = j.k_version)""",
}

LISTING_RANK = "CASE review_status WHEN 'confirmed' THEN 0 WHEN 'disputed' THEN 1 WHEN 'unreviewed' THEN 2 ELSE 3 END"


@query("d1_work_search", """
    SELECT work_id, title, year, arxiv_id FROM titled
    WHERE title_norm ILIKE '%RING%' OR title ILIKE '%RING%' OR arxiv_id ILIKE '%RING%'""")
def _(t):
    hits = reads.search_works(t.works, t.versions, "RING", limit=None)
    return hits.select("work_id", "title", "year", "arxiv_id")


@query("d1_work_search_page", """
    SELECT work_id, title, year, arxiv_id FROM titled WHERE (title_norm ILIKE '%1000.0%' OR title ILIKE '%1000.0%' OR arxiv_id ILIKE '%1000.0%')
        AND work_id IN (SELECT work_id FROM work_projects WHERE project_id = 7)
    ORDER BY created_at DESC LIMIT 50 OFFSET 10""")
def _(t):
    hits = reads.search_works(t.works, t.versions, "1000.0", t.work_projects, 7, offset=10)
    return hits.select("work_id", "title", "year", "arxiv_id")


@query("d1_work_search_authors", """
    WITH page AS (SELECT * FROM titled WHERE title_norm ILIKE '%RING%' OR title ILIKE '%RING%' OR arxiv_id ILIKE '%RING%'
        ORDER BY created_at DESC, work_id DESC LIMIT 200)
    SELECT p.work_id, p.title, coalesce(string_agg(full_name, '; ' ORDER BY position, author_id), '') AS authors
    FROM page p LEFT JOIN work_authors a ON a.work_id = p.work_id GROUP BY 1, 2""")
def _(t):
    page = reads.with_author_names(reads.search_works(t.works, t.versions, "RING", limit=200), t.version_authors, t.authors)
    return page.select("work_id", "title", F.array_join("authors", "; ").alias("authors"))


@query("d2_cards_without_primary", """
    SELECT w.work_id, coalesce(v.title, w.title_norm) AS title, v.year::VARCHAR AS year, (SELECT count(*) FROM version_authors x WHERE x.version_id = v.version_id) AS authors
    FROM works w LEFT JOIN versions v ON v.version_id = CASE WHEN w.work_id % 3 <> 0 THEN w.primary_version_id
        ELSE (SELECT arg_min(y.version_id, y.created_at) FROM versions y WHERE y.work_id = w.work_id AND (w.work_id % 2 = 0 OR y.kind = 'journal')) END""")
def _(t):
    """Every third work has no primary version; half of these keep only their journal version, if any."""
    works = t.works.withColumn("primary_version_id", F.when(F.col("work_id") % 3 != 0, F.col("primary_version_id")))
    lost = (F.col("work_id") % 3 == 0) & (F.col("work_id") % 2 != 0) & (F.col("kind") != "journal")
    shown = reads.with_shown_version(works, t.versions.where(~lost))
    counted = reads.work_authors(shown, t.version_authors, t.authors).groupBy("work_id").agg(F.count("*").alias("authors"))
    out = reads.titled_works(shown, t.versions).join(counted, "work_id", "left")
    return out.select("work_id", "title", F.col("year").cast("string").alias("year"), F.coalesce("authors", F.lit(0).cast("long")).alias("authors"))


@query("d2_work_cards", """
    SELECT w.work_id, w.title, coalesce(m.n, 0) AS methods, coalesce(s.n, 0) AS aspects, coalesce(o.n, 0) AS annotations, coalesce(a.n, 0) AS versions, coalesce(b.n, 0) AS authors, coalesce(c.n, 0) AS projects,
           coalesce(d.n, 0) AS claims, coalesce(e.n, 0) AS reading, coalesce(f.n, 0) AS evidence,
           coalesce(g.n, 0) AS relations, coalesce(h.n, 0) AS jobs
    FROM titled w
    LEFT JOIN (SELECT work_id, count(*) AS n FROM versions GROUP BY 1) a ON a.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM work_authors GROUP BY 1) b ON b.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM work_projects GROUP BY 1) c ON c.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM claims GROUP BY 1) d ON d.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM methods GROUP BY 1) m ON m.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM paper_aspects GROUP BY 1) s ON s.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM annotations GROUP BY 1) o ON o.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM reading_status GROUP BY 1) e ON e.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM work_evidence GROUP BY 1) f ON f.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM work_relations GROUP BY 1) g ON g.work_id = w.work_id
    LEFT JOIN (SELECT work_id, count(*) AS n FROM work_jobs GROUP BY 1) h ON h.work_id = w.work_id""")
def _(t):
    return reads.work_cards(t).select(
        "work_id", "title", "versions", "authors", "projects", "claims", "methods", "aspects", "reading", "annotations", "evidence",
        "relations", "jobs")


@query("d2_card_sections", f"""
    SELECT work_id, 'version' AS section, created_at::VARCHAR AS sort_key, version_id::VARCHAR AS item_id, md5(title) AS label FROM versions
    UNION ALL SELECT work_id, 'author', position::VARCHAR, author_id::VARCHAR, md5(full_name) FROM work_authors
    UNION ALL SELECT x.work_id, 'project', p.name, p.project_id::VARCHAR, md5(p.name) FROM work_projects x JOIN projects p USING (project_id)
    UNION ALL SELECT work_id, 'claim', claim_id::VARCHAR, claim_id::VARCHAR, md5(text) FROM claims
    UNION ALL SELECT work_id, 'method', method_id::VARCHAR, method_id::VARCHAR, md5(name) FROM methods
    UNION ALL SELECT work_id, 'aspect', aspect, aspect, md5(summary) FROM paper_aspects
    UNION ALL SELECT work_id, 'reading', '', user_id::VARCHAR, md5(status) FROM reading_status
    UNION ALL SELECT work_id, 'evidence', page::VARCHAR, evidence_id::VARCHAR, md5(text) FROM work_evidence
    UNION ALL SELECT work_id, 'relation', ({LISTING_RANK})::VARCHAR, relation_id::VARCHAR, md5(type) FROM work_relations
    UNION ALL SELECT work_id, 'job', job_id::VARCHAR, job_id::VARCHAR, md5(kind) FROM work_jobs""")
def _(t):
    rows = reads.card_sections(t)
    sort = F.when(F.col("section") == "reading", "").otherwise(F.col("sort_key"))
    return rows.select("work_id", "section", sort.alias("sort_key"), "item_id", F.md5("label").alias("label"))


@query("d3_versions_with_authors", """
    SELECT v.work_id, v.version_id, v.title, x.position::VARCHAR AS position, a.full_name FROM versions v
    LEFT JOIN (version_authors x JOIN authors a ON a.author_id = x.author_id) ON x.version_id = v.version_id""")
def _(t):
    rows = reads.version_authors_listed(t.versions, t.version_authors, t.authors)
    return rows.select("work_id", "version_id", "title", F.col("position").cast("string").alias("position"), "full_name")


@query("d4_claims_with_parts", """
    WITH v AS (SELECT subject_id, bool_or(verdict = 'agree') AND bool_or(verdict = 'disagree') AS d FROM judgment_reviews GROUP BY 1),
    parts AS (SELECT claim_id, 'evidence' AS part, evidence_id AS part_id, md5(text) AS detail FROM evidence WHERE claim_id IS NOT NULL
        UNION ALL SELECT claim_id, 'judgment', judgment_id, md5(verdict || CASE WHEN d THEN ' disputed' ELSE '' END)
        FROM claim_judgments LEFT JOIN v ON subject_id = judgment_id)
    SELECT c.work_id, c.claim_id, part, part_id, detail FROM claims c LEFT JOIN parts p ON p.claim_id = c.claim_id""")
def _(t):
    rows = reads.claims_listed(t.claims, t.evidence, t.claim_judgments, t.judgment_reviews)
    return rows.select("work_id", "claim_id", "part", "part_id", F.md5("detail").alias("detail"))


@query("d5_evidence_of_works", "SELECT work_id, evidence_id, page, md5(text) AS text_md5 FROM work_evidence")
def _(t):
    rows = reads.evidence_of_works(t.evidence, t.versions, t.claims, t.relation_members)
    return rows.select("work_id", "evidence_id", "page", F.md5("text").alias("text_md5"))


@query("d6_evidence_by_key", """
    SELECT 'claim_id' AS bound_by, claim_id::VARCHAR AS key, evidence_id FROM evidence WHERE claim_id IS NOT NULL
    UNION ALL SELECT 'version_id', version_id::VARCHAR, evidence_id FROM evidence
    UNION ALL SELECT 'relation_id', relation_id::VARCHAR, evidence_id FROM evidence WHERE relation_id IS NOT NULL
    UNION ALL SELECT 'extraction_field', extraction_field, evidence_id FROM evidence WHERE extraction_field IS NOT NULL""")
def _(t):
    out = None
    for key in ("claim_id", "version_id", "relation_id", "extraction_field"):
        rows = reads.evidence_by(t.evidence, key).select(F.lit(key).alias("bound_by"), F.col(key).cast("string").alias("key"), "evidence_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("d7_relation_details", """
    WITH parts AS (
        SELECT relation_id, 'member' AS part, position::VARCHAR AS sort_key, entity_id::VARCHAR AS part_id, role || ' ' || entity_kind AS detail FROM relation_members
        UNION ALL SELECT relation_id, 'evidence', page::VARCHAR, evidence_id::VARCHAR, text FROM evidence WHERE relation_id IS NOT NULL
        UNION ALL SELECT subject_id, 'review', epoch_us(created_at)::VARCHAR, review_id::VARCHAR, verdict FROM reviews)
    SELECT r.relation_id, r.type, r.review_status, part, sort_key, part_id, detail
    FROM relations r LEFT JOIN parts p ON p.relation_id = r.relation_id""")
def _(t):
    return reads.relation_details(t.relations, t.relation_members, t.evidence, t.reviews)


@query("d10_project_coverage", """
    SELECT x.project_id, x.work_id, w.title, u.user_id::VARCHAR AS user_id, u.name AS reader, r.status, r.starred::VARCHAR AS starred
    FROM work_projects x JOIN titled w ON w.work_id = x.work_id
    LEFT JOIN (reading_status r JOIN users u ON u.user_id = r.user_id AND r.status <> 'unread') ON r.work_id = x.work_id""")
def _(t):
    rows = reads.project_coverage(t.projects, t.work_projects, t.works, t.versions, t.reading_status, t.users)
    s = lambda c: F.col(c).cast("string").alias(c)
    return rows.select("project_id", "work_id", "title", s("user_id"), "reader", "status", s("starred"))


@query("d11_projects_of_works", "SELECT work_id, project_id, name FROM work_projects JOIN projects USING (project_id)")
def _(t):
    return reads.projects_of_works(t.projects, t.work_projects).select("work_id", "project_id", "name")


@query("d12_groups_of_users", """
    SELECT m.user_id, m.group_id, g.name, m.role, s.n AS members, coalesce(x.n, 0) AS graphs
    FROM group_members m JOIN groups_ g USING (group_id)
    JOIN (SELECT group_id, count(*) AS n FROM group_members GROUP BY 1) s USING (group_id)
    LEFT JOIN (SELECT group_id, count(*) AS n FROM graphs GROUP BY 1) x USING (group_id)""")
def _(t):
    rows = reads.groups_of_users(t.groups, t.group_members, t.graphs)
    return rows.select("user_id", "group_id", "name", "role", "members", "graphs")


@query("d13_graphs_of_groups", """
    SELECT g.group_id, g.name AS group_name, x.graph_id, x.name AS graph_name, coalesce(n.n, 0) AS works
    FROM groups_ g LEFT JOIN graphs x USING (group_id)
    LEFT JOIN (SELECT graph_id, count(*) AS n FROM graph_works GROUP BY 1) n USING (graph_id)""")
def _(t):
    rows = reads.graphs_of_groups(t.groups, t.graphs, t.graph_works)
    return rows.select("group_id", "group_name", "graph_id", "graph_name", "works")


@query("d13_group_members", "SELECT group_id, user_id, role, name FROM group_members JOIN users USING (user_id)")
def _(t):
    return reads.members_listed(t.group_members, t.users).select("group_id", "user_id", "role", "name")


@query("d14_reading_of_works", "SELECT user_id, work_id, status, starred FROM reading_status")
def _(t):
    return reads.reading_listed(t.reading_status).select("user_id", "work_id", "status", "starred")


@query("d15_visible_annotations", """
    SELECT work_id, comment_id AS annotation_id FROM node_comments WHERE visibility = 'team' OR user_id = 3""")
def _(t):
    notes = t.node_comments.withColumnRenamed("comment_id", "annotation_id")
    return reads.visible_to(notes, 3).select("work_id", "annotation_id")


@query("d15_annotation_counts", "SELECT work_id, count(*) AS annotations FROM annotations GROUP BY 1")
def _(t):
    return reads.annotation_counts(t.annotations)


@query("d16_comments_with_authors", """
    SELECT c.graph_id, c.work_id, c.comment_id, u.name AS author_name, c.created_at
    FROM node_comments c JOIN users u ON u.user_id = c.user_id WHERE c.visibility = 'team' OR c.user_id = 3""")
def _(t):
    rows = reads.comments_with_authors(t.node_comments, t.users, 3)
    return rows.select("graph_id", "work_id", "comment_id", "author_name", "created_at")


@query("d17_comments_since", """
    SELECT comment_id, kind FROM node_comments WHERE graph_id = 3 AND created_at > 20003 AND kind IN ('question', 'idea')
      AND (visibility = 'team' OR user_id = 3)""")
def _(t):
    rows = reads.filter_comments(t.node_comments, 3, 3, None, 20003, ["Question", "IDEA"], None, order="created_at")
    return rows.select("comment_id", "kind")


@query("d17_latest_comments", """
    SELECT comment_id, kind FROM node_comments WHERE kind IN ('question', 'idea') AND (visibility = 'team' OR user_id = 4)
    ORDER BY created_at DESC LIMIT 200""")
def _(t):
    rows = reads.filter_comments(t.node_comments, 4, kinds=["question", "idea"], order="created_at")
    return rows.select("comment_id", "kind")


@query("d18_comment_counts", """
    SELECT graph_id, work_id, count(*) AS comments FROM node_comments WHERE visibility = 'team' OR user_id = 3 GROUP BY 1, 2""")
def _(t):
    return reads.comment_counts(t.node_comments, 3)


@query("d19_validated_replies", """
    WITH new AS (SELECT doc_id AS comment_id, doc_id % 10 AS graph_id, doc_id % 120 AS work_id, doc_id % 7 AS user_id,
            CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'team' END AS visibility, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS body,
            CASE WHEN doc_id % 4 > 0 THEN (doc_id % 120) * 1000 + CASE WHEN doc_id % 9 = 0 THEN 1000 ELSE doc_id % 4 END END AS parent_id FROM documents),
    m AS (SELECT DISTINCT conv_id % 10 AS graph_id, conv_id AS work_id FROM conversations)
    SELECT n.comment_id, concat_ws(';', CASE WHEN trim(n.body) = '' THEN 'body required' END,
        CASE WHEN length(trim(n.body)) > 20000 THEN 'body too long' END,
        CASE WHEN m.work_id IS NULL THEN 'work not in graph' END,
        CASE WHEN n.parent_id IS NOT NULL AND (p.comment_id IS NULL OR p.visibility = 'private' AND p.user_id <> n.user_id) THEN 'unknown parent' END,
        CASE WHEN p.comment_id IS NOT NULL AND (p.graph_id <> n.graph_id OR p.work_id <> n.work_id) THEN 'parent elsewhere' END,
        CASE WHEN p.visibility = 'private' AND p.user_id = n.user_id AND n.visibility <> 'private' THEN 'reply must be private' END) AS reasons
    FROM new n LEFT JOIN m ON m.graph_id = n.graph_id AND m.work_id = n.work_id
    LEFT JOIN node_comments p ON p.comment_id = n.parent_id""")
def _(t):
    key = F.col("doc_id")
    other = (key % 120) * 1000 + F.when(key % 9 == 0, 1000).otherwise(key % 4)
    new = t.raw("documents").select(
        key.alias("comment_id"), (key % 10).alias("graph_id"), (key % 120).alias("work_id"), (key % 7).alias("user_id"),
        F.when(key % 3 == 0, "private").otherwise("team").alias("visibility"),
        F.when(key % 11 == 0, "  ").otherwise(F.col("text")).alias("body"), F.when(key % 4 > 0, other).alias("parent_id"))
    nodes = t.node_comments.select("graph_id", "work_id").distinct()
    rows = reads.validate_comments(new, t.node_comments, nodes)
    return rows.select("comment_id", F.array_join("reasons", ";").alias("reasons"))


@query("d20_graphs_visible_to_users", """
    SELECT m.user_id, g.graph_id FROM group_members m JOIN graphs g USING (group_id)""")
def _(t):
    return reads.graphs_visible_to_users(t.group_members, t.graphs)


@query("d20_accessible_works", """
    SELECT graph_id, work_id FROM graph_works WHERE graph_id IN (
        SELECT graph_id FROM graphs JOIN group_members USING (group_id) WHERE user_id = 5)""")
def _(t):
    return reads.accessible_works(t.graph_works, t.graphs, t.group_members, 5).select("graph_id", "work_id")


@query("d21_titles_of_set", """
    SELECT work_id, title, year FROM titled WHERE work_id IN (SELECT DISTINCT cited_work_id FROM citations)""")
def _(t):
    ids = t.citations.select(F.col("cited_work_id").alias("work_id")).distinct()
    return reads.titles_of(ids, t.works, t.versions)


@query("d22_jobs_of_works", "SELECT work_id, job_id, kind FROM work_jobs")
def _(t):
    return reads.jobs_of_works(t.jobs, t.works, t.versions).select("work_id", "job_id", "kind")


@query("d24_comment_threads", """
    WITH v AS (SELECT * FROM node_comments WHERE visibility = 'team' OR user_id = 3)
    SELECT r.graph_id, r.work_id, r.comment_id AS root_id, c.comment_id::VARCHAR AS reply_id FROM v r
    LEFT JOIN v c ON c.parent_id = r.comment_id WHERE r.parent_id IS NULL""")
def _(t):
    rows = reads.comment_threads(reads.visible_to(t.node_comments, 3))
    return rows.select("graph_id", "work_id", "root_id", F.col("reply_id").cast("string").alias("reply_id"))


@query("d25_patched_comments", """
    SELECT c.comment_id, md5(CASE WHEN ok AND b IS NOT NULL THEN trim(b) ELSE c.body END) AS body_md5,
           CASE WHEN ok AND k IS NOT NULL THEN k ELSE c.kind END AS kind
    FROM (SELECT *, user_id = work_id % 7 AND (b IS NULL OR trim(b) <> '') AND (b IS NOT NULL OR k IS NOT NULL) AS ok FROM (
        SELECT *, CASE created_at % 4 WHEN 0 THEN '  new ' || comment_id WHEN 1 THEN '   ' END AS b,
               CASE WHEN created_at % 2 = 1 THEN 'critique' END AS k FROM node_comments)) c""")
def _(t):
    c = F.col
    stored = t.node_comments.withColumn("updated_at", c("created_at"))
    patches = stored.select(
        "comment_id", (c("work_id") % 7).alias("user_id"),
        F.when(c("created_at") % 4 == 0, F.concat(F.lit("  new "), c("comment_id").cast("string")))
        .when(c("created_at") % 4 == 1, "   ").alias("new_body"),
        F.when(c("created_at") % 2 == 1, "critique").alias("new_kind"), F.lit(None).cast("string").alias("new_visibility"),
        c("created_at").alias("moment"))
    return reads.patch_comments(stored, patches).select("comment_id", F.md5("body").alias("body_md5"), "kind")


@query("d25_deleted_comments", """
    WITH gone AS (SELECT comment_id FROM node_comments WHERE user_id = work_id % 7 AND created_at % 3 = 0)
    SELECT comment_id, CASE WHEN parent_id NOT IN (SELECT comment_id FROM gone) THEN parent_id END::VARCHAR AS parent_id
    FROM node_comments WHERE comment_id NOT IN (SELECT comment_id FROM gone)""")
def _(t):
    c = F.col
    requests = t.node_comments.where(c("created_at") % 3 == 0).select("comment_id", (c("work_id") % 7).alias("user_id"))
    rows = reads.delete_own_comments(t.node_comments, requests)
    return rows.select("comment_id", c("parent_id").cast("string").alias("parent_id"))


@query("d25_deleted_annotations", """
    SELECT annotation_id, work_id FROM annotations QUALIFY NOT bool_or(annotation_id % 11 = 0 AND user_id = work_id % 7)
        OVER (PARTITION BY annotation_id // 40 ORDER BY annotation_id)""")
def _(t):
    """Forty annotations in a row are a thread: what follows a deleted one is below it."""
    key = F.col("annotation_id")
    requests = t.annotations.where(key % 11 == 0).select("annotation_id", (F.col("work_id") % 7).alias("user_id"))
    return reads.delete_own_annotations(t.annotations, requests).select("annotation_id", "work_id")
