"""The bindings of sources/bindings.py in SQL, used by the queries' reference statements."""

import re

from evgraph import taxonomy as tx


def words(items) -> str:
    return "[" + ", ".join(f"'{w}'" for w in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(f"'{w}'" for w in items) + ")"


def norm(c: str) -> str:
    kept = rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\s]', '', 'g')"
    return rf"trim(regexp_replace({kept}, '\s+', ' ', 'g'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def case(c: str, pairs, default) -> str:
    body = " ".join(f"WHEN {c} IN {in_list(v)} THEN {r}" for v, r in pairs)
    return f"CASE {body} ELSE {default} END"


HIGH = in_list(tx.HIGH_RISK)


def drawable(t: str, s: str) -> str:
    return f"{t} <> 'cites' AND {s} <> 'rejected' AND ({t} NOT IN {HIGH} OR {s} = 'confirmed')"


_ARXIV = "lpad((1000 + {k} // 100000)::VARCHAR, 4, '0') || '.' || lpad(({k} % 100000)::VARCHAR, 5, '0')"


def arxiv_of(k: str) -> str:
    return _ARXIV.format(k=k)


VIEWS = {
    "works": f"""
        SELECT p_partkey AS work_id, {norm('p_name')} AS title_norm, p_partkey * 2 AS primary_version_id,
               p_partkey AS created_at FROM part""",
    "versions": f"""
        SELECT p_partkey * 2 AS version_id, p_partkey AS work_id, 'arxiv' AS kind, {arxiv_of('p_partkey')} AS arxiv_id,
               NULL AS doi, p_name AS title, p_brand || ' ' || p_type AS abstract, 1990 + p_size AS year,
               p_brand AS venue_name, p_partkey * 2 AS created_at FROM part
        UNION ALL
        SELECT p_partkey * 2 + 1, p_partkey, 'journal', NULL, '10.1000/' || p_partkey, p_name || ' Extended',
               p_brand || ' ' || p_type, 1991 + p_size, p_brand, p_partkey * 2 + 1
        FROM part WHERE p_size % 3 = 0""",
    "authors": "SELECT s_suppkey AS author_id, s_name AS full_name FROM supplier",
    "version_authors": """
        SELECT l_partkey * 2 AS version_id, l_suppkey AS author_id, min(l_linenumber) AS position
        FROM lineitem GROUP BY 1, 2""",
    "projects": "SELECT DISTINCT split_part(p_brand, '#', 2)::BIGINT AS project_id, p_brand AS name FROM part",
    "work_projects": "SELECT p_partkey AS work_id, split_part(p_brand, '#', 2)::BIGINT AS project_id FROM part",
    "citations": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS citation_id,
               l_partkey AS citing_work_id, cited AS cited_work_id
        FROM (SELECT *, (l_orderkey * 31 + l_suppkey) % (SELECT count(*) FROM part) AS cited FROM lineitem)
        WHERE l_partkey <> cited""",
    "relations_raw": f"""
        SELECT o_orderkey AS relation_id, {words(tx.RELATION_TYPES)}[o_orderkey % 12 + 1] AS type,
               o_orderstatus AS aspect, o_orderpriority || ' ' || o_orderstatus AS explanation,
               round((o_totalprice % 100) / 100, 4) AS confidence,
               CASE o_orderpriority[1] WHEN '1' THEN 'public_fact' WHEN '2' THEN 'team_record'
               ELSE 'ai_candidate' END AS source, o_orderkey AS created_at FROM orders""",
    "reviews_raw": """
        SELECT event_id AS review_id, 'relation' AS subject_kind,
               (event_id * 7 + user_id) % ((SELECT count(*) FROM orders) // 5) AS subject_id, user_id,
               CASE WHEN event_type = 'error' THEN 'disagree' ELSE 'agree' END AS verdict, ts AS created_at
        FROM events""",
    "reviews": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY subject_id, user_id ORDER BY created_at DESC, review_id DESC) AS rn FROM reviews_raw)
        WHERE rn = 1""",
    "vote_status": """
        SELECT subject_id, CASE WHEN bool_or(verdict = 'agree') AND bool_or(verdict = 'disagree') THEN 'disputed'
            WHEN bool_or(verdict = 'disagree') THEN 'rejected' ELSE 'confirmed' END AS review_status
        FROM reviews GROUP BY 1""",
    "relations": """
        SELECT r.*, coalesce(s.review_status, 'unreviewed') AS review_status
        FROM relations_raw r LEFT JOIN vote_status s ON s.subject_id = r.relation_id""",
    "relation_members": """
        SELECT o_orderkey AS relation_id, CASE WHEN o_orderkey % 7 = 5 THEN 'claim' ELSE 'work' END AS entity_kind,
               CASE WHEN o_orderkey % 7 = 5 THEN o_orderkey + 1000000000 ELSE o_custkey END AS entity_id,
               'source' AS role, o_custkey AS anchor_work_id, 0 AS position FROM orders
        UNION ALL
        SELECT o_orderkey, 'work', (o_orderkey * 17) % (SELECT count(*) FROM customer), 'target',
               CASE WHEN o_orderkey % 7 <> 3 THEN (o_orderkey * 17) % (SELECT count(*) FROM customer) END, 1
        FROM orders""",
    "endpoints": """
        SELECT s.relation_id, coalesce(s.anchor_work_id, CASE WHEN s.entity_kind = 'work' THEN s.entity_id END)
                   AS source_work_id,
               coalesce(t.anchor_work_id, CASE WHEN t.entity_kind = 'work' THEN t.entity_id END) AS target_work_id
        FROM relation_members s JOIN relation_members t ON s.relation_id = t.relation_id
        WHERE s.role = 'source' AND t.role = 'target'""",
    "edges": f"""
        SELECT r.relation_id, e.source_work_id, e.target_work_id, r.type AS relation_type, r.review_status,
               r.source AS source_layer, r.confidence, r.explanation, coalesce(v.n, 0) AS review_count
        FROM relations r JOIN endpoints e ON e.relation_id = r.relation_id
        LEFT JOIN (SELECT subject_id, count(*) AS n FROM reviews GROUP BY 1) v ON v.subject_id = r.relation_id
        WHERE {drawable('r.type', 'r.review_status')} AND e.source_work_id <> e.target_work_id""",
    "reading_raw": """
        SELECT user_id, event_id % (SELECT count(*) FROM customer) AS work_id,
               CASE event_type WHEN 'view' THEN 'unread' WHEN 'click' THEN 'skimmed' WHEN 'signup' THEN 'read'
                   WHEN 'purchase' THEN 'reproduced' ELSE 'needs_review' END AS status,
               value > 50 AS starred, ts AS updated_at, event_id FROM events""",
    "reading_status": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY user_id, work_id ORDER BY updated_at DESC, event_id DESC) AS rn FROM reading_raw)
        WHERE rn = 1""",
    "readers": "SELECT work_id, count(*) AS readers FROM reading_status WHERE status <> 'unread' GROUP BY 1",
    "users": "SELECT c_custkey AS user_id, c_name AS name FROM customer",
    "groups_": "SELECT r_regionkey::BIGINT AS group_id, r_name AS name FROM region",
    "graphs": """
        SELECT n_nationkey::BIGINT AS graph_id, n_regionkey::BIGINT AS group_id, n_name AS name FROM nation""",
    "group_members": """
        SELECT n_regionkey::BIGINT AS group_id, c_custkey AS user_id,
               CASE WHEN c_acctbal > 5000 THEN 'admin' ELSE 'member' END AS role
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "graph_works": """
        SELECT c_nationkey::BIGINT AS graph_id, c_custkey AS work_id, c_custkey % 7 AS added_by FROM customer""",
    "claims": """
        SELECT doc_id AS claim_id, doc_id % (SELECT count(*) FROM customer) AS work_id,
               split_part(text, chr(10), 1) AS text,
               CASE WHEN lang = 'en' THEN 'ai_candidate' ELSE 'team_record' END AS source,
               CASE WHEN lang = 'en' THEN 'unreviewed' ELSE 'confirmed' END AS review_status FROM documents""",
    "methods": """
        SELECT o_orderkey AS method_id, (o_orderkey * 7) % (SELECT count(*) FROM part) AS work_id,
               o_orderpriority || ' ' || o_orderstatus AS name FROM orders""",
    "paper_aspects": f"""
        SELECT doc_id % (SELECT count(*) FROM part) AS work_id, {words(tx.ASPECTS)}[doc_id % 8 + 1] AS aspect,
               split_part(text, chr(10), 1) AS summary FROM documents""",
    "annotations": """
        SELECT event_id AS annotation_id, event_id % (SELECT count(*) FROM part) AS work_id, event_id % 7 AS user_id,
               CASE WHEN event_id % 5 = 0 THEN 'private' ELSE 'team' END AS visibility,
               CASE WHEN event_id % 40 > 0 THEN event_id - 1 END AS parent_id FROM events""",
    "claim_judgments": f"""
        SELECT event_id AS judgment_id, event_id % (SELECT count(*) FROM documents) AS claim_id, user_id,
               {words(tx.CLAIM_VERDICTS)}[event_id % 6 + 1] AS verdict FROM events""",
    "judgment_reviews": """
        SELECT event_id AS review_id, 'claim_judgment' AS subject_kind,
               (event_id * 3 + user_id) % ((SELECT count(*) FROM events) // 4) AS subject_id, user_id,
               CASE WHEN value > 50 THEN 'disagree' ELSE 'agree' END AS verdict FROM events""",
    "evidence": """
        SELECT o_orderkey AS evidence_id, o_orderkey AS relation_id, NULL::BIGINT AS claim_id,
               NULL::VARCHAR AS extraction_field, o_custkey * 2 AS version_id, (o_orderkey % 12 + 1)::INTEGER AS page,
               o_orderpriority AS text FROM orders
        UNION ALL
        SELECT -claim_id - 1, NULL, claim_id, 'claim', work_id * 2, (claim_id % 20 + 1)::INTEGER, text FROM claims""",
    "node_comments": """
        SELECT conv_id * 1000 + turn AS comment_id, conv_id % 10 AS graph_id, conv_id AS work_id,
               conv_id % 7 + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS user_id,
               CASE role WHEN 'user' THEN 'question' WHEN 'assistant' THEN 'idea' ELSE 'review' END AS kind,
               CASE WHEN (conv_id + turn) % 5 = 0 THEN 'private' ELSE 'team' END AS visibility, text AS body,
               CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id,
               conv_id * 1000 + turn AS created_at FROM conversations""",
    "vectors": f"""
        SELECT vec_id AS entity_id, 'aspect:' || {words(tx.ASPECTS)}[label % 8 + 1] AS field,
               embedding::DOUBLE[] AS vec FROM embeddings""",
    "jobs": """
        SELECT event_id AS job_id, event_type AS kind,
               CASE WHEN event_type IN ('view', 'click') THEN (props::JSON->>'$.k')::BIGINT END AS k_work,
               CASE WHEN event_type NOT IN ('view', 'click') THEN (props::JSON->>'$.k')::BIGINT END AS k_version
        FROM events""",
    "doc_lines": """
        SELECT doc_id AS work_id, doc_id * 2 AS version_id, doc_id, lang, source, string_split(text, chr(10)) AS lines
        FROM documents""",
    "aspect_raw": f"""
        SELECT work_id, version_id, {words(tx.ASPECTS)}[i + 1] AS aspect,
               coalesce(ls[1], '') AS summary, ls[2:] AS bullets,
               CASE WHEN (doc_id + i) % 5 = 0 THEN '' ELSE source END AS source_text,
               greatest((doc_id + i) % 13 - 1, 0)::INTEGER AS page
        FROM (SELECT d.*, i, [lines[j + 1] FOR j IN range(0, len(lines)) IF j % 8 = i] AS ls
              FROM doc_lines d, range(0, 8) AS t(i))""",
    "lineage": f"""
        SELECT a AS work_id, b AS neighbor_work_id, min(length) AS length FROM (
            SELECT s.anchor_work_id AS a, t.anchor_work_id AS b,
                   CASE WHEN r.review_status = 'confirmed' THEN 1 ELSE 2 END AS length
            FROM relations r JOIN relation_members s ON s.relation_id = r.relation_id AND s.role = 'source'
            JOIN relation_members t ON t.relation_id = r.relation_id AND t.role = 'target'
            WHERE r.type IN {in_list(tx.METHOD_LINEAGE)} AND r.review_status <> 'rejected'
              AND s.anchor_work_id IS NOT NULL AND t.anchor_work_id IS NOT NULL
              AND s.anchor_work_id <> t.anchor_work_id) GROUP BY 1, 2""",
    "lineage_both": """
        SELECT work_id, neighbor_work_id, min(length) AS length FROM (
            SELECT * FROM lineage UNION ALL SELECT neighbor_work_id, work_id, length FROM lineage) GROUP BY 1, 2""",
}


def _shared(name: str, me: str, ref: str) -> dict[str, str]:
    return {
        f"{name}_m": f"SELECT {me} AS e, {ref} AS r, count(*) AS m FROM citations GROUP BY 1, 2",
        f"{name}_n": f"SELECT e, sum(m)::BIGINT AS n FROM {name}_m GROUP BY 1",
        f"{name}_all": f"""
            SELECT d.a AS work_id, d.b AS neighbor_work_id,
                   sqrt((d.dot * d.dot)::DOUBLE / (x.n * y.n)::DOUBLE) AS score
            FROM (SELECT p.e AS a, q.e AS b, sum(p.m * q.m)::BIGINT AS dot FROM {name}_m p
                  JOIN {name}_m q ON p.r = q.r AND p.e <> q.e GROUP BY 1, 2) d
            JOIN {name}_n x ON x.e = d.a JOIN {name}_n y ON y.e = d.b""",
        f"{name}_top": f"""
            SELECT work_id, neighbor_work_id, score FROM {name}_all
            QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, neighbor_work_id) <= 32""",
    }


def top(source: str, keys: str, k: int = 32) -> str:
    return f"""SELECT * FROM {source}
        QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, neighbor_work_id) <= {k}"""


VIEWS |= _shared("coupling", "citing_work_id", "cited_work_id")
VIEWS |= _shared("cocite", "cited_work_id", "citing_work_id")
VIEWS |= {
    "cite_best": """
        SELECT work_id, neighbor_work_id, max(score) AS score FROM (
            SELECT * FROM coupling_top UNION ALL SELECT * FROM cocite_top) GROUP BY 1, 2""",
    "cite_top": top("cite_best", "work_id"),
    "cite_sym": """
        SELECT work_id, neighbor_work_id, max(score) AS score FROM (
            SELECT work_id, neighbor_work_id, score FROM cite_top
            UNION ALL SELECT neighbor_work_id, work_id, score FROM cite_top) GROUP BY 1, 2""",
    "cite_neighbors": top("cite_sym", "work_id"),
    "walk2": """
        SELECT work_id, neighbor_work_id, min(length) AS length FROM (
            SELECT * FROM lineage_both UNION ALL
            SELECT a.work_id, b.neighbor_work_id, a.length + b.length FROM lineage_both a
            JOIN lineage_both b ON a.neighbor_work_id = b.work_id WHERE a.work_id <> b.neighbor_work_id) GROUP BY 1, 2""",
    "walk4": """
        SELECT work_id, neighbor_work_id, min(length) AS length FROM (
            SELECT * FROM walk2 UNION ALL
            SELECT a.work_id, b.neighbor_work_id, a.length + b.length FROM walk2 a
            JOIN walk2 b ON a.neighbor_work_id = b.work_id WHERE a.work_id <> b.neighbor_work_id) GROUP BY 1, 2""",
    "lineage_score": "SELECT work_id, neighbor_work_id, 1.0::DOUBLE / greatest(length, 1) AS score FROM walk4",
    "lineage_neighbors": top("lineage_score", "work_id"),
    "graph_neighbors": """
        SELECT 'citation_coupling' AS dimension, work_id, neighbor_work_id, score FROM cite_neighbors
        UNION ALL SELECT 'method_lineage', work_id, neighbor_work_id, score FROM lineage_neighbors""",
    "cosine_all": """
        SELECT a.field, a.entity_id AS work_id, b.entity_id AS neighbor_work_id, list_cosine_similarity(a.vec, b.vec) AS score
        FROM vectors a JOIN vectors b ON a.field = b.field AND a.entity_id <> b.entity_id""",
    "cosine_top": top("cosine_all", "field, work_id"),
    "cosine_sym": """
        SELECT field, work_id, neighbor_work_id, max(score) AS score FROM (
            SELECT field, work_id, neighbor_work_id, score FROM cosine_top
            UNION ALL SELECT field, neighbor_work_id, work_id, score FROM cosine_top) GROUP BY 1, 2, 3""",
    "aspect_neighbors": f"""
        SELECT 'aspect_' || split_part(field, ':', 2) AS dimension, work_id, neighbor_work_id, score
        FROM ({top('cosine_sym', 'field, work_id')})""",
}


def oracle(body: str) -> str:
    """`body` with the views it names, directly or through others, as WITH clauses."""
    needed: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(VIEWS[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    own = re.match(r"\s*WITH\b", body)
    return f"WITH {parts},\n{body[own.end():]}" if own else f"WITH {parts}\n{body}"
