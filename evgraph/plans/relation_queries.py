"""E: relations, map, neighbourhood views."""

from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.operators import ego, reads
from evgraph.operators import relations as rel
from evgraph.plans import derived
from evgraph.plans.oracle_views import HIGH, VIEWS, case, in_list, words
from evgraph.plans.registry import query
from evgraph.plans.similarity_queries import graph_neighbors, stored_neighbors
from evgraph.session import materialize

VIEWS |= {
    "ends": f"""
        SELECT v.*, {case('review_status', [([k], w) for k, w in tx.STATUS_WEIGHTS.items()], 0.0)}::DOUBLE
                 * 1.0::DOUBLE * (1.0::DOUBLE + coalesce(confidence, 0.6::DOUBLE)) + review_count * 0.2::DOUBLE
                 + coalesce(r.readers, 0) * 0.15::DOUBLE AS score
        FROM (SELECT e.*, source_work_id AS center_id, target_work_id AS neighbor_work_id, 'out' AS direction FROM edges e
              UNION ALL SELECT e.*, target_work_id, source_work_id, 'in' FROM edges e) v
        LEFT JOIN readers r ON r.work_id = v.neighbor_work_id""",
    "cand": """
        SELECT v.* FROM ends v JOIN (SELECT DISTINCT relation_id, anchor_work_id FROM relation_members) m
            ON m.relation_id = v.relation_id AND m.anchor_work_id = v.center_id""",
    "cand_best": "SELECT center_id, neighbor_work_id, max(score) AS score FROM cand GROUP BY 1, 2",
    "cand2": """
        WITH via AS (SELECT center_id, neighbor_work_id AS via, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, neighbor_work_id) AS place
            FROM cand_best QUALIFY place <= 12),
        met AS (SELECT center_id, relation_id, 0 AS place FROM cand
            UNION ALL SELECT v.center_id, x.relation_id, v.place FROM via v JOIN cand x ON x.center_id = v.via),
        soonest AS (SELECT center_id, relation_id, min(place) AS place FROM met GROUP BY 1, 2)
        SELECT f.center_id, e.* EXCLUDE (center_id) FROM soonest f LEFT JOIN via v ON v.center_id = f.center_id AND v.place = f.place
        JOIN ends e ON e.relation_id = f.relation_id AND e.center_id =
            CASE WHEN f.center_id IN (e.source_work_id, e.target_work_id) THEN f.center_id ELSE v.via END""",
    "cand2_best": "SELECT center_id, neighbor_work_id, max(score) AS score FROM cand2 GROUP BY 1, 2",
}


def _drawn(suffix: str, kept: int) -> dict:
    cand = f"cand{suffix}"
    return {
        f"ego{suffix}_kept": f"""
        SELECT * FROM {cand}_best QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY score DESC, neighbor_work_id) <= {kept}""",
        f"ego{suffix}_over": f"""
        SELECT DISTINCT c.center_id, c.relation_type || ':' || c.direction AS group_key, c.relation_type, c.direction, c.neighbor_work_id
        FROM {cand} c LEFT JOIN ego{suffix}_kept k ON k.center_id = c.center_id AND k.neighbor_work_id = c.neighbor_work_id WHERE k.center_id IS NULL""",
        f"ego{suffix}_groups": f"""
        SELECT center_id, group_key, relation_type, direction, count(*) AS members,
               sha256(center_id || '|' || group_key)[:32] AS group_id FROM ego{suffix}_over GROUP BY 1, 2, 3, 4""",
        f"ego{suffix}_node_rows": f"""
        SELECT center_id, center_id::VARCHAR AS node_id, 'work' AS kind, w.title AS label, NULL::BIGINT AS members
        FROM (SELECT DISTINCT center_id FROM ego{suffix}_kept) JOIN titled w ON w.work_id = center_id
        UNION ALL SELECT center_id, neighbor_work_id::VARCHAR, 'work', w.title, NULL FROM ego{suffix}_kept JOIN titled w ON w.work_id = neighbor_work_id
        UNION ALL SELECT center_id, group_id, 'group', CASE direction WHEN 'in' THEN 'towards it:' ELSE 'from it:' END
            || ' ' || replace(relation_type, '_', ' ') || ' +' || members, members FROM ego{suffix}_groups""",
        f"ego{suffix}_edge_rows": f"""
        SELECT c.center_id, c.relation_id::VARCHAR AS edge_id, source_work_id::VARCHAR AS source_id, target_work_id::VARCHAR AS target_id,
            relation_type, source_work_id || '|' || target_work_id || '|'
            || {case('relation_type', [(v, f"'{k}'") for k, v in tx.SEMANTIC_GROUPS.items()], "'other'")} AS bundle_key
        FROM {cand} c LEFT JOIN ego{suffix}_kept a ON a.center_id = c.center_id AND a.neighbor_work_id = c.source_work_id
        LEFT JOIN ego{suffix}_kept b ON b.center_id = c.center_id AND b.neighbor_work_id = c.target_work_id
        WHERE (a.center_id IS NOT NULL OR c.source_work_id = c.center_id) AND (b.center_id IS NOT NULL OR c.target_work_id = c.center_id)
        UNION ALL SELECT center_id, group_id, CASE direction WHEN 'out' THEN center_id::VARCHAR ELSE group_id END,
            CASE direction WHEN 'out' THEN group_id ELSE center_id::VARCHAR END, relation_type, NULL FROM ego{suffix}_groups""",
    }


KEPT = 8  # small enough that most centres of the test tables have overflow
VIEWS |= _drawn("", KEPT) | _drawn("2", ego.KEPT_OTHERS)


@query("e1_relation_problems", """
    WITH x AS (SELECT m.*, CASE WHEN relation_id % 29 = 0 THEN 'target' ELSE role END AS role2,
            CASE WHEN relation_id % 31 = 0 THEN entity_id + 900000000 ELSE entity_id END AS entity2,
            CASE WHEN relation_id % 37 = 0 THEN anchor_work_id + 1 ELSE anchor_work_id END AS anchor2 FROM relation_members m),
    own AS (SELECT work_id AS id, work_id AS owner, 'work' AS kind FROM works
            UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'claim' FROM orders),
    j AS (SELECT x.*, o.id AS hit, o.owner, a.work_id AS anchor_hit FROM x LEFT JOIN own o ON o.id = entity2 AND o.kind = entity_kind
          LEFT JOIN works a ON a.work_id = anchor2),
    g AS (SELECT relation_id, count(*) FILTER (role2 = 'source') AS s, count(*) FILTER (role2 = 'target') AS t,
            min(entity_kind || entity2) FILTER (role2 = 'source') AS se, min(entity_kind || entity2) FILTER (role2 = 'target') AS te,
            bool_or(hit IS NULL) AS unk, bool_or(anchor2 IS NOT NULL AND anchor_hit IS NULL) AS lost,
            bool_or(coalesce(anchor2 <> owner, false)) AS fore FROM j GROUP BY 1)
    SELECT r.relation_id, concat_ws(';', CASE WHEN s <> 1 OR t <> 1 THEN 'needs one source and one target' END,
        CASE WHEN s = 1 AND t = 1 AND se = te THEN 'source equals target' END,
        CASE WHEN c < 0 OR c > 1 THEN 'confidence outside 0..1' END, CASE WHEN unk THEN 'unknown member' END,
        CASE WHEN lost THEN 'unknown anchor' END, CASE WHEN fore THEN 'anchor does not own member' END) AS reasons
    FROM (SELECT *, confidence * 1.05 - 0.01 AS c FROM relations_raw) r JOIN g ON g.relation_id = r.relation_id""")
def _(t):
    key = F.col("relation_id")
    members = t.relation_members.select(
        "relation_id", "entity_kind", F.when(key % 31 == 0, F.col("entity_id") + 900_000_000).otherwise(F.col("entity_id")).alias("entity_id"),
        F.when(key % 29 == 0, "target").otherwise(F.col("role")).alias("role"),
        F.when(key % 37 == 0, F.col("anchor_work_id") + 1).otherwise(F.col("anchor_work_id")).alias("anchor_work_id"))
    claims = t.raw("orders").select((F.col("o_orderkey") + 1_000_000_000).alias("entity_id"), F.col("o_custkey").alias("work_id"))
    works = t.works.select(F.col("work_id").alias("entity_id"), "work_id")
    relations = t.relations_raw.withColumn("confidence", F.col("confidence") * 1.05 - 0.01)
    out = rel.validate_relations(relations, members, {"work": works, "claim": claims})
    return out.select("relation_id", F.array_join("reasons", ";").alias("reasons"))


@query("e2_evidence_problems", """
    SELECT evidence_id, concat_ws(';', CASE WHEN relation_id IS NULL AND c IS NULL AND f IS NULL THEN 'not bound' END,
        CASE WHEN p < 1 THEN 'page too low' END, CASE WHEN trim(x) = '' THEN 'blank text' END,
        CASE WHEN v NOT IN (SELECT version_id FROM versions) THEN 'unknown version' END) AS reasons
    FROM (SELECT *, CASE WHEN evidence_id % 3 <> 0 THEN claim_id END AS c, CASE WHEN evidence_id % 3 <> 0 THEN extraction_field END AS f,
            page - 1 AS p, CASE WHEN evidence_id % 5 = 0 THEN '  ' ELSE text END AS x,
            CASE WHEN evidence_id % 7 = 0 THEN version_id + 1 ELSE version_id END AS v FROM evidence)""")
def _(t):
    key = F.col("evidence_id")
    bad = t.evidence.select(
        "evidence_id", "relation_id", F.when(key % 3 != 0, F.col("claim_id")).alias("claim_id"),
        F.when(key % 3 != 0, F.col("extraction_field")).alias("extraction_field"), (F.col("page") - 1).alias("page"),
        F.when(key % 5 == 0, "  ").otherwise(F.col("text")).alias("text"),
        F.when(key % 7 == 0, F.col("version_id") + 1).otherwise(F.col("version_id")).alias("version_id"))
    return rel.validate_evidence(bad, t.versions).select("evidence_id", F.array_join("reasons", ";").alias("reasons"))


_EXISTING = """
    SELECT DISTINCT r.type, s.entity_id AS a, x.entity_id AS b FROM relations r
    JOIN relation_members s ON s.relation_id = r.relation_id AND s.role = 'source'
    JOIN relation_members x ON x.relation_id = r.relation_id AND x.role = 'target' WHERE r.review_status <> 'rejected'"""


@query("e3_context_candidates", f"""
    WITH ex AS ({_EXISTING}),
    p AS (SELECT o_orderkey AS k, {words(tx.RELATION_TYPES + ['none'])}[o_orderkey % 13 + 1] AS type,
            CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey ELSE o_custkey END AS target, round((o_totalprice % 100) / 100, 4) AS confidence,
            CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS quote, * FROM orders)
    SELECT p.type, k AS source_work_id, target AS target_work_id, confidence, CASE WHEN k % 2 = 0 THEN 'scope' END AS aspect,
           o_orderpriority AS explanation, k * 2 AS version_id, quote AS evidence_text, CASE WHEN k % 4 - 1 > 0 THEN k % 4 - 1 ELSE 1 END::INTEGER AS page
    FROM p LEFT JOIN ex ON ex.type = p.type AND ex.a = k AND ex.b = target
    WHERE ex.type IS NULL AND p.type NOT IN ('cites', 'version_of', 'none') AND confidence >= 0.5 AND k % 11 <> 0
      AND target <> k AND trim(quote) <> ''""")
def _(t):
    out = rel.context_candidates(
        derived.context_outputs(t), derived.contexts_of_orders(t), derived.targets_of_orders(t), t.relations, t.relation_members)
    return out.select(
        "type", "source_work_id", "target_work_id", "confidence", "aspect", "explanation", "version_id", "evidence_text", "page")


@query("e4_not_yet_related", f"""
    WITH ex AS ({_EXISTING}),
    c AS (SELECT o_orderkey, {words(tx.RELATION_TYPES)}[o_orderkey % 12 + 1] AS type, o_custkey AS a,
                 (o_orderkey * 17 + o_orderkey % 2) % (SELECT count(*) FROM customer) AS b FROM orders)
    SELECT o_orderkey, c.type FROM c LEFT JOIN ex ON ex.type = c.type AND ex.a = c.a AND ex.b = c.b WHERE ex.type IS NULL""")
def _(t):
    key = F.col("relation_id")
    n = t.size("customer")
    cand = t.raw("orders").join(t.relations_raw.select("relation_id", "type"), F.col("o_orderkey") == key).select(
        "o_orderkey", "type", F.col("o_custkey").alias("source_work_id"), ((key * 17 + key % 2) % n).alias("target_work_id"))
    return rel.not_yet_related(cand, t.relations, t.relation_members).select("o_orderkey", "type")


@query("e5_pair_candidates", f"""
    WITH ex AS ({_EXISTING}),
    p AS (SELECT o_orderkey AS k, {words(tx.RELATION_TYPES + ['none'])}[(o_orderkey * 5) % 13 + 1] AS type, o_custkey AS a,
            (o_orderkey * 23) % (SELECT count(*) FROM customer) AS b, round((o_totalprice % 100) / 100, 4) AS confidence, * FROM orders),
    q AS (SELECT *, CASE k % 3 WHEN 0 THEN a WHEN 1 THEN b END AS s, CASE k % 3 WHEN 0 THEN b WHEN 1 THEN a END AS d FROM p)
    SELECT q.type, s AS source_work_id, d AS target_work_id, confidence, o_orderstatus AS explanation,
           2 * CASE WHEN k % 2 = 0 THEN q.a ELSE q.b END AS version_id, o_orderpriority AS evidence_text
    FROM q LEFT JOIN ex ON ex.type = q.type AND ex.a = s AND ex.b = d
    WHERE ex.type IS NULL AND q.type NOT IN ('cites', 'version_of', 'none') AND confidence >= 0.5 AND s <> d AND k % 10 <> 0
    QUALIFY row_number() OVER (PARTITION BY q.type, s, d ORDER BY q.a, q.b) = 1""")
def _(t):
    out = rel.pair_candidates(derived.pair_outputs(t), t.relations, t.relation_members)
    return out.select("type", "source_work_id", "target_work_id", "confidence", "explanation", "version_id", "evidence_text")


@query("e6_recalled_candidates", """
    WITH near AS (SELECT work_id, neighbor_work_id, max(score) AS score FROM graph_neighbors GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY max(score) DESC, neighbor_work_id) <= 32),
    proj AS (SELECT a.work_id, b.neighbor_work_id FROM work_projects a JOIN (SELECT project_id, work_id AS neighbor_work_id FROM work_projects) b
        ON a.project_id = b.project_id AND a.work_id <> b.neighbor_work_id
        QUALIFY row_number() OVER (PARTITION BY a.work_id ORDER BY b.neighbor_work_id) <= 32),
    lib AS (SELECT w.work_id, l.work_id AS neighbor_work_id FROM works w, (SELECT * FROM works ORDER BY created_at DESC LIMIT 49) l
        WHERE w.work_id <> l.work_id QUALIFY row_number() OVER (PARTITION BY w.work_id ORDER BY l.created_at DESC) <= 48),
    every AS (SELECT * FROM near UNION ALL SELECT citing_work_id, cited_work_id, 0.55 FROM citations
        UNION ALL SELECT cited_work_id, citing_work_id, 0.50 FROM citations
        UNION ALL SELECT work_id, neighbor_work_id, 0.2 FROM proj UNION ALL SELECT work_id, neighbor_work_id, 0.12 FROM lib),
    best AS (SELECT work_id, neighbor_work_id, max(score) AS score FROM every GROUP BY 1, 2)
    SELECT b.work_id, b.neighbor_work_id, round(b.score, 6) AS score FROM best b
    LEFT JOIN related_works r ON r.work_id = b.work_id AND r.neighbor_work_id = b.neighbor_work_id WHERE r.work_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY b.work_id ORDER BY b.score DESC, b.neighbor_work_id) <= 10""")
def _(t):
    out = rel.recall_candidates(
        t.works, graph_neighbors(t), t.citations, t.work_projects, t.relations, t.relation_members)
    return out.select("work_id", "neighbor_work_id", F.round("score", 6).alias("score"))


@query("e6_recalled_fresh_import", """
    WITH lib AS (SELECT w.work_id, l.work_id AS neighbor_work_id FROM works w, (SELECT * FROM works ORDER BY created_at DESC LIMIT 49) l
        WHERE w.work_id <> l.work_id QUALIFY row_number() OVER (PARTITION BY w.work_id ORDER BY l.created_at DESC) <= 48),
    near AS (SELECT work_id, neighbor_work_id, max(score) AS score FROM (SELECT work_id, neighbor_work_id, score FROM lineage_neighbors
        UNION ALL SELECT * , 0.12 FROM lib) GROUP BY 1, 2)
    SELECT b.work_id, b.neighbor_work_id, round(b.score, 6) AS score FROM near b
    LEFT JOIN related_works r ON r.work_id = b.work_id AND r.neighbor_work_id = b.neighbor_work_id WHERE r.work_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY b.work_id ORDER BY b.score DESC, b.neighbor_work_id) <= 10""")
def _(t):
    near = stored_neighbors(t, "method_lineage")
    none = t.citations.where("citing_work_id = cited_work_id")
    out = rel.recall_candidates(t.works, near, none, t.work_projects.where("project_id < 0"), t.relations, t.relation_members)
    return out.select("work_id", "neighbor_work_id", F.round("score", 6).alias("score"))


def edges(t, scope=None):
    return rel.assertion_edges(t.relations, t.relation_members, t.reviews, scope)


_EDGE = "relation_id, source_work_id, target_work_id, relation_type, review_status, source_layer, confidence, review_count"


@query("e7_assertion_edges", f"SELECT {_EDGE} FROM edges")
def _(t):
    return edges(t).select(*_EDGE.split(", "))


@query("e7_edges_of_graphs", """
    SELECT a.graph_id, e.relation_id FROM edges e JOIN graph_works a ON a.work_id = e.source_work_id
    JOIN graph_works b ON b.work_id = e.target_work_id AND b.graph_id = a.graph_id""")
def _(t):
    return rel.graph_edges(edges(t), t.graph_works).select("graph_id", "relation_id")


VIEWS["map_nodes"] = """
    SELECT w.work_id, w.title, w.year, coalesce(r.readers, 0) AS readers, w.created_at,
           w.work_id IN (SELECT m.anchor_work_id FROM relation_members m JOIN relations x ON x.relation_id = m.relation_id
                         WHERE x.review_status = 'disputed' AND m.anchor_work_id IS NOT NULL) AS has_dispute
    FROM titled w LEFT JOIN readers r ON r.work_id = w.work_id"""


def nodes(t, scope=None):
    return rel.map_nodes(t.works, t.versions, t.reading_status, t.relations, t.relation_members, scope)


@query("e8_map_nodes", "SELECT work_id, title, year, readers, has_dispute FROM map_nodes")
def _(t):
    return nodes(t).select("work_id", "title", "year", "readers", "has_dispute")


@query("e9_neighbor_lists", """
    SELECT g.graph_id, dimension, n.work_id, string_agg(neighbor_work_id || ':' || round(score * 1000000)::BIGINT, ',' ORDER BY score DESC, neighbor_work_id) AS entries
    FROM graph_neighbors n JOIN (SELECT DISTINCT graph_id, work_id FROM graph_works) g ON g.work_id = n.work_id
    JOIN (SELECT DISTINCT graph_id, work_id FROM graph_works) o ON o.work_id = n.neighbor_work_id AND o.graph_id = g.graph_id GROUP BY 1, 2, 3""")
def _(t):
    lists = rel.neighbor_lists(graph_neighbors(t), t.graph_works)
    entry = lambda s: F.concat(s["neighbor_work_id"].cast("string"), F.lit(":"), F.round(s["score"] * 1_000_000).cast("long").cast("string"))
    return lists.select("graph_id", "dimension", "work_id", F.array_join(F.transform("entries", entry), ",").alias("entries"))


def candidates(t, mode="explore"):
    return ego.ego_candidates(edges(t), t.relation_members, t.reading_status, mode)


@query("e10_ego_candidates", "SELECT center_id, neighbor_work_id, relation_id, direction, round(score, 6) AS score FROM cand")
def _(t):
    return candidates(t).select("center_id", "neighbor_work_id", "relation_id", "direction", F.round("score", 6).alias("score"))


@query("e11_two_hop_others", """
    WITH via AS (SELECT center_id, neighbor_work_id AS via, row_number() OVER (PARTITION BY center_id ORDER BY score DESC, neighbor_work_id) AS place
        FROM cand_best QUALIFY place <= 12),
    anc AS (SELECT DISTINCT relation_id, anchor_work_id AS w FROM relation_members WHERE anchor_work_id IS NOT NULL),
    far AS (SELECT v.center_id, x.neighbor_work_id, x.score FROM via v JOIN cand x ON x.center_id = v.via AND x.neighbor_work_id <> v.center_id
            LEFT JOIN via u ON u.center_id = v.center_id AND u.via = x.neighbor_work_id AND u.place < v.place
            LEFT JOIN anc a ON a.relation_id = x.relation_id AND a.w = x.neighbor_work_id WHERE u.via IS NULL OR a.w IS NULL
        UNION ALL SELECT * FROM cand_best
        UNION ALL SELECT c.neighbor_work_id, c.center_id, c.score - coalesce(o.readers, 0) * 0.15::DOUBLE + coalesce(m.readers, 0) * 0.15::DOUBLE
            FROM cand c JOIN via v ON v.center_id = c.neighbor_work_id AND v.via = c.center_id
            LEFT JOIN anc a ON a.relation_id = c.relation_id AND a.w = c.neighbor_work_id
            LEFT JOIN readers o ON o.work_id = c.neighbor_work_id LEFT JOIN readers m ON m.work_id = c.center_id WHERE a.w IS NULL)
    SELECT center_id, neighbor_work_id, round(max(score), 6) AS score FROM far GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY center_id ORDER BY round(max(score), 9) DESC, neighbor_work_id) <= 29""")
def _(t):
    scored = ego.scored_ends(edges(t), t.relation_members, t.reading_status)
    return ego.two_hop_others(scored).select("center_id", "neighbor_work_id", F.round("score", 6).alias("score"))


@query("e12_ego_kept", "SELECT center_id, neighbor_work_id, round(score, 6) AS score FROM ego_kept")
def _(t):
    return ego.kept_others(candidates(t), KEPT).select("center_id", "neighbor_work_id", F.round("score", 6).alias("score"))


def _scored(t):
    return materialize(ego.scored_ends(edges(t).drop("explanation", "source_layer"), t.relation_members, t.reading_status), "scored")


def two_hops(t):
    """Not staged: the table of scored ends is, and what is drawn of the candidates is read off the join itself."""
    return ego.two_hop_candidates(_scored(t))


@query("e11_two_hop_candidates", "SELECT center_id, neighbor_work_id, relation_id, direction, round(score, 6) AS score FROM cand2")
def _(t):
    return two_hops(t).select("center_id", "neighbor_work_id", "relation_id", "direction", F.round("score", 6).alias("score"))


def _ego(t, depth=1):
    if depth == 2:
        return _two_hop_ego(t)[:4]
    cand = materialize(candidates(t), "ego")
    kept = materialize(ego.kept_others(cand, KEPT), "ego_kept")
    over = ego.overflow_members(cand, kept)
    return cand, kept, over, ego.overflow_groups(over)


def _two_hop_ego(t, grouped=True):
    """Candidates, kept works, overflow and groups at depth 2, and the number of rounds in which the candidates are unfolded."""
    scored = _scored(t)
    rounds, cand = ego.rounds_of(scored), ego.two_hop_candidates(scored)
    kept = ego.kept_others(cand, ego.KEPT_OTHERS, rounds)
    over = ego.overflow_members(cand, kept)
    return cand, kept, over, ego.overflow_groups(over, rounds) if grouped else None, rounds


@query("e12_overflow_groups", "SELECT center_id, group_key, members, group_id FROM ego_groups")
def _(t):
    return _ego(t)[3].select("center_id", "group_key", "members", "group_id")


@query("e13_ego_nodes", "SELECT * REPLACE (members::VARCHAR AS members) FROM ego_node_rows")
def _(t):
    _, kept, _, groups = _ego(t)
    return ego.ego_nodes(t.works, t.versions, kept, groups).drop("score").withColumn("members", F.col("members").cast("string"))


@query("e13_ego_edges", "SELECT * FROM ego_edge_rows")
def _(t):
    cand, kept, _, groups = _ego(t)
    return ego.ego_edges(cand, kept, groups).drop("review_status", "review_count")


@query("e12_two_hop_kept", "SELECT center_id, neighbor_work_id, round(score, 6) AS score FROM ego2_kept")
def _(t):
    return _two_hop_ego(t, grouped=False)[1].select("center_id", "neighbor_work_id", F.round("score", 6).alias("score"))


@query("e12_two_hop_groups", "SELECT center_id, group_key, members, group_id FROM ego2_groups")
def _(t):
    return _ego(t, 2)[3].select("center_id", "group_key", "members", "group_id")


@query("e13_two_hop_nodes", "SELECT * REPLACE (members::VARCHAR AS members) FROM ego2_node_rows")
def _(t):
    _, kept, _, groups = _ego(t, 2)
    return ego.ego_nodes(t.works, t.versions, kept, groups).drop("score").withColumn("members", F.col("members").cast("string"))


@query("e13_two_hop_edges", "SELECT * FROM ego2_edge_rows")
def _(t):
    cand, kept, _, groups, rounds = _two_hop_ego(t)
    return ego.ego_edges(cand, kept, groups, rounds if rounds > 1 else 0).drop("review_status", "review_count")


@query("e14_expanded_groups", """
    WITH opened AS (SELECT * FROM ego_groups WHERE direction = 'in'),
    inside AS (SELECT o.center_id, o.neighbor_work_id::VARCHAR AS node_id, min(o.group_key) AS group_key FROM ego_over o
               JOIN opened g ON g.center_id = o.center_id AND g.group_key = o.group_key GROUP BY 1, 2)
    SELECT center_id, node_id, kind, 'node' AS what FROM ego_node_rows WHERE node_id NOT IN (SELECT group_id FROM opened)
    UNION ALL SELECT center_id, node_id, 'work', 'node' FROM inside
    UNION ALL SELECT center_id, edge_id, relation_type, 'edge' FROM ego_edge_rows WHERE edge_id NOT IN (SELECT group_id FROM opened)
    UNION ALL SELECT center_id, 'expand-' || group_key || '-' || node_id, split_part(group_key, ':', 1), 'edge' FROM inside""")
def _(t):
    cand, kept, over, groups = _ego(t)
    opened = groups.where("direction = 'in'").select("center_id", "group_key")
    some_nodes, some_edges = ego.expand_groups(
        ego.ego_nodes(t.works, t.versions, kept, groups), ego.ego_edges(cand, kept, groups), over, opened)
    return some_nodes.select("center_id", "node_id", "kind", F.lit("node").alias("what")).unionByName(
        some_edges.select("center_id", F.col("edge_id").alias("node_id"), F.col("relation_type").alias("kind"), F.lit("edge").alias("what")))


@query("e15_edge_bundles", f"""
    WITH b AS (SELECT *, relation_type = 'alternative_to' AS sym, {case('relation_type', [(v, f"'{k}'") for k, v in tx.SEMANTIC_GROUPS.items()], "'other'")} AS semantic_group,
            CASE review_status WHEN 'disputed' THEN 3 WHEN 'confirmed' THEN 2 WHEN 'unreviewed' THEN 1 ELSE 0 END AS rank FROM edges),
    g AS (SELECT sym AS undirected, CASE WHEN sym THEN least(source_work_id, target_work_id) ELSE source_work_id END AS bundle_source,
            CASE WHEN sym THEN greatest(source_work_id, target_work_id) ELSE target_work_id END AS bundle_target, semantic_group,
            count(*) AS count, max(review_count) AS review_count, max(rank) AS rank, min(relation_type) AS t FROM b GROUP BY 1, 2, 3, 4)
    SELECT undirected, bundle_source, bundle_target, semantic_group, count, review_count,
           CASE rank WHEN 3 THEN 'disputed' WHEN 2 THEN 'confirmed' WHEN 1 THEN 'unreviewed' ELSE 'rejected' END AS status,
           CASE WHEN count = 1 THEN replace(t, '_', ' ') ELSE semantic_group || ' ×' || count END AS label FROM g
    QUALIFY row_number() OVER (PARTITION BY undirected, bundle_source, bundle_target ORDER BY count DESC, rank DESC, semantic_group) <= 3""")
def _(t):
    return rel.bundle_edges(edges(t)).withColumnRenamed("symmetric", "undirected")


@query("e16_visible_edges", "SELECT relation_id, relation_type, review_status FROM edges WHERE review_status <> 'unreviewed'")
def _(t):
    return rel.visible_edges(edges(t)).select("relation_id", "relation_type", "review_status")


@query("e17_patched_relations", f"""
    SELECT r.relation_id, CASE WHEN r.relation_id % 4 = 0 THEN 'improves_on' ELSE type END AS type,
           CASE WHEN r.relation_id % 6 = 0 THEN 'new' ELSE explanation END AS explanation, m.entity_id,
           CASE WHEN r.relation_id % 10 <> 0 THEN role WHEN role = 'source' THEN 'target' ELSE 'source' END AS role
    FROM relations_raw r JOIN relation_members m ON m.relation_id = r.relation_id""")
def _(t):
    key = F.col("relation_id")
    patches = t.relations_raw.where(key % 2 == 0).select(
        "relation_id", F.when(key % 4 == 0, "improves_on").alias("new_type"), F.lit(None).cast("string").alias("new_aspect"),
        F.when(key % 6 == 0, "new").alias("new_explanation"), (key % 10 == 0).alias("swap"))
    relations, members = rel.patch_relations(t.relations_raw, t.relation_members, patches)
    return relations.join(members, "relation_id").select("relation_id", "type", "explanation", "entity_id", "role")


_QUEUE = f"""SELECT relation_id, type, confidence FROM relations WHERE source = 'ai_candidate' AND review_status = 'unreviewed'
    AND type NOT IN {in_list(tx.NOT_PROPOSABLE)} AND (coalesce(confidence, 0) >= 0.75 OR type IN {HIGH})"""


@query("e18_review_queue", _QUEUE)
def _(t):
    return rel.review_queue(t.relations, limit=None).select("relation_id", "type", "confidence")


@query("e18_review_queue_page", f"{_QUEUE} ORDER BY confidence DESC, created_at LIMIT 200 OFFSET 50")
def _(t):
    return rel.review_queue(t.relations, limit=500, offset=50).select("relation_id", "type", "confidence")


@query("e18_candidates_any_status", """
    SELECT relation_id, type, review_status FROM relations WHERE source = 'ai_candidate' AND type <> 'cites'""")
def _(t):
    return rel.review_queue(t.relations, only_unreviewed=False, limit=None).select("relation_id", "type", "review_status")


_OF_WORKS = """SELECT m.work_id, r.relation_id, r.type FROM (SELECT DISTINCT relation_id, anchor_work_id AS work_id FROM relation_members
    WHERE anchor_work_id IS NOT NULL) m JOIN relations r ON r.relation_id = m.relation_id WHERE r.source = 'ai_candidate'"""


@query("e18_queues_of_works", f"{_OF_WORKS} AND r.review_status = 'unreviewed'")
def _(t):
    return rel.review_queues(t.relations, t.relation_members).select("work_id", "relation_id", "type")


@query("e18_queues_of_works_any_status", _OF_WORKS)
def _(t):
    return rel.review_queues(t.relations, t.relation_members, only_unreviewed=False).select("work_id", "relation_id", "type")


@query("d8_relations_of_works", "SELECT work_id, relation_id, type, review_status FROM work_relations")
def _(t):
    return rel.relations_of_works(t.relations, t.relation_members).select("work_id", "relation_id", "type", "review_status")


@query("d9_card_groups", """
    WITH m AS (SELECT DISTINCT relation_id, work_id, first(role ORDER BY position) OVER (PARTITION BY relation_id, work_id ORDER BY position
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS role FROM (
        SELECT relation_id, role, position, entity_id AS work_id FROM relation_members
        UNION SELECT relation_id, role, position, anchor_work_id FROM relation_members WHERE anchor_work_id IS NOT NULL))
    SELECT w.work_id, w.relation_id, CASE WHEN type = 'prerequisite_for' THEN 'prerequisite'
        WHEN type = 'improves_on' AND role = 'target' THEN 'improves_in' WHEN type = 'improves_on' THEN 'improves_out'
        WHEN type IN ('reproduces', 'fails_to_reproduce') THEN 'reproduce' WHEN type = 'contradicts_claim' THEN 'conflict'
        WHEN type IN ('uses_method_from', 'alternative_to') THEN 'method' ELSE 'other' END AS card_group
    FROM work_relations w LEFT JOIN m ON m.relation_id = w.relation_id AND m.work_id = w.work_id""")
def _(t):
    listed = rel.relations_of_works(t.relations, t.relation_members)
    return rel.card_groups(listed, t.relation_members).select("work_id", "relation_id", "card_group")


@query("e19_graph_page", """
    WITH g AS (SELECT * FROM graph_works WHERE graph_id = 3),
    n AS (SELECT * FROM map_nodes WHERE work_id IN (SELECT work_id FROM g)),
    p AS (SELECT * FROM n ORDER BY created_at LIMIT 40 OFFSET 10),
    c AS (SELECT count(*) AS total FROM n)
    SELECT 'node' AS what, work_id::VARCHAR AS a, readers::VARCHAR AS b FROM p
    UNION ALL SELECT 'edge', relation_id::VARCHAR, review_status FROM edges
        WHERE source_work_id IN (SELECT work_id FROM p) AND target_work_id IN (SELECT work_id FROM p)
    UNION ALL SELECT 'neighbor', work_id::VARCHAR, dimension || neighbor_work_id FROM graph_neighbors
        WHERE work_id IN (SELECT work_id FROM p) AND neighbor_work_id IN (SELECT work_id FROM p)
    UNION ALL SELECT 'comments', work_id::VARCHAR, count(*)::VARCHAR FROM node_comments
        WHERE graph_id = 3 AND (visibility = 'team' OR user_id = 3) AND work_id IN (SELECT work_id FROM p) GROUP BY work_id
    UNION ALL SELECT 'meta', total::VARCHAR, CASE WHEN total > 50 THEN 50 END::VARCHAR FROM c""")
def _(t):
    scope = t.graph_works.where("graph_id = 3")
    page = rel.graph_page(
        nodes(t, scope), edges(t, scope), rel.in_graph(graph_neighbors(t), scope, "work_id", "neighbor_work_id"),
        reads.visible_to(t.node_comments, 3).where("graph_id = 3"), limit=40, offset=10)
    row = lambda name, a, b: page[name].select(F.col(a).cast("string").alias("a"), F.expr(b).cast("string").alias("b"))
    parts = {
        "node": row("nodes", "work_id", "readers"),
        "edge": row("edges", "relation_id", "review_status"),
        "neighbor": row("neighbors", "work_id", "concat(dimension, neighbor_work_id)"),
        "comments": row("comment_counts", "work_id", "comments"),
        "meta": row("meta", "total_nodes", "next_offset"),
    }
    out = None
    for what, df in parts.items():
        one = df.select(F.lit(what).alias("what"), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


VIEWS["node_relations"] = """
    SELECT g.graph_id, x.work_id, 'assertion' AS kind, x.type AS detail,
           CASE WHEN e.s = x.work_id THEN 'outgoing' WHEN e.t = x.work_id THEN 'incoming' ELSE 'involving' END AS direction,
           NULL::BIGINT AS neighbor_work_id, x.relation_id::VARCHAR AS ref, NULL::DOUBLE AS score
    FROM work_relations x JOIN (SELECT relation_id, source_work_id AS s, target_work_id AS t FROM endpoints) e ON e.relation_id = x.relation_id
    JOIN graph_works g ON g.work_id = x.work_id
    JOIN graph_works a ON a.work_id = e.s AND a.graph_id = g.graph_id JOIN graph_works b ON b.work_id = e.t AND b.graph_id = g.graph_id
    UNION ALL
    SELECT g.graph_id, x.work_id, 'related', x.type,
           CASE WHEN e.s = x.work_id THEN 'outgoing' WHEN e.t = x.work_id THEN 'incoming' ELSE 'involving' END,
           o.w, x.relation_id::VARCHAR, NULL
    FROM work_relations x JOIN (SELECT relation_id, source_work_id AS s, target_work_id AS t FROM endpoints) e ON e.relation_id = x.relation_id
    JOIN graph_works g ON g.work_id = x.work_id
    JOIN graph_works a ON a.work_id = e.s AND a.graph_id = g.graph_id JOIN graph_works b ON b.work_id = e.t AND b.graph_id = g.graph_id
    JOIN (SELECT relation_id, source_work_id AS w FROM endpoints UNION SELECT relation_id, target_work_id FROM endpoints) o
        ON o.relation_id = x.relation_id AND o.w <> x.work_id
    UNION ALL
    SELECT a.graph_id, c.me, 'citation', 'cites', c.direction, c.you, c.citation_id, NULL FROM (
        SELECT citation_id, citing_work_id AS me, cited_work_id AS you, 'outgoing' AS direction FROM citations
        UNION ALL SELECT citation_id, cited_work_id, citing_work_id, 'incoming' FROM citations) c
    JOIN graph_works a ON a.work_id = c.me JOIN graph_works b ON b.work_id = c.you AND a.graph_id = b.graph_id
    UNION ALL
    SELECT a.graph_id, n.work_id, 'neighbor', n.dimension, 'both', n.neighbor_work_id, NULL, n.score FROM (
        SELECT dimension, work_id, neighbor_work_id, max(score) AS score FROM (
            SELECT dimension, work_id, neighbor_work_id, score FROM graph_neighbors
            UNION ALL SELECT dimension, neighbor_work_id, work_id, score FROM graph_neighbors) GROUP BY 1, 2, 3) n
    JOIN graph_works a ON a.work_id = n.work_id JOIN graph_works b ON b.work_id = n.neighbor_work_id AND a.graph_id = b.graph_id"""


def node_relations(t, **how):
    return rel.node_relations(t.relations, t.relation_members, t.citations, graph_neighbors(t), t.graph_works, **how)


@query("e20_node_relations", """
    SELECT * REPLACE (neighbor_work_id::VARCHAR AS neighbor_work_id, round(score, 6) AS score) FROM node_relations""")
def _(t):
    out = node_relations(t)
    return out.withColumn("neighbor_work_id", F.col("neighbor_work_id").cast("string")).withColumn("score", F.round("score", 6))


@query("e20_outgoing_relations", """
    SELECT graph_id, work_id, kind, detail, ref FROM node_relations
    WHERE direction = 'outgoing' AND kind <> 'related' AND (kind <> 'assertion' OR detail IN ('improves_on', 'uses_method_from'))""")
def _(t):
    out = node_relations(t, direction="outgoing", types=["Improves_on", "uses_method_from"])
    return out.where("kind NOT IN ('related', 'neighbor')").select("graph_id", "work_id", "kind", "detail", "ref")


@query("e20_related_titles", """
    SELECT DISTINCT n.graph_id, n.work_id, n.neighbor_work_id, w.title, w.year FROM node_relations n JOIN titled w ON w.work_id = n.neighbor_work_id""")
def _(t):
    return rel.related_titles(node_relations(t), t.works, t.versions)


@query("e21_node_contexts", """
    WITH vis AS (SELECT * FROM node_comments c WHERE (visibility = 'team' OR user_id = 3) AND EXISTS (
        SELECT 1 FROM graph_works g WHERE g.graph_id = c.graph_id AND g.work_id = c.work_id)),
    nodes AS (SELECT graph_id, work_id FROM node_relations UNION SELECT graph_id, work_id FROM vis)
    SELECT n.graph_id, n.work_id, s.section, s.item_id FROM nodes n JOIN (
        SELECT work_id, 'version' AS section, version_id::VARCHAR AS item_id FROM versions
        UNION ALL SELECT work_id, 'author', author_id::VARCHAR FROM work_authors
        UNION ALL SELECT work_id, 'claim', claim_id::VARCHAR FROM claims
        UNION ALL SELECT work_id, 'method', method_id::VARCHAR FROM methods UNION ALL SELECT work_id, 'aspect', aspect FROM paper_aspects
        UNION ALL SELECT work_id, 'evidence', evidence_id::VARCHAR FROM work_evidence) s ON s.work_id = n.work_id
    UNION ALL (SELECT graph_id, work_id, 'comment', comment_id::VARCHAR FROM vis
        QUALIFY row_number() OVER (PARTITION BY graph_id, work_id ORDER BY created_at DESC) <= 50)
    UNION ALL SELECT graph_id, work_id, kind, coalesce(ref, neighbor_work_id::VARCHAR) FROM node_relations""")
def _(t):
    out = reads.node_context(t, t.graph_works, reads.visible_to(t.node_comments, 3), node_relations(t))
    return out.select("graph_id", "work_id", "section", "item_id")


@query("e22_pair_briefs", """
    WITH p AS (SELECT doc_id, 'title: ' || source || chr(10) || 'abstract: ' || text[1:1500] || chr(10) || 'methods:' || chr(10)
        || CASE WHEN doc_id % 5 = 0 THEN '(none extracted)' ELSE array_to_string(list_transform(ls, lambda x: '- ' || x || ': ' || lang), chr(10)) END
        || chr(10) || 'claims:' || chr(10) || array_to_string(list_transform(ls, lambda x: '- ' || x), chr(10)) || chr(10) AS body
        FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))
    SELECT a.doc_id AS a_work_id, b.doc_id AS b_work_id, md5('Compare paper A and paper B. Propose whitelist relations if any.' || chr(10) || chr(10)
        || '### Paper A' || chr(10) || a.body || '### Paper B' || chr(10) || b.body) AS prompt_md5
    FROM p a JOIN p b ON b.doc_id = (a.doc_id * 3 + 1) % (SELECT count(*) FROM documents)""")
def _(t):
    key, lines = F.col("doc_id"), F.split("text", "\n")
    named = F.transform(lines, lambda s: F.struct(s.alias("name"), F.col("lang").alias("description")))
    papers = t.spread("documents").select(
        key.alias("work_id"), F.col("source").alias("title"), F.col("text").alias("abstract"),
        F.when(key % 5 == 0, F.slice(named, 1, 0)).otherwise(named).alias("methods"), lines.alias("claims"))
    pairs = t.spread("documents").select(key.alias("a_work_id"), ((key * 3 + 1) % t.size("documents")).alias("b_work_id"))
    return rel.pair_briefs(pairs, papers).select("a_work_id", "b_work_id", F.md5("prompt").alias("prompt_md5"))


@query("e23_context_prompts", """
    WITH c AS (SELECT doc_id, i, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) AS pos, ls[i + 1] AS text, lang
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents) d, range(0, 20000) r(i) WHERE i < len(ls) AND i % 3 <> 1)
    SELECT doc_id AS work_id, pos // 12 AS batch_no, count(*) AS contexts, md5('Citing paper title: ' || any_value(source) || chr(10) || chr(10)
        || 'Classify each citation context below.' || chr(10) || chr(10) || string_agg('### context_id=c' || i || chr(10) || 'page=' || (i % 5) || chr(10)
        || 'cited_title=' || CASE WHEN i % 2 = 0 THEN c.lang ELSE '(unknown)' END || chr(10) || 'context:' || chr(10) || c.text || chr(10) || chr(10), '' ORDER BY i)) AS prompt_md5
    FROM c JOIN documents USING (doc_id) GROUP BY 1, 2""")
def _(t):
    lines = t.spread("documents").select(
        F.col("doc_id").alias("work_id"), F.col("lang"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    i = F.col("position")
    contexts = lines.where(i % 3 != 1).select(
        "work_id", "position", F.concat(F.lit("c"), i.cast("string")).alias("context_id"), "text", (i % 5).alias("page"),
        F.when(i % 2 == 0, F.col("lang")).alias("cited_title"))
    titles = t.spread("documents").select(F.col("doc_id").alias("work_id"), F.col("source").alias("title"))
    out = rel.context_prompts(contexts, titles)
    return out.select("work_id", "batch_no", "contexts", F.md5("prompt").alias("prompt_md5"))


@query("e24_grounded_evidence", """
    WITH seg AS (SELECT doc_id AS version_id, i % 4 AS page, i AS segment_no, ls[i + 1] AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d, range(0, 20000) r(i) WHERE i < len(ls)),
    ev AS (SELECT version_id * 100000 + segment_no AS evidence_id, version_id, (page + segment_no % 2) % 4 AS page, text,
        segment_no % 10 = 0 AS boxed FROM seg)
    SELECT e.evidence_id, CASE WHEN boxed THEN 'box' WHEN min(s.segment_no) IS NOT NULL THEN 'segment' ELSE 'none' END AS how,
           CASE WHEN NOT boxed THEN min(s.segment_no) END::VARCHAR AS segment_no
    FROM ev e LEFT JOIN seg s ON s.version_id = e.version_id AND s.page = e.page AND e.text <> '' AND contains(lower(s.text), lower(e.text[1:12]))
    GROUP BY e.evidence_id, boxed""")
def _(t):
    seg = t.spread("documents").select(
        F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("segment_no", "text")
    ).withColumn("page", F.col("segment_no") % 4)
    n = F.col("segment_no")
    quotes = seg.select(
        (F.col("version_id") * 100_000 + n).alias("evidence_id"), "version_id", ((F.col("page") + n % 2) % 4).alias("page"),
        "text", F.when(n % 10 == 0, '{"x":1,"y":2,"w":3,"h":4}').alias("bbox"))
    out = rel.ground_evidence(quotes, seg)
    return out.select("evidence_id", "how", F.col("segment_no").cast("string").alias("segment_no"))
