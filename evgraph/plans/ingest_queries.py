"""A and C: sources, table maintenance, record linkage, merging."""

from pyspark.sql import functions as F

from evgraph import schemas
from evgraph.functions.scores import synthetic_id
from evgraph.operators import contexts, linkage, merge, tables
from evgraph.plans import derived
from evgraph.plans.oracle_views import arxiv_of, norm
from evgraph.plans.registry import query
from evgraph.session import materialize
from evgraph.sources import gold, paper_text, reading_list

_RAW = sorted(schemas.RAW)


@query("a1_typed_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in _RAW))
def _(t):
    out = None
    for name in _RAW:
        one = t.raw(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("a2_reading_list_lines", "SELECT * FROM parsed_lines")
def _(t):
    return reading_list.parse_lines(derived.import_lines(t)).drop("line")


_OUTCOMES = """
    SELECT l.seq, CASE WHEN l.arxiv_id IS NULL AND l.doi IS NULL THEN 'skipped'
        WHEN a.work_id IS NOT NULL OR d.work_id IS NOT NULL THEN 'matched'
        WHEN l.seq = min(l.seq) OVER (PARTITION BY coalesce(l.arxiv_id, l.doi)) THEN 'created' ELSE 'matched' END AS outcome
    FROM parsed_lines l LEFT JOIN versions a ON a.arxiv_id = l.arxiv_id LEFT JOIN versions d ON d.doi = l.doi"""


@query("a3_import_outcomes", _OUTCOMES)
def _(t):
    parsed = reading_list.parse_lines(derived.import_lines(t))
    return reading_list.confirm(parsed, t.works, t.versions)


@query("a3_import_counts", f"""
    SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome <> 'created') AS skipped
    FROM ({_OUTCOMES})""")
def _(t):
    parsed = reading_list.parse_lines(derived.import_lines(t))
    return reading_list.confirm_counts(reading_list.confirm(parsed, t.works, t.versions))


def _markup_text():
    from evgraph.plans.text_queries import sql_html_to_text

    return sql_html_to_text("m.html")


@query("a4_extraction_texts", f"""
    SELECT version_id, CASE WHEN length(body) > 200 THEN 'file:' || path ELSE 'title_abstract' END AS source_kind,
           md5(CASE WHEN length(body) > 200 THEN body ELSE meta END[1:120000]) AS text_md5,
           length(CASE WHEN length(body) > 200 THEN body ELSE meta END)::INTEGER AS original_chars
    FROM (SELECT v.version_id, path, v.title || chr(10) || chr(10) || v.abstract AS meta, {_markup_text()} AS body
          FROM versions v LEFT JOIN markup m ON m.version_id = v.version_id)""")
def _(t):
    out = paper_text.extraction_text(t.versions, derived.markup(t))
    return out.select("version_id", "source_kind", F.md5("text").alias("text_md5"), "original_chars")


@query("a5_source_texts", r"""
    SELECT work_id, version_id, kind AS source_kind, length(body)::INTEGER AS original_chars, length(body) > 50000 AS truncated,
           md5(body[1:50000]) AS text_md5
    FROM (SELECT v.work_id, v.version_id,
              CASE WHEN path IS NULL THEN 'metadata' WHEN path LIKE '%.html' THEN 'html' ELSE 'tei' END AS kind,
              coalesce(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*$', '', 'g'), '<[^>]*>|>', ' ', 'g'), '\s+', ' ', 'g')),
                       v.title || chr(10) || chr(10) || v.abstract) AS body
          FROM versions v LEFT JOIN markup m ON m.version_id = v.version_id WHERE v.version_id % 2 = 0)""")
def _(t):
    out = paper_text.read_sources(paper_text.chosen_versions(t.works, t.versions), derived.markup(t))
    return out.withColumn("text_md5", F.md5("text")).drop("text")


@query("a6_gold_annotations", "SELECT name, arxiv_id, item_no, type, target_arxiv FROM gold_relations")
def _(t):
    parsed = gold.parse_gold(derived.gold(t))
    return parsed.select("name", "arxiv_id", F.posexplode("relations").alias("item_no", "x")).select(
        "name", "arxiv_id", "item_no", "x.type", "x.target_arxiv"
    )


@query("a7_latest_upsert", """
    SELECT user_id, work_id, status, starred, event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, work_id ORDER BY src, event_id DESC) AS rn FROM (
            SELECT *, CASE WHEN starred THEN 0 ELSE 1 END AS src FROM reading_raw)) WHERE rn = 1""")
def _(t):
    key, cols = ["user_id", "work_id"], ["user_id", "work_id", "status", "starred", "event_id"]
    stored = tables.upsert_latest(t.reading_raw.where("NOT starred").select(*cols), key, ["event_id"])
    return tables.upsert(stored, t.reading_raw.where("starred").select(*cols), key, ["event_id"])


@query("a8_insert_ignore", """
    SELECT DISTINCT (p_partkey * 3) % 25 AS graph_id, p_partkey AS work_id FROM part
    EXCEPT SELECT graph_id, work_id FROM graph_works""")
def _(t):
    key = F.col("p_partkey")
    new = t.raw("part").select(((key * 3) % 25).alias("graph_id"), key.alias("work_id"))
    return tables.insert_ignore(t.graph_works, new.unionByName(new), ["graph_id", "work_id"])


@query("a9_whole_library_to_graph", """
    SELECT 3::BIGINT AS graph_id, work_id, 1::BIGINT AS added_by FROM works
    WHERE work_id NOT IN (SELECT work_id FROM graph_works WHERE graph_id = 3)""")
def _(t):
    return tables.add_to_graph(t.graph_works, t.works, 3, 1)


_RESOLVED = f"""
    SELECT seq, coalesce(a.work_id, d.work_id, y.work_id) AS matched,
        CASE WHEN a.work_id IS NOT NULL THEN 'arxiv' WHEN d.work_id IS NOT NULL THEN 'doi'
             WHEN y.work_id IS NOT NULL THEN 'title_year' ELSE 'new' END AS match_kind
    FROM records r LEFT JOIN versions a ON a.arxiv_id = r.arxiv_id LEFT JOIN versions d ON d.doi = r.doi
    LEFT JOIN (SELECT w.title_norm, v.year, min(w.work_id) AS work_id FROM works w
               JOIN versions v ON v.version_id = w.primary_version_id GROUP BY 1, 2) y
        ON y.title_norm = {norm('r.title')} AND y.year = r.year"""


@query("c1_resolved_works", f"SELECT seq, matched::VARCHAR AS matched_work_id, match_kind FROM ({_RESOLVED})")
def _(t):
    out = linkage.resolve_works(derived.records(t), t.works, t.versions)
    return out.select("seq", F.col("matched_work_id").cast("string").alias("matched_work_id"), "match_kind")


# One record after the other decides what founds a work: not a set query, checked by brute force in tests.
@query("c2_records_grouped")
def _(t):
    out = linkage.resolve_works(derived.records(t), t.works, t.versions).where("match_kind = 'new'")
    return linkage.assign_new_works(out).select("seq", "founder_seq", "link_kind")


@query("c3_new_works", f"""
    SELECT sha256('work|' || o.seq)[:32] AS work_id, sha256('version|' || o.seq)[:32] AS version_id,
           {norm("coalesce(l.title, 'arXiv:' || l.arxiv_id, 'DOI:' || l.doi)")} AS title_norm,
           CASE WHEN l.arxiv_id IS NOT NULL THEN 'arxiv' ELSE 'other' END AS kind, l.arxiv_id, l.doi, l.url
    FROM ({_OUTCOMES}) o JOIN parsed_lines l ON l.seq = o.seq WHERE o.outcome = 'created'""")
def _(t):
    parsed = reading_list.importable(reading_list.parse_lines(derived.import_lines(t)))
    resolved = linkage.resolve_works(parsed, t.works, t.versions).where("match_kind = 'new'")
    founders = linkage.assign_new_works(resolved).where("link_kind = 'new'")
    works, versions = linkage.new_works(founders)
    return works.drop("created_by").join(versions.drop("work_id"), works.primary_version_id == versions.version_id).select(
        "work_id", "version_id", "title_norm", "kind", "arxiv_id", "doi", "url"
    )


@query("c4_author_links", """
    WITH known AS (SELECT lower(split_part(text, ' ', 1)) AS full_name, min(item_id)::VARCHAR AS author_id FROM benchmark GROUP BY 1),
    listed AS (SELECT doc_id * 2 AS version_id, unnest(ws) AS full_name, generate_subscripts(ws, 1) - 1 AS position
               FROM (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents))
    SELECT version_id, min(position)::INTEGER AS position,
           coalesce(k.author_id, sha256('author|' || l.full_name)[:32]) AS author_id
    FROM listed l LEFT JOIN known k ON k.full_name = l.full_name GROUP BY version_id, l.full_name, k.author_id""")
def _(t):
    known = t.raw("benchmark").select(
        F.col("item_id").alias("author_id"), F.lower(F.substring_index("text", " ", 1)).alias("full_name"))
    names = t.raw("documents").select((F.col("doc_id") * 2).alias("version_id"), F.split(F.lower("text"), " ").alias("names"))
    return linkage.link_authors(known, names)[1]


_REFERENCES = f"""
    SELECT doc_id AS work_id, 0 AS position, NULL AS title, {arxiv_of('((doc_id * 7 + 3) % n)')} AS arxiv_id,
           '10.1000/' || ((doc_id * 5) % n) AS doi, 2001 AS year FROM documents, (SELECT count(*) AS n FROM part)
    UNION ALL
    SELECT doc_id, 1, lang, NULL, '10.1000/' || ((doc_id * 5) % n), 2002 FROM documents, (SELECT count(*) AS n FROM part)
    UNION ALL SELECT doc_id, 2, source, NULL, NULL, NULL FROM documents"""


def _references(t):
    from evgraph import taxonomy as tx

    parsed = F.from_json("raw", schemas.aspect_json(tx.ASPECTS))
    return linkage.clean_references(t.document_dna.select("work_id", parsed["references"].alias("references")))


@query("c5_clean_references", f"SELECT * REPLACE (year::VARCHAR AS year) FROM ({_REFERENCES})")
def _(t):
    return _references(t).withColumn("year", F.col("year").cast("string"))


@query("c6_resolved_citations", f"""
    SELECT r.work_id AS citing_work_id, r.position,
           CASE WHEN r.arxiv_id IS NOT NULL THEN a.work_id ELSE d.work_id END::VARCHAR AS cited_work_id,
           CASE WHEN r.arxiv_id IS NOT NULL AND a.work_id IS NULL OR r.arxiv_id IS NULL AND d.work_id IS NULL
                THEN concat_ws('|', coalesce(r.title, '-'), coalesce(r.doi, '-'), coalesce(r.year::VARCHAR, '-')) END AS external
    FROM ({_REFERENCES}) r LEFT JOIN versions a ON a.arxiv_id = r.arxiv_id LEFT JOIN versions d ON d.doi = r.doi""")
def _(t):
    x = F.col("cited_external")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    out = linkage.resolve_citations(_references(t), t.versions)
    return out.select(
        "citing_work_id", "position", F.col("cited_work_id").cast("string").alias("cited_work_id"),
        F.when(x.isNotNull(), F.concat_ws("|", dash(x["title"]), dash(x["doi"]), dash(x["year"]))).alias("external"))


_ENTRIES = f"""
    SELECT doc_id, 0 AS position, '#b0' AS target, 'One two' AS title, {arxiv_of('((doc_id * 7 + 3) % n)')} AS arxiv_id,
           NULL AS doi, 2017 AS year FROM documents, (SELECT count(*) AS n FROM part)
    UNION ALL
    SELECT doc_id, 1, '#b1', source, NULL, '10.1000/' || ((doc_id * 5) % n),
           CASE WHEN (doc_id * 5) % n BETWEEN 1900 AND 2099 THEN (doc_id * 5) % n ELSE 1998 END FROM documents, (SELECT count(*) AS n FROM part)
    UNION ALL SELECT doc_id, 2, '#b2', 'Small Ring', NULL, NULL, NULL FROM documents"""


@query("c7_resolved_bibliography", f"""
    SELECT e.doc_id, e.position, coalesce(a.work_id, d.work_id, w.work_id)::VARCHAR AS resolved_work_id FROM ({_ENTRIES}) e
    LEFT JOIN versions a ON a.arxiv_id = e.arxiv_id LEFT JOIN versions d ON d.doi = e.doi
    LEFT JOIN (SELECT title_norm, min(work_id) AS work_id FROM works GROUP BY 1) w ON w.title_norm = {norm('e.title')}""")
def _(t):
    entries = linkage.tei_bibliography(derived.tei_documents(t))
    out = linkage.resolve_bibliography(entries, t.works, t.versions)
    return out.select("doc_id", "position", F.col("resolved_work_id").cast("string").alias("resolved_work_id"))


def _merge_tables(t):
    return {
        "works": t.works.select("work_id", "title_norm", "primary_version_id", "created_at"),
        "versions": t.versions.select("version_id", "work_id", "title", "created_at"),
        "claims": t.claims,
        "citations": t.citations,
        "relation_members": t.relation_members,
        "work_projects": t.work_projects,
        "graph_works": t.graph_works,
        "reading_status": t.reading_status.select("user_id", "work_id", "status", "starred", "updated_at"),
        "neighbors": t.citations.select(
            F.lit("cites").alias("dimension"), F.col("citing_work_id").alias("work_id"),
            F.col("cited_work_id").alias("neighbor_work_id"), F.lit(0.5).alias("score")).distinct(),
        "node_comments": t.node_comments.select("comment_id", "work_id"),
    }


def _accepted(t, data):
    return merge.check_merges(derived.merge_proposals(t), data).where("verdict = 'ok'").drop("verdict")


@query("c8_merge_verdicts", "SELECT history_id, kept_work_id, merged_work_id, verdict FROM verdicts")
def _(t):
    return merge.check_merges(derived.merge_proposals(t), _merge_tables(t))


def _rows(data):
    """All tables as (name, a, b, c) text rows."""
    s = lambda *cs: [F.col(c).cast("string").alias(n) for n, c in zip("abc", cs)]
    keys = {
        "works": ["work_id", "primary_version_id", "title_norm"],
        "versions": ["version_id", "work_id", "title"],
        "claims": ["claim_id", "work_id", "source"],
        "citations": ["citation_id", "citing_work_id", "cited_work_id"],
        "work_projects": ["work_id", "project_id", "project_id"],
        "graph_works": ["graph_id", "work_id", "added_by"],
        "reading_status": ["user_id", "work_id", "status"],
        "neighbors": ["work_id", "neighbor_work_id", "dimension"],
        "node_comments": ["comment_id", "work_id", "work_id"],
    }
    out = None
    for name, cols in keys.items():
        one = data[name].select(F.lit(name).alias("name"), *s(*cols))
        out = one if out is None else out.unionByName(one)
    rm = data["relation_members"]
    members = rm.select(
        F.lit("relation_members").alias("name"), F.concat_ws("/", "relation_id", "role", "entity_kind").alias("a"),
        F.col("entity_id").cast("string").alias("b"), F.col("anchor_work_id").cast("string").alias("c"))
    return out.unionByName(members)


def _to_kept(c):
    return f"coalesce((SELECT kept_work_id FROM merges WHERE merged_work_id = {c}), {c})"


@query("c9_merged_tables", f"""
    WITH
    kw AS MATERIALIZED (SELECT merged_work_id AS m, kept_work_id AS k FROM merges),
    rd AS (SELECT r.user_id, coalesce(k, work_id) AS work_id, status, starred, updated_at, k IS NULL AS own
           FROM reading_status r LEFT JOIN kw ON m = work_id),
    gw AS (SELECT g.graph_id, coalesce(k, work_id) AS work_id, added_by, k IS NULL AS own FROM graph_works g LEFT JOIN kw ON m = work_id),
    nb AS (SELECT DISTINCT coalesce(a.k, citing_work_id) AS x, coalesce(b.k, cited_work_id) AS y FROM citations
           LEFT JOIN kw a ON a.m = citing_work_id LEFT JOIN kw b ON b.m = cited_work_id)
    SELECT 'works' AS name, work_id::VARCHAR AS a, primary_version_id::VARCHAR AS b, title_norm AS c FROM works
        WHERE work_id NOT IN (SELECT m FROM kw)
    UNION ALL SELECT 'versions', version_id::VARCHAR, coalesce(k, work_id)::VARCHAR, title FROM versions LEFT JOIN kw ON m = work_id
    UNION ALL SELECT 'claims', claim_id::VARCHAR, coalesce(k, work_id)::VARCHAR, source FROM claims LEFT JOIN kw ON m = work_id
    UNION ALL SELECT 'citations', citation_id, coalesce(a.k, citing_work_id)::VARCHAR, coalesce(b.k, cited_work_id)::VARCHAR
        FROM citations LEFT JOIN kw a ON a.m = citing_work_id LEFT JOIN kw b ON b.m = cited_work_id
    UNION ALL SELECT DISTINCT 'work_projects', coalesce(k, work_id)::VARCHAR, project_id::VARCHAR, project_id::VARCHAR
        FROM work_projects LEFT JOIN kw ON m = work_id
    UNION ALL SELECT 'graph_works', graph_id::VARCHAR, work_id::VARCHAR, added_by::VARCHAR FROM gw
        QUALIFY row_number() OVER (PARTITION BY graph_id, work_id ORDER BY own DESC) = 1
    UNION ALL SELECT 'reading_status', user_id::VARCHAR, work_id::VARCHAR, status FROM rd
        QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY updated_at DESC, own DESC) = 1
    UNION ALL SELECT 'neighbors', x::VARCHAR, y::VARCHAR, 'cites' FROM nb WHERE x <> y
    UNION ALL SELECT 'node_comments', comment_id::VARCHAR, coalesce(k, work_id)::VARCHAR, coalesce(k, work_id)::VARCHAR
        FROM node_comments LEFT JOIN kw ON m = work_id
    UNION ALL SELECT 'relation_members', relation_id || '/' || role || '/' || entity_kind,
        (CASE WHEN entity_kind = 'work' THEN coalesce(a.k, entity_id) ELSE entity_id END)::VARCHAR, coalesce(b.k, anchor_work_id)::VARCHAR
        FROM relation_members LEFT JOIN kw a ON a.m = entity_id LEFT JOIN kw b ON b.m = anchor_work_id""")
def _(t):
    data = _merge_tables(t)
    return _rows(merge.apply_merges(data, materialize(_accepted(t, data), "merges")))


# Merge and split bring every moved row back; copies made for the kept work stay with it.
@query("c10_split_tables", """
    WITH kw AS MATERIALIZED (SELECT merged_work_id AS m, kept_work_id AS k FROM merges),
    rd AS (SELECT r.user_id, k AS work_id, status, updated_at, false AS own FROM reading_status r JOIN kw ON m = work_id
           UNION ALL SELECT user_id, work_id, status, updated_at, true FROM reading_status),
    gw AS (SELECT g.graph_id, k AS work_id, added_by, false AS own FROM graph_works g JOIN kw ON m = work_id
           UNION ALL SELECT graph_id, work_id, added_by, true FROM graph_works),
    cn AS (SELECT DISTINCT citing_work_id AS x, cited_work_id AS y FROM citations),
    nb AS (SELECT x, y FROM cn UNION
           SELECT coalesce(a.k, x), coalesce(b.k, y) FROM cn LEFT JOIN kw a ON a.m = x LEFT JOIN kw b ON b.m = y)
    SELECT 'works' AS name, work_id::VARCHAR AS a, primary_version_id::VARCHAR AS b, title_norm AS c FROM works
    UNION ALL SELECT 'versions', version_id::VARCHAR, work_id::VARCHAR, title FROM versions
    UNION ALL SELECT 'claims', claim_id::VARCHAR, work_id::VARCHAR, source FROM claims
    UNION ALL SELECT 'citations', citation_id, citing_work_id::VARCHAR, cited_work_id::VARCHAR FROM citations
    UNION ALL (SELECT 'work_projects', work_id::VARCHAR, project_id::VARCHAR, project_id::VARCHAR FROM work_projects
        UNION SELECT 'work_projects', k::VARCHAR, project_id::VARCHAR, project_id::VARCHAR FROM work_projects JOIN kw ON m = work_id)
    UNION ALL SELECT 'graph_works', graph_id::VARCHAR, work_id::VARCHAR, added_by::VARCHAR FROM gw
        QUALIFY row_number() OVER (PARTITION BY graph_id, work_id ORDER BY own DESC) = 1
    UNION ALL SELECT 'reading_status', user_id::VARCHAR, work_id::VARCHAR, status FROM rd
        QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY updated_at DESC, own DESC) = 1
    UNION ALL SELECT 'neighbors', x::VARCHAR, y::VARCHAR, 'cites' FROM nb WHERE x <> y
    UNION ALL SELECT 'node_comments', comment_id::VARCHAR, coalesce(k, work_id)::VARCHAR, coalesce(k, work_id)::VARCHAR
        FROM node_comments LEFT JOIN kw ON m = work_id
    UNION ALL SELECT 'relation_members', relation_id || '/' || role || '/' || entity_kind, entity_id::VARCHAR, anchor_work_id::VARCHAR
        FROM relation_members""")
def _(t):
    data = _merge_tables(t)
    merges = materialize(_accepted(t, data), "merges")
    snapshot = merge.take_snapshot(data, merges)
    # versions and works are read several times below; the merged tables are stored as a job would
    merged = {k: materialize(v, k) for k, v in merge.apply_merges(data, merges).items()}
    return _rows(merge.apply_splits(merged, merges, snapshot))


@query("c11_repaired_primary", """
    SELECT work_id, CASE work_id % 3 WHEN 2 THEN primary_version_id ELSE work_id * 2 END AS primary_version_id FROM works""")
def _(t):
    key = F.col("work_id")
    broken = F.when(key % 3 == 0, F.lit(None)).when(key % 3 == 1, key * 2 + 2).otherwise(F.col("primary_version_id"))
    works = t.works.withColumn("primary_version_id", broken)
    return linkage.repair_primary(works, t.versions).select("work_id", "primary_version_id")


@query("c12_patched_versions", f"""
    WITH patch AS (SELECT doc_id * 2 AS version_id, CASE WHEN doc_id % 2 = 0 THEN split_part(text, chr(10), 1) END AS title,
            CASE WHEN doc_id % 3 = 0 THEN lang ELSE text[1:1500] END AS abstract, CASE WHEN doc_id % 5 = 0 THEN 2020 END AS year
        FROM documents)
    SELECT v.version_id, md5(coalesce(p.title, v.title)) AS title_md5, md5(coalesce(p.abstract, v.abstract)) AS abstract_md5,
           coalesce(p.year, v.year)::INTEGER AS year, coalesce({norm('p.title')}, w.title_norm) AS work_title
    FROM versions v JOIN works w ON w.work_id = v.work_id LEFT JOIN patch q ON q.version_id = w.primary_version_id
    LEFT JOIN patch p ON p.version_id = v.version_id WHERE v.version_id % 2 = 0""")
def _(t):
    key = F.col("doc_id")
    nil = F.lit(None).cast("string")
    patches = t.raw("documents").select(
        (key * 2).alias("version_id"), F.when(key % 2 == 0, F.substring_index("text", "\n", 1)).alias("title"),
        F.when(key % 3 == 0, F.col("lang")).alias("abstract"), F.col("text").alias("full_text"),
        F.when(key % 5 == 0, 2020).alias("year"), nil.alias("venue_name"), nil.alias("doi"),
        nil.alias("metadata_source"))
    versions, works = linkage.patch_versions(t.versions, t.works, patches)
    named = works.select(F.col("primary_version_id").alias("version_id"), F.col("title_norm").alias("work_title"))
    return versions.join(named, "version_id").select(
        "version_id", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"), "year", "work_title")


@query("c13_tei_bibliography", f"SELECT * REPLACE (year::VARCHAR AS year) FROM ({_ENTRIES})")
def _(t):
    out = linkage.tei_bibliography(derived.tei_documents(t))
    return out.withColumn("year", F.col("year").cast("string"))


# Byte windows cut at character bounds: no SQL counterpart, checked by brute force in tests.
@query("c14_citation_contexts")
def _(t):
    out = contexts.citation_contexts(derived.tei_documents(t))
    return out.select("doc_id", "context_id", "target", "page", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))
