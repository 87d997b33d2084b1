"""Inputs that exist in no driver table as such: import lines, records, model output, TEI, gold.

Each is built by Spark from a whole driver table; DERIVED_VIEWS says the same in SQL.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.plans.oracle_views import VIEWS, arxiv_of, in_list, words
from evgraph.sources.bindings import Library, pick


def arxiv(key):
    return F.concat(
        F.lpad((F.lit(1000) + F.floor(key / 100000)).cast("string"), 4, "0"), F.lit("."),
        F.lpad((key % 100000).cast("string"), 5, "0"))


def import_lines(t: Library) -> DataFrame:
    """One line per part in eight notations, and every page address; ids partly unknown to the library."""
    n = t.size("part")
    key = F.col("p_partkey")
    k = (key * key) % (n * 2)
    a, d = arxiv(k), F.concat(F.lit("10.1000/"), k.cast("string"))
    notations = [
        F.concat("p_name", F.lit(" | https://arxiv.org/abs/"), a, F.lit("v2")),
        F.concat(F.lit("  https://arxiv.org/pdf/"), a, F.lit(".pdf  ")),
        F.concat("p_name", F.lit("\thttps://doi.org/"), d),
        d,
        F.concat("p_name", F.lit(", http://example.org/"), key.cast("string")),
        F.col("p_name"),
        F.concat(F.lit("# "), "p_name"),
        F.concat("p_name", F.lit(" ; http://arxiv.org/abs/"), a),
    ]
    line = F.element_at(F.array(*notations), (key % 8 + 1).cast("int"))
    parts = t.raw("part").select(key.alias("seq"), line.alias("line"))
    pages = t.raw("pages").select((F.col("page_id") + n).alias("seq"), F.col("url").alias("line"))
    return parts.unionByName(pages)


def records(t: Library) -> DataFrame:
    n = t.size("part")
    key = F.col("p_partkey")
    k = (key * key) % (n * 2)
    return t.raw("part").select(
        key.alias("seq"),
        F.when(key % 3 == 0, arxiv(k)).alias("arxiv_id"),
        F.when(key % 3 != 2, F.concat(F.lit("10.1000/"), ((k * 5) % (n * 2)).cast("string"))).alias("doi"),
        F.when(key % 4 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.col("p_name")).alias("title"),
        F.when(key % 2 == 0, F.lit(1990) + F.col("p_size")).alias("year"),
    )


def markup(t: Library) -> DataFrame:
    key = F.col("page_id")
    ending = F.when(key % 4 == 3, ".tei").otherwise(".html")
    return t.spread("pages").select(
        (key * 2).alias("version_id"), F.concat(key.cast("string"), ending).alias("path"), "html")


def article_pages(t: Library) -> DataFrame:
    """Documents dressed as rendered papers: title, authors, abstract, whole text as body."""
    span = lambda c: F.concat(F.lit('<span class="ltx_personname">'), c, F.lit("</span>"))
    first = F.substring_index("text", "\n", 1)
    html = F.concat(
        F.lit("<html><head><title> "), F.col("source"), F.lit(" &amp; "), F.col("lang"),
        F.lit(' – ar5iv</title></head><div class="ltx_page_content">'),
        span(F.concat(F.lit("<b>"), "source", F.lit("</b>  Doe"))), span(F.col("lang")), span(F.col("lang")),
        span(F.lit("x")),
        F.lit('<div class="ltx_abstract">Abstract. '), first, F.lit("</div><p>"), F.col("text"),
        F.lit("</p><footer>end</footer></div></html>"))
    return t.spread("documents").select("doc_id", html.alias("html"))


def tei_documents(t: Library) -> DataFrame:
    """Documents with a citation mark after every line and a bibliography of three entries."""
    lines = F.split("text", "\n")
    n = t.size("part")
    key = F.col("doc_id")
    mark = lambda i: F.concat(
        F.lit(' <ref type="bibr" target="#b'), (i % 3).cast("string"), F.lit('" coords="'),
        (i + 1).cast("string"), F.lit(' 10 20 30.5 44">['), i.cast("string"), F.lit("]</ref> "))
    body = F.array_join(F.transform(lines, lambda s, i: F.concat(s, mark(i))), "\n")
    a, d = arxiv((key * 7 + 3) % n), ((key * 5) % n).cast("string")
    back = F.concat(
        F.lit('</p></body><back><listBibl><biblStruct xml:id="b0"><analytic><title level="a">One <i>two</i></title>'),
        F.lit('</analytic><date type="published" when="2017-05" /><idno type="arXiv">arXiv:'), a,
        F.lit('</idno></biblStruct><biblStruct xml:id="b1"><title>'), F.col("source"),
        F.lit('</title> <idno type="doi">10.1000/'), d,
        F.lit('</idno> <imprint>Vol 12345, 1998.</imprint></biblStruct><biblStruct xml:id="b2"><title>Small '),
        F.lit("Ring</title></biblStruct><biblStruct xml:id=\"b3\"><note>nothing</note></biblStruct></listBibl></back></TEI>"),
    )
    return t.spread("documents").select("doc_id", F.concat(F.lit("<TEI><body><p>"), body, back).alias("tei"))


def context_outputs(t: Library) -> DataFrame:
    """Classification replies: good, weak, wrong type, unknown context, no quote; for every seventh order also one of
    a second batch that names a context of the first, which it may not."""
    own, foreign = _replies(t, 0), _replies(t, 1).where("work_id % 7 = 0")
    return own.unionByName(foreign)


def _replies(t: Library, batch: int) -> DataFrame:
    key = F.col("o_orderkey")
    kind = pick(tx.RELATION_TYPES + ["none"], (key + batch) % 13)
    item = F.struct(
        F.when(key % 11 == 0, "c9").otherwise("c0").alias("context_id"),
        F.concat(F.lit(" "), F.upper(kind)).alias("type"),
        F.when(key % 2 == 0, "scope").otherwise("").alias("aspect"),
        F.col("o_orderpriority").alias("explanation"),
        F.when(key % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("evidence_text"),
        F.round((F.col("o_totalprice") % 100) / 100, 4).alias("confidence"),
    )
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("classifications"))), F.lit("\n```"))
    return t.spread("orders").select(
        key.alias("work_id"), (key * 2).alias("version_id"), F.lit(batch).alias("batch"), fenced.alias("raw"))


def contexts_of_orders(t: Library) -> DataFrame:
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        key.alias("work_id"), F.lit(0).alias("batch"), F.lit("c0").alias("context_id"), F.lit("#b0").alias("target"),
        F.when(key % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("text"), (key % 4 - 1).cast("int").alias("page"),
        F.lit(None).cast("string").alias("bbox"))


def targets_of_orders(t: Library) -> DataFrame:
    key = F.col("o_orderkey")
    return t.raw("orders").select(
        key.alias("work_id"), F.lit("#b0").alias("target"),
        F.when(key % 17 == 0, key).otherwise(F.col("o_custkey")).alias("resolved_work_id"))


def pair_outputs(t: Library) -> DataFrame:
    key = F.col("o_orderkey")
    kind = pick(tx.RELATION_TYPES + ["none"], (key * 5) % 13)
    ends = [F.when(key % 3 == 0, x).when(key % 3 == 1, y).otherwise("A") for x, y in (("A", "B"), ("B", "A"))]
    item = F.struct(
        kind.alias("type"), ends[0].alias("source_paper"), ends[1].alias("target_paper"),
        F.lit("").alias("aspect"), F.col("o_orderstatus").alias("explanation"),
        F.when(key % 10 == 0, " ").otherwise(F.col("o_orderpriority")).alias("evidence_quote"),
        F.when(key % 2 == 0, "A").otherwise("B").alias("evidence_from"),
        F.round((F.col("o_totalprice") % 100) / 100, 4).alias("confidence"),
    )
    raw = F.to_json(F.struct(F.array(item, item).alias("relations")))
    a, b = F.col("o_custkey"), (key * 23) % t.size("customer")
    return t.spread("orders").select(
        a.alias("a_work_id"), (a * 2).alias("a_version_id"), b.alias("b_work_id"), (b * 2).alias("b_version_id"),
        raw.alias("raw"))


def claim_method_outputs(t: Library) -> DataFrame:
    """The other output layout: every line of a document is a claim and a method."""
    lines = F.split("text", "\n")
    claims = F.transform(
        lines,
        lambda s, i: F.struct(
            s.alias("text"), F.when(i % 3 == 0, "").otherwise(F.lit("quote")).alias("source_text"),
            (i % 4).cast("int").alias("page")))
    methods = F.transform(
        lines,
        lambda s, i: F.struct(
            F.when(i % 5 == 0, "").otherwise(s).alias("name"), F.col("lang").alias("description"),
            F.col("source").alias("source_text"), (i % 2).cast("int").alias("page")))
    return t.spread("documents").select(
        F.col("doc_id").alias("work_id"), (F.col("doc_id") * 2).alias("version_id"),
        F.to_json(F.struct(claims.alias("claims"), methods.alias("methods"))).alias("raw"))


def gold(t: Library) -> DataFrame:
    """A gold paper per order, mistakes included, as JSON text."""
    key = F.col("o_orderkey")
    target = (key * 17) % t.size("customer")
    quote = lambda s: F.struct(s.alias("text"), F.lit("q").alias("source_text"), F.lit(1).alias("page"))
    method = lambda s: F.struct(s.alias("name"), F.lit("q").alias("source_text"), F.lit(1).alias("page"))
    relation = lambda kind, to: F.struct(kind.alias("type"), to.alias("target_arxiv"))
    body = F.struct(
        F.when(key % 19 != 0, arxiv(F.col("o_custkey"))).alias("arxiv_id"),
        F.struct(
            F.array(quote(F.col("o_orderpriority")), quote(F.when(key % 3 == 0, "").otherwise("c"))).alias("claims"),
            F.array(method(F.when(key % 5 != 0, F.lit("m")))).alias("methods"),
        ).alias("dna"),
        F.array(
            relation(pick(tx.RELATION_TYPES, key % 12), arxiv(target)),
            relation(pick(["improves_on", "cites", "bogus"], key % 3),
                     F.when(key % 4 == 0, "").when(key % 4 == 1, "9999.99999").otherwise(arxiv(target))),
        ).alias("relations"),
        F.when(key % 2 == 0, F.array(F.struct(pick(["cites", "none"], key / 2 % 2).alias("gold_type")))).alias("citation_contexts"),
    )
    return t.spread("orders").select(key.cast("string").alias("name"), F.to_json(body).alias("raw"))


def merge_proposals(t: Library) -> DataFrame:
    key = F.col("p_partkey")
    return t.raw("part").select(
        key.alias("history_id"), key.alias("kept_work_id"), ((key * 31 + 7) % t.size("part")).alias("merged_work_id"))


VIEWS |= {
    "import_lines": f"""
        SELECT p_partkey AS seq, CASE p_partkey % 8
            WHEN 0 THEN p_name || ' | https://arxiv.org/abs/' || a || 'v2'
            WHEN 1 THEN '  https://arxiv.org/pdf/' || a || '.pdf  '
            WHEN 2 THEN p_name || chr(9) || 'https://doi.org/' || d
            WHEN 3 THEN d
            WHEN 4 THEN p_name || ', http://example.org/' || p_partkey
            WHEN 5 THEN p_name
            WHEN 6 THEN '# ' || p_name
            ELSE p_name || ' ; http://arxiv.org/abs/' || a END AS line
        FROM (SELECT *, {arxiv_of('k')} AS a, '10.1000/' || k AS d
              FROM (SELECT *, (p_partkey * p_partkey) % (2 * (SELECT count(*) FROM part)) AS k FROM part))
        UNION ALL SELECT page_id + (SELECT count(*) FROM part), url FROM pages""",
    "parsed_lines": r"""
        SELECT seq, raw, CASE WHEN two THEN left_part WHEN NOT linked THEN raw END AS title,
               CASE WHEN linked THEN token END AS url, a AS arxiv_id, CASE WHEN two OR a IS NULL THEN d END AS doi,
               CASE WHEN NOT two AND NOT linked THEN 'no identifier; needs manual URL/DOI'
                    WHEN NOT two AND a IS NULL AND d IS NULL THEN 'unrecognized URL; metadata will be best-effort'
               END AS error
        FROM (SELECT *, two OR a IS NOT NULL OR d IS NOT NULL OR token LIKE 'http%' AS linked FROM (
            SELECT *, nullif(regexp_extract(token, '(\d{4}\.\d{4,5})', 1), '') AS a,
                   nullif(regexp_extract(token, '(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)', 1), '') AS d FROM (
                SELECT seq, raw, raw LIKE '%|%' OR raw LIKE '%' || chr(9) || '%' OR instr(raw, 'http') > 1 AS two,
                    CASE WHEN raw LIKE '%|%' THEN trim(split_part(raw, '|', 1))
                         WHEN raw LIKE '%' || chr(9) || '%' THEN trim(split_part(raw, chr(9), 1))
                         ELSE rtrim(raw[:instr(raw, 'http') - 1], ', ;') END AS left_part,
                    CASE WHEN raw LIKE '%|%' THEN trim(raw[instr(raw, '|') + 1:])
                         WHEN raw LIKE '%' || chr(9) || '%' THEN trim(raw[instr(raw, chr(9)) + 1:])
                         WHEN instr(raw, 'http') > 1 THEN raw[instr(raw, 'http'):] ELSE raw END AS token
                FROM (SELECT seq, trim(line) AS raw FROM import_lines) WHERE raw <> '' AND raw NOT LIKE '#%')))""",
    "records": f"""
        SELECT p_partkey AS seq, CASE WHEN p_partkey % 3 = 0 THEN {arxiv_of('k')} END AS arxiv_id,
               CASE WHEN p_partkey % 3 <> 2 THEN '10.1000/' || ((k * 5) % (2 * n)) END AS doi,
               CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_brand ELSE p_name END AS title,
               CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_size END AS year
        FROM (SELECT *, (p_partkey * p_partkey) % (2 * n) AS k
              FROM part, (SELECT count(*) AS n FROM part))""",
    "markup": """
        SELECT page_id * 2 AS version_id, page_id || CASE WHEN page_id % 4 = 3 THEN '.tei' ELSE '.html' END AS path,
               html FROM pages""",
    "gold": f"""
        SELECT o_orderkey::VARCHAR AS name, o_orderkey AS k, o_orderpriority,
               CASE WHEN o_orderkey % 19 <> 0 THEN {arxiv_of('o_custkey')} END AS arxiv_id, o_custkey,
               (o_orderkey * 17) % (SELECT count(*) FROM customer) AS target FROM orders""",
    "gold_relations": f"""
        SELECT name, arxiv_id, 0 AS item_no, {words(tx.RELATION_TYPES)}[k % 12 + 1] AS type,
               {arxiv_of('target')} AS target_arxiv FROM gold
        UNION ALL
        SELECT name, arxiv_id, 1, ['improves_on', 'cites', 'bogus'][k % 3 + 1],
               CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '9999.99999' ELSE {arxiv_of('target')} END FROM gold""",
    "proposals": """
        SELECT p_partkey AS history_id, p_partkey AS kept_work_id,
               (p_partkey * 31 + 7) % (SELECT count(*) FROM part) AS merged_work_id FROM part""",
    "proposal_links": """
        SELECT DISTINCT history_id FROM (
            SELECT p.history_id FROM proposals p JOIN citations c
                ON c.citing_work_id = p.kept_work_id AND c.cited_work_id = p.merged_work_id
            UNION ALL SELECT p.history_id FROM proposals p JOIN citations c
                ON c.citing_work_id = p.merged_work_id AND c.cited_work_id = p.kept_work_id
            UNION ALL SELECT p.history_id FROM proposals p
                JOIN relation_members a ON a.entity_kind = 'work' AND a.entity_id = p.kept_work_id
                JOIN relation_members b ON b.relation_id = a.relation_id AND b.entity_kind = 'work'
                    AND b.entity_id = p.merged_work_id)""",
    "proposal_first": """
        SELECT w, min(history_id) AS f FROM (SELECT kept_work_id AS w, history_id FROM proposals
            UNION ALL SELECT merged_work_id, history_id FROM proposals) GROUP BY 1""",
    "verdicts": """
        SELECT p.*, CASE WHEN kept_work_id = merged_work_id THEN 'self' WHEN l.history_id IS NOT NULL THEN 'linked'
            WHEN least(x.f, y.f) < p.history_id THEN 'deferred' ELSE 'ok' END AS verdict
        FROM proposals p JOIN proposal_first x ON x.w = kept_work_id JOIN proposal_first y ON y.w = merged_work_id
        LEFT JOIN proposal_links l ON l.history_id = p.history_id""",
    "merges": "SELECT history_id, kept_work_id, merged_work_id FROM verdicts WHERE verdict = 'ok'",
    "related_works": f"""
        SELECT DISTINCT a.entity_id AS work_id, b.entity_id AS neighbor_work_id FROM relation_members a
        JOIN relation_members b ON a.relation_id = b.relation_id AND a.entity_id <> b.entity_id
        JOIN relations r ON r.relation_id = a.relation_id
        WHERE a.entity_kind = 'work' AND b.entity_kind = 'work' AND r.review_status <> 'rejected'
          AND r.type NOT IN {in_list(tx.NOT_PROPOSABLE)}""",
}
