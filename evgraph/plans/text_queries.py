"""B: column functions over whole tables."""

from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.functions import geometry, scores
from evgraph.functions import text as tf
from evgraph.plans import derived
from evgraph.plans.oracle_views import arxiv_of, case, in_list, norm, squeeze, strip
from evgraph.plans.registry import query


@query("b1_normalized_titles", f"""
    SELECT doc_id, md5({norm('text')}) AS title_md5 FROM documents
    UNION ALL SELECT -p_partkey - 1, md5({norm("'  ' || p_name || '! '")}) FROM part""")
def _(t):
    title = lambda c: F.md5(tf.normalize_title(c)).alias("title_md5")
    parts = t.raw("part").select((-F.col("p_partkey") - 1).alias("doc_id"), title(F.concat(F.lit("  "), "p_name", F.lit("! "))))
    return t.spread("documents").select("doc_id", title(F.col("text"))).unionByName(parts)


@query("b2_arxiv_ids", r"""
    SELECT seq, nullif(regexp_extract(line, '(\d{4}\.\d{4,5})', 1), '') AS arxiv_id FROM import_lines""")
def _(t):
    return derived.import_lines(t).select("seq", tf.parse_arxiv_id(F.col("line")).alias("arxiv_id"))


@query("b3_dois", r"""
    SELECT seq, nullif(regexp_extract(line, '(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)', 1), '') AS doi FROM import_lines""")
def _(t):
    return derived.import_lines(t).select("seq", tf.parse_doi(F.col("line")).alias("doi"))


def _sql_replace_all(c: str) -> str:
    for entity, char in tf.ENTITIES:
        c = f"replace({c}, '{entity}', '{char if char != chr(39) else chr(39) * 2}')"
    return c


def sql_html_to_text(c: str) -> str:
    for tag in tf.SILENT_TAGS:
        c = rf"regexp_replace({c}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?is)<!--.*?-->', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?i)</({'|'.join(tf.BLOCK_TAGS)})\s*>', chr(10), 'g')"
    c = rf"regexp_replace({c}, '(?i)<br\s*/?>', chr(10), 'g')"
    c = _sql_replace_all(f"regexp_replace({c}, '(?s)<[^>]+>', ' ', 'g')")
    c = rf"regexp_replace(replace({c}, chr(13), ''), '[^\S\n]+', ' ', 'g')"
    c = rf"regexp_replace({c}, '\n *\n[ \n]*', chr(10) || chr(10), 'g')"
    return strip(rf"regexp_replace({c}, '\n +', chr(10), 'g')")


@query("b4_html_to_text", f"""
    SELECT page_id, length(t) AS chars, md5(t) AS text_md5 FROM (SELECT page_id, {sql_html_to_text('html')} AS t FROM pages)""")
def _(t):
    return t.spread("pages").select("page_id", tf.html_to_text(F.col("html")).alias("t")).select(
        "page_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5")
    )


@query("b5_decoded_entities", f"SELECT page_id, md5({_sql_replace_all('html')}) AS html_md5 FROM pages")
def _(t):
    return t.spread("pages").select("page_id", F.md5(tf.decode_entities(F.col("html"))).alias("html_md5"))


@query("b6_stripped_markup", rf"""
    SELECT page_id, md5({squeeze("regexp_replace(html, '<[^>]*(?:>|$)|>', '', 'g')")}) AS joined_md5,
           md5({squeeze("regexp_replace(regexp_replace(html, '<[^>]*$', '', 'g'), '<[^>]*>|>', ' ', 'g')")}) AS spaced_md5
    FROM pages""")
def _(t):
    html = F.col("html")
    return t.spread("pages").select(
        "page_id", F.md5(tf.strip_markup_joined(html)).alias("joined_md5"),
        F.md5(tf.strip_markup_spaced(html)).alias("spaced_md5"))


@query("b7_html_fields", f"""
    SELECT doc_id, source || ' & ' || lang AS title,
           CASE WHEN strlen(a) > 40 THEN a END AS abstract,
           CASE WHEN source || ' Doe' = lang THEN lang ELSE source || ' Doe;' || lang END AS authors,
           md5({strip(squeeze("' '") + " || body")}) AS body_md5
    FROM (SELECT *, {sql_html_to_text("split_part(text, chr(10), 1)")} AS a, '' AS body FROM documents)""")
def _(t):
    pages = derived.article_pages(t).withColumn("body", tf.main_content(F.col("html")))
    return pages.select(
        "doc_id", tf.html_title(F.col("html")).alias("title"), tf.html_abstract(F.col("body")).alias("abstract"),
        F.array_join(tf.html_authors(F.col("body")), ";").alias("authors"),
        F.md5(F.regexp_extract(F.col("body"), r"(?s)<footer(.*)", 1)).alias("body_md5"))


@query("b8_aspect_texts", f"""
    SELECT work_id, aspect, md5(concat_ws(chr(10), nullif({strip('summary')}, ''), nullif(b, ''))) AS text_md5
    FROM (SELECT *, array_to_string(list_filter(list_transform(bullets, lambda x: {strip('x')}), lambda x: x <> ''), '; ') AS b
          FROM aspect_raw)""")
def _(t):
    from evgraph.operators import extraction

    rows = extraction.aspect_rows(extraction.aspect_objects(t.document_dna))
    text = tf.aspect_text(F.col("summary"), F.col("bullets"))
    return rows.select("work_id", "aspect", F.md5(text).alias("text_md5"))


@query("b9_title_abstract_methods", """
    SELECT work_id, md5('title: ' || source || chr(10) || 'abstract: ' || text[1:4000] || chr(10) || 'methods: '
           || array_to_string(list_transform(lines, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE x || ': ' || lang END), '; ')) AS text_md5
    FROM (SELECT doc_id AS work_id, source, lang, text, string_split(text, chr(10)) AS lines FROM documents)""")
def _(t):
    methods = F.transform(
        F.split("text", "\n"),
        lambda s, i: F.struct(s.alias("name"), F.when(i % 2 == 0, "").otherwise(F.col("lang")).alias("description")))
    whole = tf.title_abstract_methods_text(F.col("source"), F.col("text"), methods)
    return t.spread("documents").select(F.col("doc_id").alias("work_id"), F.md5(whole).alias("text_md5"))


@query("b10_lenient_json", """
    SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN props::JSON->>'$.k' END AS k FROM events""")
def _(t):
    key, props = F.col("event_id"), F.col("props")
    reply = (
        F.when(key % 4 == 0, props)
        .when(key % 4 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(key % 4 == 2, F.concat(F.lit(" ```\n"), props, F.lit("```  ")))
        .otherwise(F.concat(F.lit("```json\n"), F.substring(props, F.lit(1), F.length(props) - 1), F.lit("\n```")))
    )
    clean = t.raw("events").select(key.alias("event_id"), tf.lenient_json(reply).alias("raw"))
    parsed = F.try_parse_json("raw")
    return clean.select("event_id", F.try_variant_get(parsed, "$.k", "string").alias("k"))


_MODELS = ["gpt-4o-mini", "GPT-4o", "gpt-4.1-nano", "claude-haiku", "claude-Sonnet", "opus", "other"]


@query("b11_token_cost", f"""
    SELECT o_orderkey, round((tokens_in * p_in + tokens_out * p_out) / 1000000.0::DOUBLE, 11) AS cost,
           round((tokens_in * p_in + tokens_out * p_out) / 1000000.0::DOUBLE * 0.5, 11) AS batch_cost
    FROM (SELECT o_orderkey, o_custkey * 1000 + coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 0) * 0.1::DOUBLE
                 + coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, 0) * 1.25::DOUBLE AS tokens_in,
                 o_orderkey AS tokens_out,
                 [0.15, 2.5, 2.5, 1.0, 3.0, 5.0, 1.0][o_orderkey % 7 + 1]::DOUBLE AS p_in,
                 [0.6, 10.0, 10.0, 5.0, 15.0, 25.0, 3.0][o_orderkey % 7 + 1]::DOUBLE AS p_out FROM orders)""")
def _(t):
    from evgraph.sources.bindings import pick

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    args = (
        pick(_MODELS, key % 7), cust * 1000, key, F.when(key % 2 == 0, cust), F.when(key % 3 == 0, key))
    return t.raw("orders").select(
        "o_orderkey", F.round(scores.token_cost_usd(*args), 11).alias("cost"),
        F.round(scores.token_cost_usd(*args, batch=True), 11).alias("batch_cost"))


@query("b12_boxes", """
    SELECT o_orderkey,
        CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE x END AS x,
        CASE o_orderkey % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE y END AS y,
        CASE o_orderkey % 7 WHEN 0 THEN w WHEN 1 THEN w - x WHEN 2 THEN CASE WHEN abs_ THEN w - x ELSE w END
             WHEN 3 THEN 20 WHEN 4 THEN w END AS w,
        CASE o_orderkey % 7 WHEN 0 THEN h WHEN 1 THEN h - y WHEN 2 THEN CASE WHEN abs_ THEN h - y ELSE h END
             WHEN 3 THEN 10 WHEN 4 THEN h END AS h,
        CASE o_orderkey % 3 WHEN 0 THEN x WHEN 1 THEN x ELSE 0 END::INTEGER AS page,
        CASE WHEN o_orderkey % 3 = 0 THEN greatest(w - x, 0) END AS coord_w
    FROM (SELECT *, (w > x AND h > y AND w - x < 2000 AND (w > 50 OR h > 50)) AS abs_ FROM (
        SELECT o_orderkey, (o_orderkey % 90)::DOUBLE AS x, (o_custkey % 90)::DOUBLE AS y,
               (o_custkey % 170 + 1)::DOUBLE AS w, (o_orderkey % 130 + 1)::DOUBLE AS h FROM orders))""")
def _(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (key % 90).cast("string"), (cust % 90).cast("string")
    w, h = (cust % 170 + 1).cast("string"), (key % 130 + 1).cast("string")
    obj = lambda a, b, c, d: F.format_string(f'{{"{a}":%s,"{b}":%s,"{c}":%s,"{d}":%s}}', x, y, w, h)
    raw = (
        F.when(key % 7 == 0, obj("x", "y", "w", "h"))
        .when(key % 7 == 1, obj("x0", "y0", "x1", "y1"))
        .when(key % 7 == 2, F.format_string("[%s, %s, %s, %s]", x, y, w, h))
        .when(key % 7 == 3, F.format_string("[%s, %s, 20, 10]", (key % 90 + 0).cast("string"), y))
        .when(key % 7 == 4, F.format_string('{"x":%s,"y":%s,"w":%s,"h":%s,"note":"n"}', x, y, w, h))
        .when(key % 7 == 5, F.lit("[1, 2, 3]"))
    )
    # the fourth notation is small: keep it clear of the absolute reading
    raw = F.when((key % 7 == 3) & ((key % 90 < 20) & (cust % 90 < 10)), F.format_string("[%s, %s, 20, 10]", x, y)).otherwise(raw)
    coords = (
        F.when(key % 3 == 0, F.concat_ws(" ", x, x, y, w, h))
        .when(key % 3 == 1, x)
        .otherwise(F.concat_ws(" ", x, y))
    )
    box, place = geometry.parse_box(raw), geometry.parse_coords(F.concat(coords, F.lit(";9 9 9 9 9")))
    return t.raw("orders").select(
        "o_orderkey", box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"),
        place["page"].alias("page"), place["box"]["w"].alias("coord_w"))


@query("b13_taxonomy", f"""
    SELECT relation_id,
           CASE WHEN type NOT IN {in_list(tx.NOT_PROPOSABLE)} THEN type END AS proposable,
           type IN {in_list(tx.HIGH_RISK)} AS high_risk, type IN {in_list(tx.METHOD_LINEAGE)} AS lineage,
           {case('type', [(v, f"'{k}'") for k, v in tx.SEMANTIC_GROUPS.items()], "'other'")} AS semantic_group,
           {case('review_status', [([k], v) for k, v in tx.STATUS_WEIGHTS.items()], 0.0)}::DOUBLE AS status_weight,
           {case('type', tx.MODE_WEIGHTS['evolution'][0], 0.8)}::DOUBLE AS evolution,
           {case('type', tx.MODE_WEIGHTS['dispute'][0], 0.7)}::DOUBLE AS dispute,
           {case('type', tx.MODE_WEIGHTS['prerequisite'][0], 0.8)}::DOUBLE AS prerequisite
    FROM relations""")
def _(t):
    kind = F.col("type")
    return t.relations.select(
        "relation_id", tx.proposable_type(F.concat(F.lit(" "), F.upper(kind))).alias("proposable"),
        tx.is_high_risk(kind).alias("high_risk"), tx.is_method_lineage(kind).alias("lineage"),
        tx.semantic_group(kind).alias("semantic_group"), tx.status_weight(F.col("review_status")).alias("status_weight"),
        tx.mode_weight("evolution", kind).alias("evolution"), tx.mode_weight("dispute", kind).alias("dispute"),
        tx.mode_weight("prerequisite", kind).alias("prerequisite"))


@query("b14_synthetic_ids", """
    SELECT relation_id, sha256(relation_id || '|' || type || ':in')[:32] AS node_id FROM relations_raw""")
def _(t):
    return t.relations_raw.select(
        "relation_id", scores.synthetic_id(F.col("relation_id"), F.concat("type", F.lit(":in"))).alias("node_id")
    )


@query("b15_springs", """
    SELECT event_id, round(90 + 430 * pow(1 - c, 1.6), 6) AS length,
           round(0.08 + 5.5 * pow(greatest(0, least(1, (s - 0.35) / 0.55)), 4), 6) AS elasticity,
           round(160 + 560 * (1 - c) * (1 - c), 6) AS map_length
    FROM (SELECT event_id, s, greatest(0, least(1, s))::DOUBLE AS c FROM (SELECT event_id, value / 80::DOUBLE AS s FROM events))""")
def _(t):
    s = F.col("value") / 80.0
    return t.raw("events").select(
        "event_id", F.round(scores.spring_length(s), 6).alias("length"),
        F.round(scores.spring_elasticity(s), 6).alias("elasticity"),
        F.round(scores.map_spring_length(s), 6).alias("map_length"))


@query("b16_display_titles", """
    SELECT w.work_id, coalesce(v.title, w.title_norm) AS title, v.year::VARCHAR AS year, v.arxiv_id, v.venue_name
    FROM works w LEFT JOIN versions v ON v.version_id = CASE WHEN w.work_id % 5 <> 0 THEN w.primary_version_id END""")
def _(t):
    from evgraph.operators.reads import titled_works

    some = t.works.withColumn("primary_version_id", F.when(F.col("work_id") % 5 != 0, F.col("primary_version_id")))
    return titled_works(some, t.versions).select("work_id", "title", F.col("year").cast("string").alias("year"), "arxiv_id", "venue_name")


@query("b17_set_fingerprints", """
    SELECT l_orderkey, sha256(array_to_string(list_sort(list_distinct([l_suppkey, l_partkey, l_suppkey, l_orderkey])), ',')) AS fingerprint
    FROM lineitem""")
def _(t):
    ids = F.array("l_partkey", "l_suppkey", "l_orderkey", "l_partkey")
    return t.raw("lineitem").select("l_orderkey", scores.set_fingerprint(ids).alias("fingerprint"))


@query("b18_times", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN epoch(o_orderdate)::BIGINT - CASE WHEN o_orderkey % 4 = 1 THEN 5400 ELSE 0 END END::VARCHAR AS cursor_epoch,
           CASE o_orderkey % 4 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 1998 WHEN 2 THEN 2017 END::VARCHAR AS year
    FROM orders""")
def _(t):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    cursor = (
        F.when(key % 4 == 0, F.concat(day, F.lit("T00:00:00Z")))
        .when(key % 4 == 1, F.concat(day, F.lit("T00:00:00.000+01:30")))
        .when(key % 4 == 2, day)
        .otherwise(F.lit("yesterday"))
    )
    block = (
        F.when(key % 4 == 0, F.concat(F.lit('<date type="published" when="'), day, F.lit('"/>')))
        .when(key % 4 == 1, F.lit("<b>Vol 12345</b> 1850 1998, 2001"))
        .when(key % 4 == 2, F.lit("<date when='2017'>June</date> 1999"))
        .otherwise(F.lit('<p n="2001">none</p>'))
    )
    return t.raw("orders").select(
        "o_orderkey", F.unix_timestamp(tf.parse_cursor(cursor)).cast("string").alias("cursor_epoch"),
        tf.publication_year(block).cast("string").alias("year"))
