"""The registered queries of the operators: (spark, sf_dir) -> DataFrame, and their SQL where it can say the same."""

from pyspark.sql import functions as F

from evgraph.llm import collocations, cross_entropy, decontaminate, jaccard_join, language_id, licenses, merkle, quality, repeats, secrets, sentence_pieces, simhash, toxicity
from evgraph.llm.common import table

QUERIES = {}
STATEMENTS = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            STATEMENTS[fn.__name__] = sql
        return fn

    return register


@query()
def op7_language_id(spark, sf_dir):
    found = language_id.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op10_simhash_components(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORDS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
i AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, k, spots.n FROM spots JOIN phrases ON spots.phrase = phrases.phrase AND spots.n = phrases.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
         FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
""")
def op3_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (
  SELECT * FROM (VALUES
    (0, 'assign', '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 8),
    (1, 'access', '(AKIA[A-Z0-9]+)', 1, 16),
    (2, 'hex', '([0-9a-f]+)', 1, 32),
    (3, 'block', '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', 1, 1),
    (4, 'github', '(gh[pousr]_[A-Za-z0-9]{36,})', 1, 1),
    (5, 'slack', '(xox[abprs]-[A-Za-z0-9-]{10,})', 1, 1),
    (6, 'jwt', '(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})', 1, 1),
    (7, 'login', '([a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@)', 1, 1)
  ) AS k(kind, rule, pattern, grp, least)),
m AS (
  SELECT doc_id, kind, rule, least, regexp_extract_all(t, pattern, 0) AS whole, regexp_extract_all(t, pattern, 1) AS part,
         string_split_regex(t, pattern) AS gaps
  FROM d, kinds WHERE regexp_matches(t, pattern)),
e AS (SELECT doc_id, kind, rule, least, whole, part, gaps, unnest(range(1, len(whole) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, kind, rule, length(part[i]) >= least AS kept,
         sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop, length(whole[i]) AS size
  FROM e),
f AS (SELECT doc_id, kind, rule, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE kept),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
         string_agg(rule || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
""")
def op9_secret_scan(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = secrets.secrets(files, secrets.fresh_ledger(spark))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rule"].isin(*secrets.BASE))
    return found.select(
        F.col("path").alias("doc_id"),
        *[count(kind) for kind in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query()
def op6_sentence_pieces(spark, sf_dir):
    encoder = sentence_pieces.Encoder(spark, sentence_pieces.read_pieces())
    encoded = encoder.encode(table(spark, sf_dir, "documents"))
    decoded = encoder.decode(encoded, carry=("ids",))
    return decoded.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(r"""
WITH d AS (SELECT doc_id, lang, text IS NULL AS gone, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, gone, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw FROM d),
wins AS (SELECT doc_id, k, array_to_string(w[k:k + 4], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, lang, gone, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
classes AS (SELECT * FROM (VALUES
  ('lower', '[a-z]'), ('upper', '[A-Z]'), ('digit', '[0-9]'), ('space', '[ \t]'), ('line', '[\n\r\x0B\x0C]'), ('stop', '[.,;:!?''"()-]'),
  ('symbol', '[#*$%&|<>]'), ('beyond', '[^\x00-\x7F]'), ('other', '[\x00-\x08\x0E-\x1F+/=@\[\\\]^_`{}~\x7F]')) AS c(item, pattern)),
doc_class AS (SELECT doc_id, lang, gone, item, length(t) - length(regexp_replace(t, pattern, '', 'g')) AS n FROM d, classes),
doc_word AS (SELECT doc_id, lang, gone, word, count(*) AS n FROM (SELECT doc_id, lang, gone, unnest(lw) AS word FROM w) GROUP BY ALL),
ref_class AS (SELECT lang, item, sum(n) AS q FROM doc_class WHERE lang IS NOT NULL AND NOT gone GROUP BY ALL),
every_word AS (SELECT lang, word, sum(n) AS q FROM doc_word WHERE lang IS NOT NULL GROUP BY ALL),
top AS (SELECT lang, word, q FROM every_word QUALIFY row_number() OVER (PARTITION BY lang ORDER BY q DESC, word COLLATE "C") <= 64),
ref AS (
  SELECT lang, 'class' AS kind, item, q / sum(q) OVER (PARTITION BY lang) AS q FROM ref_class
  UNION ALL SELECT lang, 'word', word, q / (SELECT sum(q) FROM every_word e WHERE e.lang = top.lang) FROM top
  UNION ALL SELECT lang, 'word', '', 1 - sum(q) / (SELECT sum(q) FROM every_word e WHERE e.lang = top.lang) FROM top GROUP BY lang),
named AS (SELECT b.doc_id, r.lang, sum(coalesce(x.n, 0)) AS n
          FROM base b, top r LEFT JOIN doc_word x ON x.doc_id = b.doc_id AND x.word = r.word GROUP BY ALL),
own AS (
  SELECT c.doc_id, r.lang, 'class' AS kind, c.item, c.n::DOUBLE / nullif(sum(c.n) OVER (PARTITION BY c.doc_id, r.lang), 0) AS p
  FROM doc_class c, (SELECT DISTINCT lang FROM ref) r
  UNION ALL
  SELECT b.doc_id, r.lang, 'word', r.word, coalesce(x.n, 0)::DOUBLE / nullif(b.n_words, 0)
  FROM base b, top r LEFT JOIN doc_word x ON x.doc_id = b.doc_id AND x.word = r.word
  UNION ALL
  SELECT b.doc_id, m.lang, 'word', '', (b.n_words - m.n)::DOUBLE / nullif(b.n_words, 0) FROM base b JOIN named m USING (doc_id)),
dist AS (
  SELECT doc_id, lang, kind, CASE WHEN count(p) = 0 THEN 1 ELSE sqrt(greatest(0, sum(
           CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) END AS far
  FROM own JOIN ref USING (lang, kind, item) GROUP BY ALL),
near AS (
  SELECT a.doc_id, a.far AS by_class, b.far AS by_word FROM dist a JOIN dist b USING (doc_id, lang)
  WHERE a.kind = 'class' AND b.kind = 'word' QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY a.far + b.far, lang) = 1),
sized AS (SELECT doc_id, sum(n) AS n_chars FROM doc_class GROUP BY doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n_chars >= 200 AND by_class > 0.30) OR (n_words >= 50 AND by_word > 0.50), false) AS kept
FROM judged LEFT JOIN near USING (doc_id) LEFT JOIN sized USING (doc_id)
""")
def op1_quality_rules(spark, sf_dir):
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.drop("nearest", "class_distance", "word_distance")


@query(r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d)),
twice AS (SELECT doc_id, i, i + 400 AS e FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
marked AS (SELECT *, CASE WHEN i <= max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                          THEN 0 ELSE 1 END AS fresh FROM twice),
spans AS (SELECT doc_id, g, min(i) AS s, max(e) AS e
          FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
parts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS stop,
               string_agg(substr(x, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept
        FROM parts JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
""")
def op4_repeated_strings(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query()
def op8_toxicity(spark, sf_dir):
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query(rf"""
WITH d AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
tokens AS (SELECT doc_id, k, w[k] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
vocabulary AS (SELECT word, 1 + row_number() OVER (ORDER BY n DESC, word) AS id
               FROM (SELECT word, count(*) AS n FROM tokens GROUP BY word ORDER BY n DESC, word LIMIT 510)),
pairs AS (SELECT doc_id, lag(id, 1, 1) OVER (PARTITION BY doc_id ORDER BY k) AS a, id AS b
          FROM (SELECT doc_id, k, coalesce(id, 0) AS id FROM tokens LEFT JOIN vocabulary USING (word))),
wanted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
near AS (SELECT a, b, count(*)::DOUBLE AS n FROM pairs WHERE doc_id IN (SELECT doc_id FROM wanted) GROUP BY ALL),
far AS (SELECT a, b, count(*) * ((SELECT sum(n) FROM near) / (SELECT count(*) FROM pairs)) AS n FROM pairs GROUP BY ALL),
seen AS (SELECT DISTINCT a, b FROM pairs),
losses AS (
  SELECT seen.a, seen.b,
         -log2((coalesce(near.n, 0) + 100 * (coalesce(nb.n, 0) + 1) / ((SELECT sum(n) FROM near) + 512)) / (coalesce(na.n, 0) + 100)) AS target,
         -log2((far.n + 100 * (fb.n + 1) / ((SELECT sum(n) FROM far) + 512)) / (fa.n + 100)) AS background
  FROM seen LEFT JOIN near ON near.a = seen.a AND near.b = seen.b JOIN far ON far.a = seen.a AND far.b = seen.b
  LEFT JOIN (SELECT a, sum(n) AS n FROM near GROUP BY a) na ON na.a = seen.a LEFT JOIN (SELECT b, sum(n) AS n FROM near GROUP BY b) nb ON nb.b = seen.b
  JOIN (SELECT a, sum(n) AS n FROM far GROUP BY a) fa ON fa.a = seen.a JOIN (SELECT b, sum(n) AS n FROM far GROUP BY b) fb ON fb.b = seen.b),
means AS (SELECT doc_id, avg(target) AS target, avg(background) AS background FROM pairs JOIN losses USING (a, b) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(target, 6) AS target_bits, round(background, 6) AS background_bits,
       round(target - background, 6) AS difference
FROM d LEFT JOIN means USING (doc_id)
""")
def op2_cross_entropy_difference(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found = cross_entropy.score(table(spark, sf_dir, "documents"), wanted)
    bits = [F.round(c, 6).alias(c) for c in ("target_bits", "background_bits", "difference")]
    return found.select("doc_id", "n_tokens", *bits)


LICENCE_TEMPLATES_SQL = """(VALUES
  (0, 'MIT', 'Released under the MIT License.'),
  (1, 'MIT', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'),
  (2, 'Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
  (3, 'Apache-2.0', 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
  (4, 'GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
  (5, 'GPL-3.0', 'you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License'),
  (6, 'BSD-3-Clause', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'),
  (7, 'BSD-3-Clause', 'Licensed under the BSD 3-Clause License.'),
  (8, 'MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.'),
  (9, 'CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
  (10, 'CC-BY-NC-4.0', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
  (11, 'CC-BY-4.0', 'Licensed under CC BY 4.0.'),
  (12, 'CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'))"""
TERMS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+(?:[.-][\p{{L}}\p{{N}}]+)*')"


@query(rf"""
WITH tt AS (SELECT template, license, term, count(*) AS tf
            FROM (SELECT template, license, unnest({TERMS_SQL.format('line')}) AS term FROM {LICENCE_TEMPLATES_SQL} AS t(template, license, line)) GROUP BY ALL),
files AS (SELECT concat_ws('/', source, doc_id // 1000, doc_id // 100 % 10, CASE WHEN doc_id % 5 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path, text FROM documents),
n AS (SELECT count(*) AS files FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TERMS_SQL.format("coalesce(text, '')")})) AS term FROM files)
       WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1 + files) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
tw AS (SELECT template, license, term, tf * idf AS w FROM tt JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
lines AS (SELECT path, i, l[i] AS line FROM (SELECT path, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files)
          WHERE regexp_matches(l[i], '(?i)licen[cs]|permission|redistribut|copyright|spdx')),
own AS (SELECT path, i, term, tf * coalesce(idf, ln(1 + files) + 1) AS w
        FROM (SELECT path, i, term, count(*) AS tf FROM (SELECT path, i, unnest({TERMS_SQL.format('line')}) AS term FROM lines) GROUP BY ALL) LEFT JOIN idf USING (term), n),
sizes AS (SELECT path, i, sqrt(sum(w * w)) AS size FROM own GROUP BY ALL),
dots AS (SELECT path, i, template, license, sum(own.w * tw.w) AS dot FROM own JOIN tw USING (term) GROUP BY ALL),
cos AS (SELECT path, license, round(dot / (size * norm), 6) AS cosine FROM dots JOIN sizes USING (path, i) JOIN norms USING (template)),
found AS (SELECT path, license, cosine FROM cos WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1),
declared AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, license FROM found WHERE regexp_matches(path, '(?i)/(licen[cs]e|copying|notice)([-._][^/]*)?$')
             QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, license) = 1),
folders AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM files),
near AS (SELECT f.folder, d.license AS inherited, d.folder AS origin FROM folders f JOIN declared d ON f.folder = d.folder OR starts_with(f.folder, d.folder || '/')
         QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY length(d.folder) DESC) = 1)
SELECT path, coalesce(found.license, inherited) AS license, cosine,
       CASE WHEN found.license IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS source,
       CASE WHEN found.license IS NULL THEN origin END AS origin
FROM files LEFT JOIN found USING (path) LEFT JOIN near ON near.folder = regexp_replace(path, '/[^/]*$', '')
""")
def op5_license_scan(spark, sf_dir):
    """The documents as a file tree: source / thousands / hundreds, every fifth named as a licence file."""
    number = F.col("doc_id")
    name = F.when(number % 5 == 0, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(number / 1000), F.floor(number / 100) % 10, name)
    return licenses.scan(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))


CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(0, 8)::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
CLIMB_SQL = """SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), max((n + 2) // 3)
               FROM {0} WHERE n > 1 GROUP BY tree, lvl, pos // 3"""


@query(rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {LEAF_SQL.format("text")} AS leaf,
         CASE WHEN {CRC_SQL} % 2 = 0 THEN {LEAF_SQL.format("replace(text, chr(10), '')")} ELSE {LEAF_SQL.format("text")} END AS claimed
  FROM documents),
placed AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n FROM d),
up(tree, lvl, pos, node, n) AS (SELECT tree, 0, pos, leaf, n FROM placed UNION ALL {CLIMB_SQL.format("up")}),
heads AS (SELECT tree, lvl, node FROM up WHERE n = 1),
named AS (SELECT *, row_number() OVER (ORDER BY tree COLLATE "C") - 1 AS pos, count(*) OVER () AS n FROM heads),
over(tree, lvl, pos, node, n) AS (SELECT 'all', 0, pos, node, n FROM named UNION ALL {CLIMB_SQL.format("over")}),
way(doc_id, part, lvl, tree, pos, folded) AS (
  SELECT doc_id, 0, 0, tree, pos, claimed FROM placed
  UNION ALL
  SELECT w.doc_id, w.part, w.lvl + 1, w.tree, w.pos // 3,
         sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.folded ELSE s.node END, '' ORDER BY s.pos))
  FROM way w JOIN up s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos // 3 = w.pos // 3 AND s.n > 1
  GROUP BY w.doc_id, w.part, w.lvl, w.tree, w.pos, w.folded),
inner_end AS (SELECT w.doc_id, h.node AS subroot, n.pos, w.folded FROM way w JOIN heads h ON h.tree = w.tree AND h.lvl = w.lvl JOIN named n ON n.tree = w.tree),
far(doc_id, lvl, pos, folded) AS (
  SELECT doc_id, 0, pos, folded FROM inner_end
  UNION ALL
  SELECT w.doc_id, w.lvl + 1, w.pos // 3, sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.folded ELSE s.node END, '' ORDER BY s.pos))
  FROM far w JOIN over s ON s.lvl = w.lvl AND s.pos // 3 = w.pos // 3 AND s.n > 1 GROUP BY w.doc_id, w.lvl, w.pos, w.folded),
siblings AS (
  SELECT w.doc_id, 0 AS part, w.lvl, s.pos, s.node FROM way w JOIN up s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos // 3 = w.pos // 3 AND s.pos <> w.pos
  UNION ALL SELECT w.doc_id, 1, w.lvl, s.pos, s.node FROM far w JOIN over s ON s.lvl = w.lvl AND s.pos // 3 = w.pos // 3 AND s.pos <> w.pos),
proofs AS (SELECT doc_id, string_agg(node, '' ORDER BY part, lvl, pos) AS proof FROM siblings GROUP BY doc_id),
top AS (SELECT lvl, node AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, f.folded AS folded_root, f.folded = root AS verified
FROM d JOIN inner_end USING (doc_id) JOIN top ON true JOIN far f USING (doc_id) LEFT JOIN proofs USING (doc_id) WHERE f.lvl = top.lvl
""")
def op11_merkle_manifest(spark, sf_dir):
    """Tampering deletes the line feeds of every document whose id has an even checksum."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = merkle.leaf(*fields[:-1], F.translate("text", "\n", ""))
    rows = docs.select("doc_id", "source", merkle.leaf(*fields).alias("leaf"), F.when(even, altered).alias("claimed"))
    return merkle.manifest(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query(r"""
WITH p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
grams AS (
  SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM w, range(1, 6) AS s(size) WHERE len(w) >= size) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE size = 1 GROUP BY lang),
often AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM grams WHERE f >= 100),
cuts AS (SELECT lang, size, phrase, f AS a, w, unnest(range(1, size)) AS k FROM often WHERE size > 1),
scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, w, size, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM often WHERE size > 2)),
longer AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(f) AS most FROM inside GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""")
def op12_phrase_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_jaccard_join(spark, sf_dir):
    return jaccard_join.joined(table(spark, sf_dir, "documents"))
