"""Stages on a small corpus against a plain version of each decision; edge cases."""

import numpy as np

import corpus_pipeline
from evgraph.llm import sentence_pieces
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_equals_plain_decisions(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = {"en": "the river and stone were under bright walking trees".split(), "de": "der fluss und stein waren unter hellen bäumen gehend".split()}
    rows = []
    for i in range(40):
        lang = "en" if i % 2 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], 60)), lang, "s", 1))
    passage = "seven green lanterns drift across a silent harbour at dawn today"
    rows += [(40, rows[1][1], "en", "s", 1), (41, rows[3][1] + " " + passage.upper(), "en", "s", 1),
             (42, rows[5][1][::-1] + " password = hunter2hunter2 end", "en", "s", 1),
             (43, "12 34 !!", "en", "s", 1), (44, None, None, None, None), (45, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    prints = {r[0]: plain_fingerprint(r[1]) for r in left}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    first = plain_components(prints, pairs)
    want = {r[0]: r[1].replace('password = hunter2hunter2', "<assign>") for r in left if first[r[0]] == r[0] and passage.upper() not in r[1]}
    assert {i: r.text for i, r in got.items()} == want
    assert 40 not in want and 41 not in want and "<assign>" in want[42]
    model = sentence_pieces.Pieces(sentence_pieces.read_pieces())
    assert all(list(r["ids"]) == np.frombuffer(model.encode(r.text), "<i4").tolist() for r in got.values())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
