"""Phrase and proximity search over the positional index against plain scans."""

import re

import numpy as np
import pytest

from evgraph.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(30)] + ["the"] * 20 + ["Été", "straße", "x9"]


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, width):
    out = {}
    for doc_id, text in docs:
        w, hit, held = plain_words(text), set(), set()
        for item_id, item in items:
            v = plain_words(item)
            n = min(width, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[k : k + n]:
                        hit.update(range(s, s + n))
                        held.add(str(item_id))
        out[doc_id] = (len(w), len(hit), sorted(held), bool(hit))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(1)
    items = [(k, "-".join(rng.choice(WORDS, rng.integers(1, 18)))) for k in range(20)] + [(50, None), (51, "?! "), (52, "the"), (53, "w1 w2")]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(WORDS, rng.integers(0, 60)))
        if k % 3 == 0:
            text += ", " + items[k % 20][1].upper() + ". " + items[(k + 1) % 20][1] + " " + items[k % 20][1]
        docs.append((k, text))
    return docs + [(100, None), (101, ""), (102, "the " * 20_000), (103, "w1"), (104, "w2")], items


def test_contamination_equals_a_plain_scan(spark, tables, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT_BYTES", 3_000)
    docs, items = tables
    left = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(d, t, 1) for d, t in items], "item_id long, text string, doc_id int")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in dc.contamination(left, right).collect()}
    short = [(d, t) for d, t in docs if d != 102]
    assert {k: v for k, v in got.items() if k != 102} == plain(short, items, 10)
    assert got[102] == (20_000, 20_000, ["52"], True)


def test_proximity(spark, tables):
    docs = spark.createDataFrame([(1, "a x b c"), (2, "a b c"), (3, "c b a"), (4, "a b x x x c"), (5, "b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    phrases = dc.windows(items, 10).select("phrase_id", "terms")
    index = dc.build_index(docs)
    for slop, ids in ((0, {2}), (1, {1, 2}), (2, {1, 2}), (3, {1, 2, 4}), (4, {1, 2, 3, 4})):
        assert {r.doc_id for r in dc.find(index, dc.by_rarity(index, phrases), slop).collect()} == ids
    assert {r.doc_id for r in dc.find(index, dc.by_rarity(index, phrases), 1, block=1).collect()} == {1, 2}


def test_proximity_whose_start_lies_before_the_document(spark):
    texts = [(1, "a a b b q"), (2, "c a b"), (3, "a b q"), (4, "q a b c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    phrases = dc.windows(spark.createDataFrame([(1, "a b c")], "item_id long, text string"), 10).select("phrase_id", "terms")
    index = dc.build_index(docs)
    got = [(r.doc_id, r.start, r.length) for r in dc.find(index, dc.by_rarity(index, phrases), 3).collect()]
    assert sorted(got) == [(2, 0, 1), (4, 1, 3)]


def test_empty_tables_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit) for r in dc.contamination(docs, items).collect())
    assert got == [(-1, 2, 2), (1, 1, 1), (1, 2, 2)]  # each row has hits of its own
    assert dc.contamination(docs.limit(0), items).collect() == []
    assert [r.contaminated for r in dc.contamination(docs, items.limit(0)).collect()] == [False] * 3


def test_null_and_repeated_ids_count_their_own_hits(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(None, passage), (None, "clean text"), (7, "x " + passage), (7, "clean"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in dc.contamination(docs, items).collect()))
    assert got == [(0, 2, 0, False), (0, 10, 10, True), (7, 1, 0, False), (7, 11, 10, True), (8, 0, 0, False)]
