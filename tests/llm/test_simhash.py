"""SimHash components against all pairs."""

import re
import weakref

import numpy as np
import xxhash

from evgraph.llm import common, sentence_pieces, simhash
from evgraph.llm.components import components

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {n: root(n) for n in nodes}


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"Word{i}é" for i in range(400)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, 120).tolist()
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rng.integers(120)] = "changed"
            texts.append("\t".join(near))
    texts += [None, "", " \n ", "one", "one two three", "ONE", "x " * 5000, texts[0]]
    docs = spark.createDataFrame([(i * 3 + 1, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i * 3 + 1: plain_fingerprint(t) for i, t in enumerate(texts)}
    ids = list(prints)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert len(pairs) > 20
    roots = plain_components(ids, pairs)
    assert got == {i: (prints[i], roots[i]) for i in ids}


def test_large_bucket_is_cut_into_portions_without_losing_a_link(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(60, rng.integers(0, 5), replace=False)) for c in centres for _ in range(30)}
    classes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for portion in (7, 2048):
        got = [(r.a, r.b) for r in simhash.links(classes, portion=portion).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got)
        every = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
        assert plain_components(fps, got) == plain_components(fps, every)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e", ""), (5, "a b c d e", ""), (None, "a b c d e", ""), (2, None, "")], SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 5), (2, 2), (5, 5), (5, 5)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_fingerprints_free_the_model_of_an_earlier_stage():
    model = weakref.ref(sentence_pieces.Pieces.of("of an earlier stage", [("a", -1.0, "piece")]))
    want = [int(np.uint64(plain_fingerprint(t)).view(np.int64)) for t in ("a b c d", None)]
    assert simhash._prints({"text": [b"a b c d", None]})["fp"] == want
    assert not common._model and model() is None
