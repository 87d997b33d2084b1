"""Near copies against exact Jaccard similarities of all pairs."""

import numpy as np

import corpus_pipeline
from evgraph.llm import near_copies as nc
from tests.llm.test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_texts(seed, centres, copies):
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(500)]
    out = []
    for _ in range(centres):
        base = rng.choice(words, 150).tolist()
        out.append(" ".join(base))
        for _ in range(copies):
            near = list(base)
            for at in rng.choice(150, rng.integers(1, 7), replace=False):
                near[at] = f"new{rng.integers(10**6)}"
            out.append(" ".join(near))
    return out


def test_stage_keeps_one_text_of_each_verified_component(spark):
    texts = near_texts(2, 15, 8) + ["one", "One", "two words", "a b c d e", "A b  c d e"]
    sets, prints = [plain_set(t) for t in texts], [plain_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in near) > len(near) / 2
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if 0.5 < jaccard(sets[i], sets[j]) < 0.8]
    assert len(apart) > 50
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()}
    roots = plain_components(range(len(texts)), near)
    assert got == {i for i, r in roots.items() if r == i}


def test_members_that_are_far_from_the_least_one_still_meet(spark):
    texts = near_texts(3, 6, 12)
    sets = [plain_set(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = plain_components(range(len(texts)), near)
    nodes = [i.to_bytes(2) for i in range(len(texts))]
    hashed = [nc.shingles(t.encode()).view(np.int64) for t in texts]
    for groups in (nodes, [nodes[want[i]] for i in range(len(texts))]):
        got = [(int.from_bytes(a), int.from_bytes(b)) for a, b in nc.joined(nodes, groups, hashed)]
        assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)
        assert groups is not nodes and not got or plain_components(range(len(texts)), got) == want
    rows = spark.createDataFrame([(bytearray(n), bytearray(t.encode())) for n, t in zip(nodes, texts)], "node binary, text binary")
    for portion in (400, 1_000_000):
        links = [(int.from_bytes(r.a), int.from_bytes(r.b)) for r in nc.links(rows, portion, most=4).collect()]
        assert plain_components(range(len(texts)), links) == want


def test_shingles_are_those_of_split_words():
    for text in ("", " ", "a", " A  b\t\x0bc ", "é x\u00a0y z\u2003w v u t", "one two\nthree  four five six \r\n", "w " * 70_000 + "end"):
        words = text.encode().lower().split()
        spans = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert nc.shingles(text.encode()).tolist() == sorted(nc.xxhash.xxh64_intdigest(s, nc.SEED) for s in spans)
    assert len(nc.shingles(None)) == 0


def test_wordless_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, " \n"), (4, ""), (None, "x y z")], "doc_id long, text string")
    got = [(r.doc_id, bytes(r.node)) for r in nc.representatives(docs).collect()]
    assert sorted(d for d, _ in got if d is not None) == [2, 5] and len(got) == 3
    assert nc.representatives(docs.limit(0)).collect() == []


def test_rows_with_null_or_repeated_ids_are_told_apart(spark, tmp_path):
    one, two, three = near_texts(9, 3, 0)
    rows = [(None, one), (None, two), (1, two), (7, three), (7, two)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert {(r.doc_id, r.text) for r in got.collect()} == {(None, one), (1, two), (7, three)}
    spark.createDataFrame([(1, two)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id or 0, r.text) for r in clean.collect())) == sorted([(0, one), (7, three)])


def test_stage_links_what_simhash_links(spark):
    """Texts of one long refrain: their fingerprints are alike, their sets of shingles are not."""
    rng = np.random.default_rng(5)
    tails = [" ".join(f"{rng.integers(10**9)}" for _ in range(60)) for _ in range(6)]
    refrain = "green lanterns drift across harbours " * 400
    texts = [refrain + t for t in tails[:3]] + tails[3:] + [refrain + tails[0]]
    prints, sets = [plain_fingerprint(t) for t in texts], [plain_set(t) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= 4 for p in prints[:3]) and max(jaccard(sets[i], sets[j]) for i in range(6) for j in range(i)) < 0.5
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, refrain + "and on", "en", "s", 1)]
    got = dict(corpus_pipeline.STAGES)["simhash"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == [0, 3, 4, 5]
