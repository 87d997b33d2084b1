"""Chunked encoding against a plain segmentation, and exact round trips."""

import numpy as np
import pytest

from evgraph.llm import sentence_pieces as sp

BYTES = [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]


def plain(pieces, text):
    """Best sum of scores, then the smallest start of the last piece, by full enumeration of last pieces."""
    if not text:
        return []
    text = " " + text
    known = {p.replace("▁", " "): (s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "piece"}
    byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
    unknown = min(s for s, _ in known.values()) - 10
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        found = []
        for start in range(end):
            part = text[start:end]
            if part in known:
                found.append((best[start] + known[part][0], -start, [known[part][1]]))
            elif len(part) == 1:
                found.append((best[start] + unknown, -start, [byte[b] for b in part.encode()]))
        top = max(found, key=lambda f: f[:2])
        best.append(top[0])
        back.append((-top[1], top[2]))
    out, at = [], len(text)
    while at:
        start, ids = back[at]
        out = ids + out
        at = start
    return out


def vocabulary(spaced):
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(40)} | {"▁" + w for w in ("a", "ab", "bca", "cc")}
    words |= {"▁", "▁▁", "▁▁▁", "a", "b", "c", ".", "é"} | ({"a▁b", "c▁"} if spaced else set())
    return BYTES + [("<s>", 0.0, "other")] + [(w, -float(rng.integers(1, 9)), "piece") for w in sorted(words)]


@pytest.mark.parametrize("spaced", [False, True])
def test_scan_equals_a_plain_segmentation(spark, spaced):
    rng = np.random.default_rng(4)
    pieces = vocabulary(spaced)
    texts = ["".join(rng.choice(list("aaabbbccc   .é\nX😀▁"), rng.integers(1, 120))) for _ in range(60)]
    texts += ["".join(rng.choice(list("abc"), 300)) for _ in range(6)] + [None, "", " ", "X" * 200, " " * 90, texts[0], texts[1], "abc" * 50, "abc" * 50]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, no int")
    for chunk, span in ((6, 2), (17, 128)):
        encoder = sp.Encoder(spark, pieces, chunk, span)
        encoded = encoder.encode(docs)
        got = {r.doc_id: list(r["ids"]) for r in encoded.collect()}
        assert got == {i: plain(pieces, t) for i, t in enumerate(texts)}
        back = {r.doc_id: r.text for r in encoder.decode(encoded).collect()}
        assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encoder.encode(docs.limit(0)).collect() == []


def test_public_vocabulary_and_null_rows(spark):
    pieces = sp.read_pieces()
    model = sp.Pieces(pieces)
    for text in ("Hello world", "two  spaces \n\ttab", "日本語 ünï 😀", "x" * 70, "▁ as is", "<0x41> <s>"):
        ids = np.frombuffer(model.encode(text), "<i4")
        assert ids.tolist() == plain(pieces, text)
        assert model.decode(ids) == text
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, "b b"), (1, "b b")], "doc_id long, text string")
    encoder = sp.Encoder(spark, pieces)
    assert sorted(r.text for r in encoder.decode(encoder.encode(docs)).collect()) == ["", "a", "b b", "b b"]
    assert [r.text for r in encoder.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]
