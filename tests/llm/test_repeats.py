"""Removed bytes against a count of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evgraph.llm import repeats


def plain(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        rest = bytes(b for b, g in zip(d, gone[1:]) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    rng = np.random.default_rng(seed)
    alphabet = list("abcdé \x00")
    make = lambda n: "".join(rng.choice(alphabet, n))
    passages = [make(n) for n in (25, 40, 60, 90, 130)]
    texts = []
    for _ in range(50):
        parts = [make(rng.integers(0, 80)) if rng.random() < 0.6 else passages[rng.integers(5)] for _ in range(rng.integers(1, 6))]
        texts.append("".join(parts))
    texts += [texts[0], texts[0], "ab" * 90, "x" * 200, "x" * 100, None, "", "short", passages[4] * 3]
    near = list(passages[4] * 2)
    near[100] = "Z"
    return texts + ["".join(near)]


@pytest.mark.parametrize("least,portion", [(40, 50_000), (24, 3), (60, 50_000)])
def test_equals_a_count_of_all_strings(spark, least, portion, monkeypatch):
    monkeypatch.setattr(repeats, "BYTES_AT_ONCE", 700)
    texts = corpus(least)
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, kept binary").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, least, portion).collect()}
    want = dict(enumerate(plain(texts, least)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "y" * 39 + "z"), (1, "y" * 39 + "z"), (None, "q" * 50), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs, 40).collect())
    assert got == [(-1, 50, 50, 1), (1, 40, 40, 1), (1, 40, 40, 1), (2, 0, 0, 0)]
    assert repeats.remove_repeats(docs.limit(0), 40).collect() == []


@pytest.mark.parametrize("least", [24, 40])
def test_pieces_of_long_texts_hold_the_anchors_of_whole_ones(monkeypatch, least):
    texts = [t.encode() for t in corpus(7) if t]
    batch = pa.RecordBatch.from_pydict({"b1": list(range(len(texts))), "b2": [0] * len(texts), "text": texts})

    def starts(at_once):
        monkeypatch.setattr(repeats, "BYTES_AT_ONCE", at_once)
        out = []
        for held, begins, (doc, h, at, lo, hi) in repeats._anchored(least)([batch]):
            own, begin = [held[d][0] for d in doc], begins[doc]
            for b1, key, place, first, last in zip(own, h.tolist(), (at - begin).tolist(), (lo - begin).tolist(), (hi - begin).tolist()):
                out += [(b1, key, place, s) for s in range(first, last + 1)]
        return sorted(out)

    whole = starts(10**6)
    assert len({(b, s) for b, _, _, s in whole}) == len(whole) == sum(max(0, len(t) - least + 1) for t in texts)
    assert starts(50) == starts(333) == whole
