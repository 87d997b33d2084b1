"""Collocations against a count of all phrases."""

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from evgraph.llm import collocations as co

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)) if w]


def plain(docs, least, first):
    f, n = Counter(), Counter()
    for text, lang in docs:
        for w in plain_pieces(text):
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    often = {p: c for p, c in f.items() if c >= least and len(p[1]) > 1}
    covered = {
        (lang, w[i : i + m]) for (lang, w), c in often.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if c >= f[lang, w[i : i + m]]
    }
    out = []
    for lang in n:
        rows = []
        for (g, w), a in often.items():
            if g == lang and (g, w) not in covered:
                cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["a", "A", "the", "été", "Of", "x\x1cy", "zz", "-", "ÀB", "q\x00"]
    marks = [" ", " ", " ", "\t", "  ", " ", ", ", ".", "\n", "\x0b", " ; ", "\r\n"]
    docs = []
    for _ in range(80):
        size = int(rng.integers(0, 60))
        text = "".join(w + m for w, m in zip(rng.choice(words, size), rng.choice(marks, size)))
        docs.append((text, [None, "en", "de", "und"][rng.integers(4)]))
    long = " ".join(rng.choice(words, 4000))  # one piece of many chunks
    return docs + [(long, "en"), (long, "en"), ("a a a a a a a", "de"), (None, "en"), ("", None), (".,;", "fr"), ("once upon", "es")]


@pytest.mark.parametrize("one_in,bits", [(2, 64), (7, 1 << 16), (64, 1 << 12)])
def test_equals_a_count_of_all_phrases(spark, one_in, bits):
    docs = corpus(one_in)
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "text string, lang string, phrase string, n long").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(df, 6, 40, 100, one_in, bits).select(COLUMNS).collect())
    want = plain(docs, 6, 40)
    assert got == want and len(want) > 60


@pytest.mark.parametrize("one_in", [1, 2, 5])
def test_each_phrase_lies_in_one_chunk(one_in):
    pieces = [p for t in (corpus(3)[80][0], corpus(3)[0][0], corpus(3)[1][0]) for p in plain_pieces(t)]
    found, closed, line = co.parsed([" ".join(p).encode() for p in pieces], one_in)
    chunks = [(c.decode().split(" "), shut) for c, shut in zip(found, closed.tolist())]
    for size in range(1, 6):
        own = Counter(tuple(w[i : i + size]) for w, shut in chunks for i in range(len(w) - size + 1) if not shut or i < len(w) - co.TRIGGER)
        assert own == Counter(tuple(w[i : i + size]) for w in pieces for i in range(len(w) - size + 1))
    assert any(a[1] and a[0][-co.TRIGGER :] == b[0][: co.TRIGGER] for a, b in pairwise(chunks))
    assert sorted(set(line.tolist())) == list(range(len(pieces)))


def test_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**14 + 7, 9 * 10**16 + 1, 10**14 + 9, 10**14 + 11
    row = spark.createDataFrame([(a, n, left, right)], "a long, total long, l long, r long")
    score = row.select(F.expr(f"{co._whole('a')} * {co._whole('total')} * cast(1000 as decimal(4,0)) div ({co._whole('l')} * {co._whole('r')})")).first()[0]
    assert score == 1000 * a * n // (left * right)


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(df).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []
