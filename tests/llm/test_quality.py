"""Base counts and distances against plain versions; edge cases of the verdict."""

import math
import re

import numpy as np

from evgraph.llm import quality


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": symbols,
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(hit)}


def test_base_counts_equal_plain_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4, 5, 6, 30, 80):
        for _ in range(20):
            text = "".join(w + s for w, s in zip(rng.choice(["a", "é", "b#", "x|y", " ", "\x1c"], n), rng.choice([" ", "\n", "\t", "\x0b", "\r\n", "  "], n)))
            assert quality.base_counts(text.encode(), text.encode().split()) == plain_base(text)


def test_distance():
    p, q = np.array([1.0, 3.0, 0.0]), np.array([0.0, 3.0, 5.0])
    a, b = p / 4, q / 8
    m = (a + b) / 2
    want = sum(x * math.log2(x / y) for x, y in zip(a, m) if x) / 2 + sum(x * math.log2(x / y) for x, y in zip(b, m) if x) / 2
    assert math.isclose(quality.distance(p, q), math.sqrt(want))
    assert quality.distance(p, p) == 0 and quality.distance(p, 0 * p) == 1 and quality.distance(0 * p, 0 * p) == 0


def test_verdicts_and_edge_cases(spark):
    rng = np.random.default_rng(2)
    prose = [" ".join(rng.choice("the of and a river stone walks slowly under bright trees near home".split(), 80)) + "." for _ in range(30)]
    texts = prose + [prose[0].upper() + "!!" * 400, "word " * 200, None, "", "too short", "| ".join(prose[1].split())]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, prose[0], None, 1)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept and not got[i].base_failed and got[i].nearest == "en" for i in range(30))
    assert not got[30].kept and not got[30].base_failed
    assert all(got[i].base_failed and not got[i].kept for i in (31, 32, 33, 34))
    assert not got[35].kept and got[None].kept
    assert quality.judge(docs.limit(0)).collect() == []
    unknown = quality.judge(docs.filter("lang IS NULL")).collect()
    assert unknown[0].nearest is None and unknown[0].kept
