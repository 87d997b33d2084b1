"""The automaton against plain substring search; held-out accuracy; edge cases."""

import unicodedata
import zlib

import numpy as np

from evgraph.llm import language_id as li


def plain_phrases(known, word):
    count, at = 0, 0
    while at < len(word):
        end = at + 1
        while end < len(word) and any(word[at : end + 1] in k for k in known):
            end += 1
        count, at = count + 1, end
    return count


def test_phrases_are_longest_known_substrings():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(1, 9)))
    for _ in range(30):
        known = [word() for _ in range(rng.integers(1, 12))]
        automaton = li.SuffixAutomaton(known)
        for w in [word() + rng.choice(["", "z"]) + word() for _ in range(20)]:
            assert automaton.phrases(w) == plain_phrases(known, w)


def plain_prediction(known, size, text):
    """Language of fewest bits a letter, phrases cut by plain search in the training words."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c).startswith("L"):
            word += c
        elif word:
            words, word = words + [f" {word} "], ""
    if not words:
        return "und"
    bits = {n: sum(plain_phrases(k, w) for w in words) * np.log2(max(2, size[n])) / sum(map(len, words)) for n, k in known.items()}
    return min(sorted(bits), key=bits.get)


def test_predictions_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    stems = {"de": "sch ung ich ein tz".split(), "en": "th ing er wh ed".split(), "fr": "eau é que oi tion".split()}
    lines = [" ".join("".join(rng.choice(stems[n], rng.integers(1, 4))) for _ in range(8)) for n in stems for _ in range(20)]
    mixed = [" ".join(rng.permutation((lines[i] + " " + lines[-i]).split()).tolist()) + rng.choice([" ½²", "x²y", " 3", ""]) for i in range(1, 30)]
    rows = [(i, t, list(stems)[i // 20]) for i, t in enumerate(lines)] + [(100 + i, t, None) for i, t in enumerate(mixed)]
    rows += [(200, "½ ² Ⅷ", None), (201, "ing " * 60_000, None), (202, "12", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = {}
    for r in li.training_words(docs, 300, 4000, 64).collect():
        words.setdefault(r.lang, []).append(f" {r.word} ")
    size = {n: sum(map(len, w)) for n, w in words.items()}
    got = {r.doc_id: r.lang_pred for r in li.identify(docs).collect()}
    assert {i: got[i] for i, _, _ in rows if i != 201} == {i: plain_prediction(words, size, t) for i, t, _ in rows if i != 201}
    assert got[201] == "en" and got[200] == "und"


def test_equal_bits_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(i, "abc abd", lang) for i in range(1, 40) for lang in ("yy", "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in li.identify(docs).collect()} == {"xx"}


def test_held_out_accuracy_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    stems = {"en": "th ing er on wh ed".split(), "de": "sch ung ich ver ein tz".split(), "fr": "eau é ment que oi tion".split()}
    rows = []
    for i in range(300):
        lang = list(stems)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(stems[lang], rng.integers(1, 4))) for _ in range(20)), lang, "x"))
    rows += [(900, None, "en", ""), (901, "12 !", "en", ""), (902, "", None, ""), (None, "thing wher", None, ""), (0, rows[0][1], "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = li.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {i: g for i, _, g, _ in rows[:300]}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    wrong = [r.doc_id for r in got if r.doc_id in truth and r.doc_id and r.lang_pred != truth[r.doc_id]]
    assert not wrong
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == {900: "und", 901: "und", 902: "und"}
    assert [r.lang_pred for r in got if r.doc_id is None] == ["en"]
    assert {r.lang_pred for r in li.identify(docs.filter("lang IS NULL")).collect()} == {"und"}
    assert li.identify(docs.limit(0)).collect() == []
