"""Language identification by cross-parsing entropy.

Every language gets a suffix automaton of words from its labelled texts. A text is parsed, word by word, into the
longest phrases that occur in that language's words; with c phrases over n letters and a training text of m letters
the cross-entropy is estimated as c * log2(m) / n. The language needing the fewest bits wins.
"""

import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import held_out, id_and_bytes, map_documents, worker_model

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
CACHED_WORDS = 200_000


def words_of(text: str) -> list[str]:
    """Runs of letters; fractions, small figures and Roman numerals of their own are none."""
    words = WORDS.findall(text)
    if not words or "".join(words).isalpha():
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


class SuffixAutomaton:
    """All substrings of the added words; `phrases` cuts a word into longest known substrings."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self._link, self._len = [-1], [0]
        self.size = 0
        for word in words:
            last = 0
            for c in word:
                last = self._extend(last, c)
            self.size += len(word)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self._len.append(length)
        self._link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: str) -> int:
        """The state of exactly the strings that end in p's longest string and c."""
        q = self.next[p][c]
        if self._len[q] == self._len[p] + 1:
            return q
        clone = self._state(self._len[p] + 1, dict(self.next[q]), self._link[q])
        self._link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self._link[p]
        return clone

    def _extend(self, last: int, c: str) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self._len[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self._link[p]
        if p != -1:
            self._link[new] = self._split(p, c)
        return new

    def phrases(self, word: str) -> int:
        moves, state, count = self.next, 0, 1
        for c in word:
            step = moves[state].get(c)
            if step is None:
                count += state != 0
                step = moves[0].get(c)
                if step is None:  # a letter the language never uses is a phrase of its own
                    count += 1
                    step = 0
            state = step
        return count - (state == 0)


def training_words(docs: DataFrame, docs_per_lang: int, words_per_lang: int, word_chars: int) -> DataFrame:
    """(lang, word): the most frequent words of a bounded sample of labelled texts, both bounds per language.

    Words longer than `word_chars` are cut into pieces of that length.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        labelled.select("lang", "doc_id")
        .withColumn("rank", F.row_number().over(drawn))
        .filter(F.col("rank") <= docs_per_lang)
        .select("doc_id")
        .distinct()
    )
    texts = labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # at most docs_per_lang ids a language
    words = texts.select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"(\p{{L}}{{1,{word_chars}}})"), 1)).alias("word")
    )
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return (
        words.groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= words_per_lang)
        .select("lang", "word")
    )


class Languages:
    """The automata of all languages, built once in each worker from the bounded word lists."""

    def __init__(self, words: dict[str, list[str]]):
        self.names = sorted(words)
        self.automata = [SuffixAutomaton(f" {w} " for w in words[n]) for n in self.names]
        self.bits = np.array([np.log2(max(2, a.size)) for a in self.automata])
        self._ids: dict[str, int] = {}
        self._counts = np.zeros((2 * CACHED_WORDS, len(self.names)), np.int64)

    @classmethod
    def of(cls, key: str, words: dict[str, list[str]]) -> "Languages":
        return worker_model(("languages", key), lambda: cls(words))

    def phrase_counts(self, words: list[str]) -> np.ndarray:
        ids, counts = self._ids, self._counts
        total = np.zeros(len(self.names), np.int64)
        for at in range(0, len(words), CACHED_WORDS):
            rows = []
            if len(ids) > CACHED_WORDS:
                ids.clear()
            for w in words[at : at + CACHED_WORDS]:
                i = ids.get(w)
                if i is None:
                    i = ids[w] = len(ids)
                    counts[i] = [a.phrases(f" {w} ") for a in self.automata]
                rows.append(i)
            uses = np.bincount(rows)
            used = np.flatnonzero(uses)
            total += uses[used] @ counts[used]
        return total

    def predict(self, text: bytes | None) -> tuple[str, float, float | None]:
        """Language, its share of exp(-bits per letter) over all languages, and its bits per letter."""
        words = words_of(text.decode("utf-8", "replace").lower()) if text else []
        if not words or not self.names:
            return UNKNOWN, 0.0, None
        bits = self.phrase_counts(words) * self.bits / (sum(map(len, words)) + 2 * len(words))
        best = int(np.argmin(bits))  # the first name wins a tie
        return self.names[best], float(1 / np.exp(bits[best] - bits).sum()), float(bits[best])


def identify(
    docs: DataFrame, docs_per_lang: int = 300, words_per_lang: int = 4000, word_chars: int = 64, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_letter of every row of `docs` (doc_id, text, lang).

    Learned are the non-null `lang` values of rows outside the held-out fold, from a sample of at most
    `docs_per_lang` texts and `words_per_lang` words each. Null texts, texts without a letter, and all texts where
    nothing could be learned get `und` and score 0. Of languages with equal bits the first by name is taken. Rows repeat as they came; of the other columns those named in
    `carry` follow.
    """
    found = training_words(docs, docs_per_lang, words_per_lang, word_chars).collect()  # bounded by the parameters
    words: dict[str, list[str]] = {}
    for lang, word in found:
        words.setdefault(lang, []).append(word)
    words = {k: sorted(v) for k, v in words.items()}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    key = str(hash(tuple((k, tuple(v)) for k, v in sorted(words.items()))))

    def score(batch):
        model = Languages.of(key, shared.value)
        out = [model.predict(t) for t in batch["text"]]
        return batch | {n: [x[i] for x in out] for i, n in enumerate(("lang_pred", "score", "bits_per_letter"))}

    kinds = dict(docs.dtypes) | {"text": "binary"}
    found = map_documents(
        id_and_bytes(docs, held_out().alias("held_out"), *[c for c in carry if c != "text"]),
        score,
        "doc_id long, held_out boolean, lang_pred string, score double, bits_per_letter double"
        + "".join(f", `{c}` {kinds[c]}" for c in carry),
    )
    return found.withColumn("text", F.col("text").cast("string")) if "text" in carry else found
