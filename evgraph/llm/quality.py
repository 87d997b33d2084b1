"""Quality rules by distribution divergence.

Every language has two references, counted over all its documents: how often each class of characters occurs, and
how often each of its most common words (all others together are one more bin). A document is held against each
language by the Jensen-Shannon distance of its own two histograms; the nearest language counts. Short texts have
histograms too rough to judge: below a minimum length a rule does not apply.
"""

from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import id_and_bytes, map_documents

SYMBOLS = b"#*$%&|<>"  # fixed value
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "beyond")
NO_WORD_CHARACTER = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character
COUNTED_AT_ONCE = 300_000


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return CLASSES.index("beyond")
    kinds = (c.islower(), c.isupper(), c.isdigit(), c in " \t", c in "\n\r\v\f", c in ".,;:!?'\"-()", byte in SYMBOLS, True)
    return kinds.index(True)


BYTE_CLASS = np.zeros((256, len(CLASSES)), np.int64)
for _b in range(256):
    if not 0x80 <= _b < 0xC0:  # a character beyond ASCII counts once, by its first byte
        BYTE_CLASS[_b, _class_of(_b)] = 1


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules; a distance above its limit rejects, unless the text is below the length."""

    common_words: int = 64
    class_distance: float = 0.30
    word_distance: float = 0.50
    least_characters: int = 200
    least_words: int = 50
    base_least_words: int = 10
    base_repeat_percent: int = 20


def character_classes(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ BYTE_CLASS


def base_counts(text: bytes, words: list[bytes]) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    lines = Counter(line for line in text.split(b"\n") if line.split())
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, NO_WORD_CHARACTER)),
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": sum(lines.values()) - len(lines),
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of `width` words that occur more than once in the text."""
    shifted = lambda: zip(*(islice(words, k, None) for k in range(width)))
    if len(set(shifted())) == max(0, len(words) - width + 1):
        return 0
    seen = Counter(shifted())
    total, end = 0, 0
    for at, window in enumerate(shifted()):
        if seen[window] > 1:
            total += at + width - max(at, end)
            end = at + width
    return total


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2; 1 where one histogram is empty, 0 where both are."""
    if not p.sum() or not q.sum():
        return float(p.sum() != q.sum())
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: (a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum()
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, kind, item, n): counts of character classes ('class') and of the most common words ('word'; '' holds
    all others) over all texts of each non-null language: at most classes + common_words + 1 rows a language."""

    def count(batches):
        words: dict[str, Counter] = {}
        classes: dict = {}

        def out(final):
            rows = [(lang, "word", w, n) for lang, own in words.items() for w, n in own.items()]
            if final:
                rows += [(lang, "class", c.encode(), int(n)) for lang, v in classes.items() for c, n in zip(CLASSES, v)]
            words.clear()
            kinds = (("lang", pa.string()), ("kind", pa.string()), ("item", pa.binary()), ("n", pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                words.setdefault(lang, Counter()).update(text.lower().split())
                classes[lang] = classes.get(lang, 0) + character_classes(text)
                if sum(map(len, words.values())) > COUNTED_AT_ONCE:
                    yield out(False)
        yield out(True)

    known = docs.select("lang", F.col("text").cast("string").cast("binary").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = (
        known.mapInArrow(count, "lang string, kind string, item binary, n long")
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    )
    # a plain limit on the rank: each task keeps only that many words of a language before the shuffle
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    words = counts.filter("kind = 'word'").withColumn("rank", F.row_number().over(ranked))
    top = words.filter(F.col("rank") <= limits.common_words)
    whole = counts.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("whole"))
    named = top.groupBy("lang").agg(F.sum("n").alias("named"))
    rest = whole.join(named, "lang").select("lang", F.lit("word"), F.lit(b""), F.col("whole") - F.col("named"))
    return top.select("lang", "kind", "item", "n").union(rest).union(counts.filter("kind = 'class'"))


class Reference:
    def __init__(self, rows: list[tuple]):
        """From rows (kind, item, n) of one language."""
        words = sorted((bytes(i), n) for kind, i, n in rows if kind == "word")
        own = {bytes(i).decode(): n for kind, i, n in rows if kind == "class"}
        self.words = {w: k for k, (w, _) in enumerate(words)}
        self.word_counts = np.array([n for _, n in words], float)
        self.class_counts = np.array([own.get(c, 0) for c in CLASSES], float)

    def distances(self, classes: np.ndarray, words: Counter, n_words: int) -> tuple[float, float]:
        own = np.zeros(len(self.words))
        for w, k in self.words.items():
            own[k] = words.get(w, 0)
        own[self.words[b""]] = n_words - own.sum()
        return distance(classes, self.class_counts), distance(own, self.word_counts)


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base counts, nearest language, both distances, base_failed and kept of every row of `docs` (doc_id, text, lang).

    Null and empty texts have no words and fail the base rules. Where no language is known there is nothing to
    hold a text against: nearest is null and only the base rules decide. Repeated rows stay; an empty table gives
    an empty result; other columns are ignored.
    """
    rows: dict[str, list] = {}
    for lang, *row in references(docs, limits).collect():  # bounded by the number of languages
        rows.setdefault(lang, []).append(tuple(row))
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def run(batch):
        known = {lang: Reference(r) for lang, r in sorted(shared.value.items())}
        return batch | _columns([_judged(t or b"", known, limits) for t in batch["text"]])

    return map_documents(
        id_and_bytes(docs),
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "nearest string, class_distance double, word_distance double, base_failed boolean, kept boolean",
    )


def _columns(rows: list[dict]) -> dict:
    return {k: [r[k] for r in rows] for k in rows[0]}


def _judged(text: bytes, known: dict[str, Reference], limits: Limits) -> dict:
    words = text.split()
    out = base_counts(text, words)
    n = out["n_words"]
    failed = n < limits.base_least_words or 100 * out["n_repeat_words"] > limits.base_repeat_percent * n
    classes, counted = character_classes(text), Counter(text.lower().split())
    found = [(sum(d), lang, d) for lang, r in known.items() for d in [r.distances(classes, counted, n)]]
    _, nearest, (by_class, by_word) = min(found) if found else (0.0, None, (None, None))
    far = nearest is not None and (
        (classes.sum() >= limits.least_characters and by_class > limits.class_distance)
        or (n >= limits.least_words and by_word > limits.word_distance)
    )
    verdict = {"nearest": nearest, "class_distance": by_class, "word_distance": by_word, "base_failed": failed}
    return out | verdict | {"kept": not failed and not far}
