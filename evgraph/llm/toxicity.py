"""Toxicity by weak supervision.

Voters are words and word beginnings that labelled texts tie to toxicity, a small lexicon, and patterns of writing.
A generative model of the votes given the hidden label is fitted by expectation-maximisation over all texts outside
the held-out fold; labels are observed where they exist. It estimates each voter's rates in both classes and, given
the class, the correlations between voters, by which the say of voters that repeat each other is divided. A linear
classifier on words and word beginnings, the lexicon and the patterns is then trained on the model's posterior labels.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import held_out, id_and_bytes, map_documents
from evgraph.session import materialize

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
# Insults that need no label to vote.
LEXICON = frozenset("bastard bloody clown cretin dumb fool idiot imbecile loser moron pathetic scum stupid trash worthless".split())
PATTERNS = {
    "lexicon": lambda text, words: not LEXICON.isdisjoint(words),
    "lexicon_twice": lambda text, words: len(LEXICON & words) > 1,
    "shouting": lambda text, words: sum(map(str.isupper, text)) * 2 > max(20, sum(map(str.isalpha, text))),
    "exclaiming": lambda text, words: text.count("!!") > 2,
    "addressing": lambda text, words: re.search(r"\b(?:you|du|tu|usted)\b[^.!?\n]{0,40}!", text, re.IGNORECASE) is not None,
}
MOST_VOTERS = 63  # votes of a text are bits of one number


def terms_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer words, which a caret marks."""
    return words | {"^" + w[:n] for n in BEGINNINGS for w in words if len(w) > n}


def _read(text: bytes | None) -> tuple[str, set[str]]:
    plain = text.decode("utf-8", "replace") if text else ""
    return plain, set(LETTERS.findall(plain.lower()))


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of known labels, the higher one where an id has several."""
    return labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def _drawn(rows: DataFrame, is_bad, most: int) -> DataFrame:
    """At most `most` rows of either class, the first by a hash of doc_id: each task keeps no more than that."""
    first = lambda part: part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return first(rows.filter(is_bad)).union(first(rows.filter(~is_bad)))


def merged(terms: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without terms that stand in the same texts as a shorter beginning of theirs.

    A word's texts are among those of its beginnings, so equal numbers mean equal texts.
    """
    counts = {t: (b, g) for t, b, g in terms}

    def repeats(term, own):
        word = term.lstrip("^")
        return any(counts.get("^" + word[:n]) == own for n in BEGINNINGS if n < len(word))

    return [(t, b, g) for t, b, g in terms if not repeats(t, (b, g))]


def associated_terms(docs: DataFrame, sample: DataFrame, least: int, chi_square: float) -> tuple[list[tuple[str, int, int]], int, int]:
    """(term, toxic texts, clean texts) of all terms in at least `least` texts whose chi-square reaches `chi_square`, the
    largest first, and the numbers of toxic and clean texts. Each distinct text of the sample counts once.
    """

    def count(batches):
        for batch in batches:
            seen = ({}, {})
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                own = seen[toxic]
                for t in terms_of(_read(text.as_py())[1]):
                    own[t] = own.get(t, 0) + 1
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({
                "term": pa.array(names, pa.string()), "bad": pa.array([seen[1].get(t, 0) for t in names], pa.int64()),
                "good": pa.array([seen[0].get(t, 0) for t in names], pa.int64()),
            })

    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic").distinct()  # the sample is bounded
    rows = materialize(rows, "sampled_texts")
    counts = rows.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    bad, good = sizes[1], sizes[0]
    share = (F.col("bad") + F.col("good")) / float(bad + good)
    gap = F.col("bad") / float(bad) - F.col("good") / float(good)
    chi = F.pow(gap, 2) / (share * (1 - share) * (1 / bad + 1 / good) + 1e-12)
    tied = counts.filter(F.col("bad") + F.col("good") >= least).filter(chi >= chi_square).orderBy(chi.desc(), "term")
    return merged([tuple(r) for r in tied.collect()]), bad, good


def voters_among(terms: list[tuple[str, int, int]], bad: int, good: int, precision: float) -> list[str]:
    """Terms in a thirtieth of the toxic texts whose texts would be toxic at `precision` if both classes were equally large.

    A term that begins like a beginning chosen before it would only repeat that vote and is passed over.
    """
    chosen: list[str] = []
    for term, b, g in terms:
        known = {"^" + term.lstrip("^")[:n] for n in BEGINNINGS}.intersection(chosen)
        if not known and 30 * b >= bad and b / bad >= precision * (b / bad + g / good):
            chosen.append(term)
    return chosen[: MOST_VOTERS - len(PATTERNS)]


class Votes:
    def __init__(self, terms: list[str]):
        self.bits = {t: 1 << i for i, t in enumerate(terms)}
        self.size = len(terms) + len(PATTERNS)

    def of(self, text: bytes | None) -> int:
        plain, words = _read(text)
        mask = 0
        for t in terms_of(words) & self.bits.keys():
            mask |= self.bits[t]
        for i, pattern in enumerate(PATTERNS.values(), len(self.bits)):
            mask |= pattern(plain, words) << i
        return mask


class LabelModel:
    """Rates of the voters in both classes, their correlations given the class, the chance of no vote at all, and the
    share of toxic texts.

    That one voter is silent where others speak says nothing: voters look for different things.
    """

    def __init__(self, both: np.ndarray, weight: np.ndarray, correlated: float = 0.2):
        """`both[y]` sums products of votes over class y, the last "vote" being silence; `weight[y]` counts its texts."""
        self.share = (weight[1] + 1) / (weight.sum() + 2)
        own = np.diagonal(both, axis1=1, axis2=2)
        self.silence = (own[:, -1] + 1) / (weight + 2)
        self.rates = (own[:, :-1] + 1) / (weight[:, None] + 2)
        pairs = both[:, :-1, :-1] / np.maximum(weight, 1)[:, None, None]
        sigma = np.sqrt(self.rates * (1 - self.rates))
        correlation = (pairs - self.rates[:, :, None] * self.rates[:, None, :]) / (sigma[:, :, None] * sigma[:, None, :])
        self.correlation = np.clip((correlation * (weight / max(1, weight.sum()))[:, None, None]).sum(0), -1, 1)
        self.shared = np.where(self.correlation >= correlated, self.correlation, 0)
        np.fill_diagonal(self.shared, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a text with these votes (rows of 0 and 1, the last column silence) is toxic."""
        silent, cast = votes[:, -1] > 0, votes[:, :-1]
        odds = np.log(self.rates[1] / self.rates[0])
        # votes that repeat each other share one say
        spoken = (cast * odds / np.maximum(1, cast @ self.shared)).sum(1)
        total = np.log(self.share / (1 - self.share)) + np.where(silent, np.log(self.silence[1] / self.silence[0]), spoken)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def unpacked(masks: np.ndarray, size: int) -> np.ndarray:
    """Rows of 0 and 1 for each voter, and one more for silence."""
    votes = (masks[:, None] >> np.arange(size) & 1).astype(float)
    return np.hstack((votes, votes.sum(1, keepdims=True) == 0))


def _chances(model: LabelModel | None, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Label where known (0 or 1), else the model's posterior; without a model unknown texts count nowhere."""
    guess = model.posterior(votes) if model else np.full(len(votes), np.nan)
    return np.where(labels >= 0, labels, guess)


def _expected(patterns: DataFrame, model: LabelModel | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all texts of products of votes for each class, and of the classes' weights."""
    wide = size + 1

    def run(batches):
        both, weight = np.zeros((2, wide, wide)), np.zeros(2)
        for batch in batches:
            votes = unpacked(batch.column("mask").to_numpy(), size)
            chance = _chances(model, votes, batch.column("label").to_numpy())
            n = np.where(np.isnan(chance), 0, batch.column("n").to_numpy())
            chance = np.nan_to_num(chance)
            for y, w in ((0, n * (1 - chance)), (1, n * chance)):
                both[y] += (votes * w[:, None]).T @ votes
                weight[y] += w.sum()
        i, j = np.indices((wide, wide))
        yield pa.RecordBatch.from_pydict({
            "i": np.append(i.ravel(), -1), "j": np.append(j.ravel(), -1),
            "clean": np.append(both[0].ravel(), weight[0]), "toxic": np.append(both[1].ravel(), weight[1]),
        })

    sums = patterns.mapInArrow(run, "i long, j long, clean double, toxic double").groupBy("i", "j").agg(F.sum("clean"), F.sum("toxic"))
    both, weight = np.zeros((2, wide, wide)), np.zeros(2)
    for i, j, clean, toxic in sums.collect():  # one row for each pair of voters
        if i < 0:
            weight[:] = clean, toxic
        else:
            both[:, i, j] = clean, toxic
    return both, weight


def fit_label_model(votes: DataFrame, size: int, rounds: int) -> tuple[LabelModel, np.ndarray]:
    """The model over `votes` (mask, label or -1) of all texts, and the weights of both classes; starts from the labels."""
    patterns = materialize(votes.groupBy("mask", "label").agg(F.count("*").alias("n")), "vote_patterns")
    model = LabelModel(*_expected(patterns, None, size))
    for _ in range(rounds):
        both, weight = _expected(patterns, model, size)
        model = LabelModel(both, weight)
    return model, weight


def fit_linear(
    rows: list[np.ndarray], size: int, chance: np.ndarray, weight: np.ndarray, steps: int = 12, penalty: float = 1e-5
) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant) on soft labels, by Newton steps.

    `rows` has the inputs of each text that are 1, of `size` ones. Each step is solved by conjugate gradients, so that
    only the ones are kept.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    column = np.concatenate([np.append(r, size) for r in rows]).astype(np.int64)
    forward = lambda w: np.bincount(row, w[column], len(rows))
    backward = lambda v: np.bincount(column, v[row], size + 1)
    weight = weight / weight.sum()
    ridge = np.full(size + 1, penalty)
    ridge[-1] = 1e-9
    w = np.zeros(size + 1)
    for _ in range(steps):
        guess = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        slope = backward((guess - chance) * weight) + ridge * w
        curve = weight * guess * (1 - guess)
        move = _solved(lambda v: backward(curve * forward(v)) + ridge * v, slope, backward(curve) + ridge)
        w = w - move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _solved(matrix, right: np.ndarray, diagonal: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x with matrix(x) = right, by conjugate gradients scaled by the diagonal."""
    x, rest = np.zeros_like(right), right.copy()
    scaled = rest / diagonal
    way, size = scaled.copy(), rest @ scaled
    least = size * 1e-16
    for _ in range(rounds):
        if size <= least:
            break
        ahead = matrix(way)
        far = size / (way @ ahead)
        x += far * way
        rest -= far * ahead
        scaled = rest / diagonal
        size, before = rest @ scaled, size
        way = scaled + size / before * way
    return x


def score(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 8_000,
    least: int = 5,
    chi_square: float = 15.137,
    precision: float = 0.995,
    rounds: int = 4,
) -> DataFrame:
    """doc_id, held_out and score of every row of `docs` (doc_id, text).

    Learned from are the labels outside the held-out fold. Terms are chosen, and the linear classifier is fitted, on
    samples of at most `sample` texts of either class, copies merged where terms are chosen; the label model covers all
    texts outside the fold. The classifier's inputs are all terms whose chi-square reaches `chi_square` (chance of one in
    10 000 for a term without a tie to the labels), the lexicon and the patterns. Where
    one of the classes has no label every score is 0. Null and empty texts have no word and score as such; repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = id_and_bytes(docs, held_out().alias("held_out"))
    learned = texts.filter(~F.col("held_out")).select("doc_id", "text")
    known = _labels(labels).filter(~held_out())
    copies = learned.select("doc_id", F.md5(F.coalesce("text", F.lit(b""))).alias("copy")).join(known, "doc_id")
    distinct = copies.groupBy("copy", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct()
    labelled = materialize(_drawn(distinct, F.col("toxic") > 0, sample), "labelled")
    sizes = dict(labelled.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return texts.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    terms, bad, good = associated_terms(learned, labelled, least, chi_square)
    chosen = spark.sparkContext.broadcast(voters_among(terms, bad, good, precision))

    def vote(batch):
        voters = Votes(chosen.value)
        return batch | {"mask": [voters.of(t) for t in batch["text"]]}

    size = len(chosen.value) + len(PATTERNS)
    votes = materialize(
        map_documents(learned, vote, "doc_id long, mask long")
        .join(known, "doc_id", "left")
        .select("doc_id", "mask", F.coalesce("toxic", F.lit(-1)).cast("long").alias("label")),
        "votes",
    )
    model, weight = fit_label_model(votes, size, rounds)

    def chances(batches):
        for batch in batches:
            found = _chances(model, unpacked(batch.column("mask").to_numpy(), size), batch.column("label").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(found >= 0.5)], names=["doc_id", "chance", "bad"])

    taken = _drawn(votes.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).mapInArrow(chances, "doc_id long, chance double, bad boolean"), F.col("bad"), sample)
    names = spark.sparkContext.broadcast({t: i for i, (t, _, _) in enumerate(terms)})

    def present(text):
        plain, words = _read(text)
        found = [names.value[t] for t in terms_of(words) & names.value.keys()]
        return found + [i for i, holds in enumerate(PATTERNS.values(), len(names.value)) if holds(plain, words)]

    found = map_documents(
        learned.join(F.broadcast(taken), "doc_id"),  # the sample is bounded
        lambda b: b | {"terms": [present(t) for t in b["text"]]},
        "chance double, terms array<int>",
    ).collect()
    chance = np.array([r.chance for r in found])
    toxic = chance >= 0.5
    # each class counts as often as it occurs among all texts
    share = np.where(toxic, weight[1] / max(1, toxic.sum()), weight[0] / max(1, (~toxic).sum()))
    line = fit_linear([np.array(r.terms, np.int64) for r in found], len(terms) + len(PATTERNS), chance, share)

    def linear(batch):
        out = [1 / (1 + np.exp(-np.clip(line[-1] + line[present(t)].sum(), -500, 500))) for t in batch["text"]]
        return batch | {"score": out}

    return map_documents(texts, linear, "doc_id long, held_out boolean, score double")
