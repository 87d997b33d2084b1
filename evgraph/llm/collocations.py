"""Collocations by prefix-free parsing: words that stand together more often than their parts would by chance.

Pieces of text are parsed into chunks that begin and end at trigger windows, which the words alone decide, so passages
that recur are cut alike wherever they stand. Two neighbouring chunks share the trigger between them; a phrase that
starts inside it belongs to the later chunk, so that each occurrence of a phrase lies in one chunk only. The distinct
chunks of a language with the number of times each was parsed are the dictionary, and phrases are counted there, an
occurrence as often as its chunk.

Counting goes length by length: a phrase is frequent only if the one without its first word and the one without its
last are. A bitmap of fixed size tells which phrases may be frequent; it can only let through too many, and the
counts decide.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.tables import top_k
from evgraph.session import materialize

LONGEST = 5
TRIGGER = LONGEST - 1  # words of a trigger window: a phrase that starts before one ends within it
ONE_IN = 64  # windows of words that are triggers
BITMAP_BITS = 1 << 25
UNKNOWN = "und"
BYTES_AT_ONCE = 6_000_000
SPACE, BREAK = 32, 10
_TO_BREAK = bytes(BREAK if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_random = np.random.default_rng(42)
_OCTET = _random.integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_MIX, _SPREAD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse, as far as needed


def _grown(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers


def appended(prefix: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but their last word and of that word."""
    mixed = (prefix * _MIX) ^ words
    mixed ^= mixed >> np.uint64(31)
    return mixed * _SPREAD


class Words:
    """The words of `lines`, which are words with single spaces between them: places in `data`, hashes, words left in the line.

    Hashes have 64 bits: of 10 ** 9 different words no two are alike with a chance of 97 %.
    """

    def __init__(self, lines: list[bytes]):
        self.data = b"\n".join(lines) + b"\n" * bool(lines)
        octets = np.frombuffer(self.data, np.uint8)
        self.ends = np.flatnonzero((octets == SPACE) | (octets == BREAK))
        self.starts = np.concatenate(([0], self.ends[:-1] + 1))[: len(self.ends)]
        up, down = _grown(len(octets) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OCTET[octets] * up[: len(octets)])))
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = appended(own, (self.ends - self.starts).astype(np.uint64))
        self.lasts = np.flatnonzero(octets[self.ends] == BREAK) if lines else np.empty(0, np.int64)
        lengths = np.diff(self.lasts, prepend=-1)
        self.left = np.repeat(self.lasts + 1, lengths) - np.arange(len(self.ends))

    def phrases(self, length: int, seeds: np.ndarray | None = None) -> np.ndarray:
        """Hash of the phrase of `length` words at each place that has so many words behind it, whatever the line."""
        count = max(0, len(self.hashes) - length + 1)
        out = self.hashes[:count] if seeds is None else appended(seeds[:count], self.hashes[:count])
        for k in range(1, length):
            out = appended(out, self.hashes[k : count + k])
        return out


def language_hash(lang: str) -> np.uint64:
    return Words([lang.encode().replace(b" ", b"_").replace(b"\n", b"_")]).hashes[0]


def parsed(lines: list[bytes], one_in: int = ONE_IN):
    """(chunks, closed, line): the chunks of some lines, and the line of each. The phrases that start in the last
    TRIGGER words of a closed chunk, its trigger, belong to the next."""
    words = Words(lines)
    windows = words.phrases(TRIGGER)
    cuts = np.flatnonzero((windows >> np.uint64(32)) < np.uint64(2**32 // one_in))
    cuts = cuts[words.left[cuts] >= TRIGGER]  # inside a line
    firsts = np.concatenate(([0], words.lasts[:-1] + 1))[: len(lines)]
    starts = np.union1d(firsts, cuts)
    line = np.searchsorted(firsts, starts, "right") - 1
    closed = np.concatenate((line[1:] == line[:-1], [False]))[: len(starts)]
    last = words.lasts[line]
    last[closed] = starts[1:][closed[:-1]] + TRIGGER - 1
    spans = zip(words.starts[starts].tolist(), words.ends[last].tolist())
    return [words.data[a:b] for a, b in spans], closed, line


def dictionary(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(lang, chunk, closed, times): the distinct chunks of `docs` (text, lang), and how often each was parsed."""

    def out(lines, langs):
        chunks, closed, line = parsed(lines, one_in)
        owner = pa.array(langs, pa.string()).take(pa.array(line, pa.int64()))
        return pa.RecordBatch.from_arrays([owner, pa.array(chunks, pa.binary()), pa.array(closed, pa.bool_())], names=["lang", "chunk", "closed"])

    def run(batches):
        lines, langs, size = [], [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                text = (text.as_py() or b"").lower().translate(_TO_BREAK)
                own = [b" ".join(w) for w in map(bytes.split, text.split(b"\n")) if w]
                lines += own
                langs += [lang] * len(own)
                size += len(text)
                if size > BYTES_AT_ONCE // 4:
                    yield out(lines, langs)
                    lines, langs, size = [], [], 0
        yield out(lines, langs)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(lang, F.col("text").cast("string").cast("binary").alias("text"))
    chunks = texts.mapInArrow(run, "lang string, chunk binary, closed boolean")
    return chunks.groupBy("lang", "chunk", "closed").agg(F.count("*").alias("times"))


def frequent(chunks: list[bytes], closed: list[bool], times: list[int], length: int, lang: str, bits: np.ndarray, size: int):
    """(phrase, count) in chunks: all words, or phrases of `length` words whose beginning and end are in the bitmap."""
    words = Words(chunks)
    lengths = np.diff(words.lasts, prepend=-1)
    elsewhere = np.repeat(closed, lengths) & (words.left <= TRIGGER)  # counted in the next chunk
    weight = np.where(elsewhere, 0, np.repeat(times, lengths))
    hashes = words.phrases(length)
    fit = (words.left[: len(hashes)] >= length) & (weight[: len(hashes)] > 0)
    if length > 1:
        at = words.phrases(length - 1, np.full(len(words.hashes), language_hash(lang), np.uint64)) % np.uint64(size)
        maybe = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        fit &= maybe[:-1] & maybe[1:]
    places = np.flatnonzero(fit)
    _, first, number = np.unique(hashes[places], return_index=True, return_inverse=True)
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, number, weight[places])
    spots = places[first]
    return [words.data[a:b] for a, b in zip(words.starts[spots].tolist(), words.ends[spots + length - 1].tolist())], counts


def _by_language(batches):
    """(lang, chunks, closed, times) of a few MB of chunks each."""
    held: dict[str, tuple] = {}
    sizes: Counter = Counter()
    for batch in batches:
        for lang, chunk, closed, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "closed", "times"))):
            own = held.setdefault(lang, ([], [], []))
            own[0].append(chunk)
            own[1].append(closed)
            own[2].append(times)
            sizes[lang] += len(chunk)
            if sizes[lang] > BYTES_AT_ONCE or len(held) > 64:
                largest = max(sizes, key=sizes.get)
                yield largest, *held.pop(largest)
                del sizes[largest]
    for lang, own in held.items():
        yield lang, *own


def _counted(chunks: DataFrame, length: int, bits: bytes, size: int) -> DataFrame:
    """(lang, phrase, n): words, or phrases of `length` words that may be frequent by the bitmap."""
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bitmap = np.frombuffer(shared.value, np.uint8)
        for lang, own, closed, times in _by_language(batches):
            found, counts = frequent(own, closed, times, length, lang, bitmap, size)
            columns = [pa.array([lang]).take(pa.array(np.zeros(len(found), np.int64))), pa.array(found, pa.binary()), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

    return chunks.mapInArrow(run, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bitmap(known: DataFrame, length: int, size: int) -> bytes:
    """`size` bits: set at the hash of each of `known` (lang, phrase), all of `length` words. At most size / 8 bytes
    come to the driver."""

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            seed = {lang: language_hash(lang) for lang in set(langs)}
            hashes = Words(batch.column("phrase").to_pylist()).hashes.reshape(-1, length)
            out = np.array([seed[lang] for lang in langs], np.uint64)
            for k in range(length):
                out = appended(out, hashes[:, k])
            yield pa.RecordBatch.from_arrays([pa.array((out % np.uint64(size)).astype(np.int64))], names=["bit"])

    bits = known.select("lang", "phrase").mapInArrow(run, "bit long")
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("at").to_numpy()] = batch.column("word").to_numpy()
    return out.tobytes()


def phrases(chunks: DataFrame, least: int, size: int = BITMAP_BITS) -> list[DataFrame]:
    """All words of the dictionary `chunks`, then its phrases of 2 to LONGEST words: (lang, phrase, n), n >= `least`."""
    found = [materialize(_counted(chunks, 1, b"", size), "words")]
    often = found[0].filter(F.col("n") >= least)
    for length in range(2, LONGEST + 1):
        often = materialize(_counted(chunks, length, bitmap(often, length - 1, size), size).filter(F.col("n") >= least), "phrases")
        found.append(often)
    return found


def _part(start, length):
    return F.array_join(F.slice("words", start, length), " ")


def collocations(
    docs: DataFrame, least: int = 100, first: int = 2000, cover: int = 100, one_in: int = ONE_IN, bitmap_bits: int = BITMAP_BITS
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the `first` phrases of each language of `docs` (text, lang).

    a, l and r count the phrase and its two parts at the cut of least score, floor(1000 a n / (l r)), where n counts the
    language's words; of equal cuts the earliest counts. A phrase with fewer than `least` occurrences is none; one that a
    longer one holds with `cover` percent of its occurrences or more is dropped. Order is score, then a, both
    descending, then phrase by bytes, so that ranks have no ties. Null texts are empty, a null lang is `und`; rows
    that repeat count again; an empty table gives an empty result; other columns are ignored.
    """
    every = phrases(materialize(dictionary(docs, one_in), "chunks"), least, bitmap_bits)
    sizes = materialize(every[0].groupBy("lang").agg(F.sum("n").alias("total")), "language_sizes")
    known = every[0].filter(F.col("n") >= least)
    for found in every[1:]:
        known = known.union(found)
    known = known.withColumn("phrase", F.col("phrase").cast("string"))
    words = F.split("phrase", " ")
    candidates = known.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).filter(F.size("words") > 1)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("words")).alias("right"))
    scored = (
        cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        .join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        .join(sizes, "lang")
        .withColumn("score", F.expr(f"{_whole('a')} * {_whole('total')} * cast(1000 as decimal(4,0)) div ({_whole('l')} * {_whole('r')})"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("total").alias("n"))
    )
    inner = candidates.filter(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("length"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("start"))
    longer = inner.groupBy("lang", _part(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < cover * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return top_k(rows, ["lang"], order, first, "rank").withColumn("rank", F.col("rank").cast("long"))


def _whole(column: str) -> str:
    """Counts below 10 ** 17 in decimals: products of three of them, one small, fit into 38 digits."""
    return f"cast({column} as decimal(17,0))"
