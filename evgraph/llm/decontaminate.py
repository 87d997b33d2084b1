"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments. A segment holds whole documents: their words' postings (positions in the segment,
documents kept apart by a gap) as one ascending list per term. A test phrase is looked up from its rarest term: the
list of each further term, shifted by its offset, is intersected with what is left.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import free_model, id_and_bytes
from evgraph.session import materialize

WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEGMENT_BYTES = 4_000_000
GAP = 1_000  # free positions between documents; bounds phrase length plus slop
SEGMENT = """segment long, doc_ids array<long>, first array<int>, n_words array<int>, terms array<binary>,
             starts array<int>, positions array<int>"""
HIT = "segment long, doc int, doc_id long, start int, length int, phrase_id long"
PHRASE = "phrase_id long, terms array<binary>, offsets array<int>"


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and characters above ASCII; A-Z become a-z."""
    return text.translate(WORD_BYTES).split() if text else []


def _segment(docs: list[tuple[int | None, list[bytes]]], wanted) -> dict:
    ids: dict[bytes, int] = {}
    of_word: list[int] = []
    first, at = [], 0
    spots: list[np.ndarray] = []
    for _, words in docs:
        first.append(at)
        of_word += [ids.setdefault(w, len(ids)) for w in words]
        spots.append(np.arange(at, at + len(words), dtype=np.int64))
        at += len(words) + GAP
    terms = list(ids)
    keep = np.fromiter((wanted(t) for t in terms), bool, len(terms))
    term_of, spot = np.array(of_word, np.int32), np.concatenate(spots)
    term_of, spot = term_of[keep[term_of]], spot[keep[term_of]]
    order = np.argsort(term_of, kind="stable")
    sizes = np.bincount(term_of, minlength=len(terms))[keep]
    return {
        "segment": uuid.uuid4().int >> 65, "doc_ids": [d for d, _ in docs], "first": first, "n_words": [len(w) for _, w in docs],
        "terms": [t for t, k in zip(terms, keep) if k], "starts": np.concatenate(([0], sizes.cumsum())).astype(np.int32),
        "positions": spot[order].astype(np.int32),
    }


def build_index(docs: DataFrame, term_filter: "TermFilter | None" = None) -> DataFrame:
    """Segments of `docs` (doc_id, text), written as a table. Null texts have no words and stay in the index.

    A segment has a number of its own, drawn when it is written: with the place of a document in it, it tells rows apart.

    With `term_filter`, postings of terms that no test phrase holds are left out: a lookup would never read them.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(term_filter.bits) if term_filter else None
    schema = spark.createDataFrame([], SEGMENT).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        free_model()
        shape = to_arrow_schema(schema)
        wanted = TermFilter(bits.value).__contains__ if bits else lambda t: True

        def out(held):
            row = _segment(held, wanted)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in shape], schema=shape)

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                held.append((doc_id, words_of(text)))
                size += len(text or b"") + GAP
                if size > SEGMENT_BYTES:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return materialize(id_and_bytes(docs).mapInArrow(run, schema), "segments")


class TermFilter:
    """A bitmap over hashes of terms, of fixed size whatever the number of terms: may hold more, never fewer."""

    SLOTS = 1 << 20

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @classmethod
    def of(cls, terms: DataFrame) -> "TermFilter":
        """From a column `term` of binaries; at most SLOTS numbers come to the driver."""
        used = terms.select((F.crc32("term") % cls.SLOTS).alias("slot")).distinct().collect()
        bits = np.zeros(cls.SLOTS, bool)
        bits[[r.slot for r in used]] = True
        return cls(np.packbits(bits))

    def __contains__(self, term: bytes) -> bool:
        import zlib

        slot = zlib.crc32(term) % self.SLOTS
        return bool(self.bits[slot >> 3] >> (7 - (slot & 7)) & 1)


def windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, phrase_id, terms): each `width` consecutive words of an item, or all of a shorter one's words.

    Equal windows share a phrase_id, which numbers the distinct windows from 0.
    """

    def run(batches):
        for batch in batches:
            owners, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                own = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else ()
                owners += [item] * len(own)
                phrases += own
            yield pa.RecordBatch.from_pydict(
                {"item_id": pa.array(owners, pa.int64()), "terms": pa.array(phrases, pa.list_(pa.binary()))}
            )

    every = materialize(
        items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
        .mapInArrow(run, "item_id long, terms array<binary>"),
        "windows",
    )
    # numbered within hash groups: no single task orders all windows
    groups = 64
    distinct = every.select("terms").distinct().withColumn("part", F.pmod(F.xxhash64("terms"), F.lit(groups)))
    within = F.row_number().over(Window.partitionBy("part").orderBy("terms")).cast("long") - 1
    named = distinct.withColumn("phrase_id", within * groups + F.col("part")).select("terms", "phrase_id")
    return materialize(every.join(named, "terms"), "phrases")


def by_rarity(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """PHRASE rows whose terms stand from the rarest in the whole index to the most frequent, with their offsets.

    Phrases with a term that the index lacks can match nowhere and are left out.
    """
    counts = (
        index.select(F.explode(F.arrays_zip("terms", F.col("starts").alias("lo"), F.slice("starts", 2, F.size("terms")).alias("hi"))).alias("t"))
        .filter(F.col("t.terms").isNotNull())
        .groupBy(F.col("t.terms").alias("term"))
        .agg(F.sum(F.col("t.hi") - F.col("t.lo")).alias("n"))
    )
    parts = phrases.select("phrase_id", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    found = (
        parts.join(counts, "term")
        .groupBy("phrase_id", "size")  # a phrase has at most as many rows as words
        .agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("t"))
        .filter(F.size("t") == F.col("size"))
    )
    return found.select("phrase_id", F.col("t.term").alias("terms"), F.col("t.offset").alias("offsets"))


def _meet(left: np.ndarray, spots: np.ndarray, slop: int) -> np.ndarray:
    """Those of the ascending starts `left` that have one of the ascending `spots` within `slop` positions."""
    at = np.searchsorted(spots, left - slop)
    return left[(at < len(spots)) & (spots[np.minimum(at, len(spots) - 1)] <= left + slop)]


def find(index: DataFrame, phrases: DataFrame, slop: int = 0, block: int = 50_000) -> DataFrame:
    """(segment, doc, doc_id, start, length, phrase_id): where each phrase (PHRASE, ordered by `by_rarity`) occurs.

    slop 0 finds exact phrases. Otherwise it is proximity search: each term has an occurrence at most `slop` words
    from its place relative to the rarest term. Phrases are the stated query set: they go over the index in blocks
    of at most `block` phrases, which bounds what a task is sent.
    """
    spark = index.sparkSession
    blocks = max(1, -(-phrases.count() // block))
    part = F.pmod(F.xxhash64(F.col("phrase_id"), F.lit("block")), F.lit(blocks))
    out = None
    for b in range(blocks):
        queries = spark.sparkContext.broadcast([tuple(r) for r in phrases.filter(part == b).select("phrase_id", "terms", "offsets").collect()])
        hits = index.mapInArrow(_finder(queries, slop), HIT)
        out = hits if out is None else out.union(hits)
    return out


def _finder(queries, slop: int):
    def run(batches):
        by_anchor: dict[bytes, list] = {}
        for q in queries.value:
            by_anchor.setdefault(bytes(q[1][0]), []).append(q)
        kinds = {"long": pa.int64(), "int": pa.int32()}
        shape = pa.schema([(n, kinds[k]) for n, k in map(str.split, HIT.split(", "))])
        for batch in batches:
            for k in range(batch.num_rows):
                got = _lookup({n: batch.column(n)[k].values for n in batch.schema.names if n != "segment"}, by_anchor, slop)
                got = (np.full(len(got[0]), batch.column("segment")[k].as_py(), np.int64), *got)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, shape)], schema=shape)

    return run


def _lookup(segment: dict, by_anchor: dict[bytes, list], slop: int) -> tuple:
    starts, positions = segment["starts"].to_numpy(), segment["positions"].to_numpy()
    terms = {t: i for i, t in enumerate(segment["terms"].to_pylist())}
    first, n_words = segment["first"].to_numpy(), segment["n_words"].to_numpy()
    spots, anchors, lengths, names = ([np.empty(0, np.int64)] for _ in range(4))

    def postings(term):
        i = terms.get(bytes(term))
        return positions[:0] if i is None else positions[starts[i] : starts[i + 1]]

    for anchor in by_anchor.keys() & terms.keys():
        for name, needed, offsets in by_anchor[anchor]:
            left = postings(anchor).astype(np.int64) - offsets[0]
            for term, offset in zip(needed[1:], offsets[1:]):
                if not len(left):
                    break
                own = postings(term)
                left = _meet(left, own - offset, slop) if len(own) else left[:0]
            if len(left):
                spots.append(left)
                anchors.append(left + offsets[0])
                lengths.append(np.full(len(left), len(needed)))
                names.append(np.full(len(left), name))
    spot, anchor, length, name = map(np.concatenate, (spots, anchors, lengths, names))
    doc = np.searchsorted(first, anchor, "right") - 1  # the rarest term lies in the document, the start may not
    start = spot - first[doc]
    if slop:  # the gap keeps exact phrases inside a document
        end = np.minimum(start + length, n_words[doc])
        start = np.maximum(start, 0)
        length = end - start
    return doc, segment["doc_ids"].take(pa.array(doc)), start, length, name


def document_words(index: DataFrame) -> DataFrame:
    """(segment, doc, doc_id, n_words) of every row that was indexed."""
    return index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc", "d")).select(
        "segment", "doc", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings of item ids), contaminated, for each row of `docs`.

    `docs` has doc_id and text, `items` item_id and text. A word inside an occurrence of a window of `width` item words is hit; items
    without words never match, null texts have no words, empty tables give no hits. Rows are told apart by their place
    in the index: each counts its own hits, whether its doc_id is null or repeated.
    """
    owned = windows(items, width)
    phrases = owned.select("phrase_id", "terms").distinct()
    index = build_index(docs, TermFilter.of(phrases.select(F.explode("terms").alias("term"))))
    hits = materialize(find(index, by_rarity(index, phrases), slop), "hits")
    row = ["segment", "doc"]
    spans = hits.groupBy(*row, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(
        Window.partitionBy(*row).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    )  # places of one document only
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy(*row).agg(F.sum("fresh").alias("n_hit"))
    held = (
        hits.select(*row, "phrase_id").distinct()
        .join(owned.select("phrase_id", F.col("item_id").cast("string").alias("item")).distinct(), "phrase_id")
        .groupBy(*row)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return (
        document_words(index)
        .join(covered, row, "left")
        .join(held, row, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )
