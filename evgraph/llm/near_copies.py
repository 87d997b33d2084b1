"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

MinHash bands propose pairs, the shingle sets decide. With 30 bands of 5 a pair of similarity 0.8 meets in no band
with a chance of 0.672 ** 30, below 1e-5, and more similar ones more rarely. Members of a band's bucket are first
compared with its least member; what that does not join is then compared pair by pair, so that the components are
those of all verified pairs, and a large group of copies costs one comparison a member.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import ROWS_AT_ONCE, free_model
from evgraph.llm.components import components
from evgraph.llm.simhash import SEED, near_duplicates
from evgraph.session import materialize

WIDTH = 5
BANDS, ROWS = 30, 5
AT_ONCE = 4096
SPANS_AT_ONCE = 1 << 16
# Jaccard >= LEAST / OF, in whole numbers: OF * common >= LEAST * (a + b - common)
LEAST, OF = 4, 5

_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**64, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Ascending hashes of the distinct `width`-word shingles; a shorter text is one shingle, a wordless one none."""
    data = np.frombuffer((text or b"").lower(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    keep = ~space
    keep[1:] |= keep[:-1] & space[1:]  # one space after each word
    joined = np.where(space, np.uint8(32), data)[keep].tobytes().rstrip(b" ")
    if not joined:
        return np.empty(0, np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(ends)) - 1
    starts, ends = starts[: len(ends) - last], ends[last:]
    out = np.empty(len(starts), np.uint64)
    for at in range(0, len(out), SPANS_AT_ONCE):
        part = slice(at, at + SPANS_AT_ONCE)
        out[part] = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist())]
    return np.unique(out)


def band_keys(own: np.ndarray) -> list[int]:
    """One key a band; texts with an equal key in some band are compared. Wordless texts share their keys."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), AT_ONCE):
        part = own[at : at + AT_ONCE, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, part.min(0))
    bands = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(band.tobytes(), i)).view(np.int64)) for i, band in enumerate(bands)]


def text_key() -> Column:
    """The text itself, as 16 bytes; null and empty texts are alike."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def _similar(common: Column, a: Column, b: Column) -> Column:
    return (LEAST + OF) * common >= LEAST * (a + b)


def _keyed(texts: DataFrame) -> DataFrame:
    """(node, key): the distinct band keys of each text."""

    def run(batches):
        free_model()
        for batch in batches:
            keys = [band_keys(shingles(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["node", "keys"])

    return texts.mapInArrow(run, "node binary, keys array<long>").select("node", F.explode("keys").alias("key")).distinct()


def _sets(texts: DataFrame) -> DataFrame:
    """(node, own): the shingles of each text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(at, ROWS_AT_ONCE)
                own = [shingles(t.as_py()).view(np.int64) for t in rows.column("text")]
                yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    return texts.mapInArrow(run, "node binary, own array<long>")


def joined(nodes: list[bytes], groups: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links between similar sets, connected as all similar pairs are where `groups` are connected already."""
    if len(set(groups)) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    nodes, groups, sets = ([column[i] for i in order] for column in (nodes, groups, sets))
    sizes = np.array([len(s) for s in sets])
    # an empty set has one member of its own, which makes it equal to empty ones alone
    ids = np.unique(np.concatenate([s if len(s) else np.array([-1]) for s in sets]), return_inverse=True)[1]
    held = np.maximum(sizes, 1)
    starts = np.concatenate(([0], np.cumsum(held)[:-1]))
    root = np.unique(np.array([g.hex() for g in groups]), return_inverse=True)[1]
    mark = np.zeros(ids.max() + 1, np.int64)
    links = []
    fits = np.searchsorted(LEAST * held, OF * held, "right")  # a set is similar to none that is larger than it by a quarter
    for i in range(len(sets) - 1):
        later = slice(i + 1, int(fits[i]))
        if not np.any(root[later] != root[i]):
            continue
        mine = ids[starts[i] : starts[i] + held[i]]
        mark[mine] = 1
        end = starts[fits[i] - 1] + held[fits[i] - 1]
        common = np.add.reduceat(mark[ids[starts[i + 1] : end]], starts[later] - starts[i + 1])
        mark[mine] = 0
        for j in np.flatnonzero((LEAST + OF) * common >= LEAST * (held[i] + held[later])) + i + 1:
            if root[j] != root[i]:
                links.append((nodes[i], nodes[j]))
                root[root == root[j]] = root[i]
    return links


def _across(members: DataFrame, sets: DataFrame, portion: int, most: int) -> DataFrame:
    """(a, b): links inside the buckets of `members` (key, node, component) between members of different components.

    A bucket of more than `portion` shingles or `most` members is cut into portions by hash, and each pair of portions is a group.
    """
    open_keys = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    rows = members.join(open_keys, "key", "left_semi").join(sets, "node")
    rows = materialize(rows, "open_buckets")
    needed = F.greatest(F.ceil(F.sum(F.size("own") + 1) / portion), F.ceil(F.count("*") / most))
    parts = rows.groupBy("key").agg(needed.cast("long").alias("portions"))
    spread = (
        rows.join(parts, "key")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("portions")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
        .select("key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "node", "component", "own")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = [np.asarray(s.values) for s in group.column("own")]
        links = joined(group.column("node").to_pylist(), group.column("component").to_pylist(), sets)
        return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})

    return spread.groupBy("key", "first", "second").applyInArrow(compare, "a binary, b binary")


def links(texts: DataFrame, portion: int = 400_000, most: int = 2_000) -> DataFrame:
    """(a, b): links between the distinct texts of `texts` (node, text), connected exactly as all similar pairs that meet in a band."""
    keyed = materialize(_keyed(texts), "bands")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    shared = materialize(keyed.join(hubs, "key"), "shared_bands")
    met = shared.select("node").distinct()
    sets = materialize(_sets(texts.join(met, "node", "left_semi").dropDuplicates(["node"])), "shingles")
    pairs = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    # the far end first: a hub's own set then meets rows that are wide enough to be split
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("own").alias("left")), "a"
    )
    equal = (F.size("left") == 0) & (F.size("right") == 0)
    near = _similar(F.size(F.array_intersect("left", "right")), F.size("left"), F.size("right"))
    some = F.least(F.size("left"), F.size("right")) > 0
    verified = materialize(both.filter(equal | (some & near)).select("a", "b"), "verified")
    first = components(verified)
    members = shared.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    return verified.union(_across(materialize(members, "buckets"), sets, portion, most))


def fingerprint_links(texts: DataFrame) -> DataFrame:
    """(a, b): links that connect the texts of `texts` (node, text) as SimHash does: fingerprints 4 or fewer bits apart."""
    found = near_duplicates(texts.withColumnRenamed("node", "doc_id"), kind="binary")
    return found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()


def all_links(texts: DataFrame) -> DataFrame:
    """(a, b): the links of SimHash and those of near copies together."""
    return fingerprint_links(texts).union(links(texts))


def representatives(docs: DataFrame, linked=links) -> DataFrame:
    """(doc_id, node): one row of `docs` (doc_id, text) for each component of the links that `linked` finds: near copies or `all_links`.

    It is the one with the smallest doc_id, a null id only where a component has no other; `node` is `text_key`, which
    tells rows of one id apart. An empty table gives an empty result; other columns are ignored.
    """
    texts = docs.select(text_key().alias("node"), F.col("text").cast("string").cast("binary").alias("text"))
    found = components(linked(texts))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first")
    heads = docs.select("doc_id", text_key().alias("node")).groupBy("node").agg(first)
    named = heads.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.groupBy("component").agg(F.min("first").alias("first")).select("first.doc_id", "first.node")
