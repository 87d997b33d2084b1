"""SimHash near-duplicates by pivot distance tables.

Equal fingerprints are one class. Two classes that differ in few bits agree on some of the bit blocks, which
brings them into one bucket. There a table of Hamming distances to reference fingerprints (pivots) is built;
since |d(x, p) - d(y, p)| <= d(x, y), pairs with a larger coordinate difference are discarded, and only the
survivors are compared bit by bit.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import free_model, id_and_bytes, map_documents
from evgraph.llm.components import components
from evgraph.session import materialize

SEED = 42
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of all `width`-word shingles, repeats included; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - last], ends[last:]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist())]
        octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, kind: str = "long") -> DataFrame:
    """(doc_id, fp) of every row of `docs`, ids being of type `kind`; null and wordless texts have fingerprint 0."""
    return map_documents(id_and_bytes(docs), _prints, f"doc_id {kind}, fp long")


def _prints(batch: dict) -> dict:
    free_model()  # the first pass over the texts after a stage that may have kept one
    return batch | {"fp": [fingerprint(t) for t in batch["text"]]}


def pivots(count: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)], np.uint64)


def bucket_keys(distance: int, spare: int) -> list[int]:
    """Bit masks: of distance + spare blocks, any `distance` differing bits leave all blocks of some mask alone."""
    n = distance + spare
    edges = np.linspace(0, 64, n + 1).astype(int).tolist()
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(pick)) for pick in combinations(blocks, spare)]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return up
        parent = up


def linked(bucket: np.ndarray, fps: np.ndarray, refs: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of each bucket at most `distance` apart; `bucket` names the bucket of each row.

    Rows are ordered by their first pivot distance inside a bucket. Pairs at lag 1, 2, … are looked at all
    together; a row whose first coordinate is out of reach at one lag stays so at the next.
    """
    table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    start = np.unique(bucket, return_inverse=True)[1]
    order = np.lexsort((table[:, 0], start))
    table, fps, start = table[order], fps[order], start[order]
    parent, left, right = np.arange(len(fps)), [], []
    rows, lag = np.arange(len(fps)), 0
    while len(rows):
        lag += 1
        rows = rows[rows + lag < len(fps)]
        other = rows + lag
        near = (start[rows] == start[other]) & (table[other, 0] - table[rows, 0] <= distance)
        rows, other = rows[near], other[near]
        i, j = rows, other
        for p in range(1, len(refs)):
            ok = np.abs(table[i, p] - table[j, p]) <= distance
            i, j = i[ok], j[ok]
        ok = np.bitwise_count(fps[i] ^ fps[j]) <= distance
        i, j = i[ok], j[ok]
        if len(i):
            parent = _roots(parent)
            new = parent[i] != parent[j]
            for a, b in zip(i[new].tolist(), j[new].tolist()):
                ra, rb = a, b
                while parent[ra] != ra:
                    ra = parent[ra]
                while parent[rb] != rb:
                    rb = parent[rb]
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    left.append(fps[a])
                    right.append(fps[b])
    return np.array(left, np.uint64), np.array(right, np.uint64)


def links(classes: DataFrame, distance: int = 4, spare: int = 2, pivot_count: int = 32, portion: int = 2048) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`, connected exactly as all pairs within `distance` bits are.

    A bucket of more than `portion` classes is cut into portions by hash, and each pair of portions is a group of
    its own: no group exceeds about twice that size and every pair still meets.
    """
    masks = bucket_keys(distance, spare)
    keyed = classes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k"),
    ).select("fp", "k.*")
    large = (
        keyed.groupBy("mask", "key")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > portion)
        .withColumn("portions", F.ceil(F.col("n") / portion).cast("long"))
        .drop("n")
    )
    spread = (
        keyed.join(large, ["mask", "key"], "left")
        .withColumn("portions", F.coalesce("portions", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("portions")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
        .withColumn("group", F.xxhash64("mask", "key", F.least("own", "other"), F.greatest("own", "other")))
    )
    # rows of one group lie side by side; two groups with equal hash are compared too, which links nothing wrongly
    grouped = spread.select("group", "fp").repartition("group").sortWithinPartitions("group")
    refs = pivots(pivot_count)

    def compare(batches):
        group, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def out(g, f):
            alone = np.ones(len(g), bool)  # a bucket of one class has nothing to compare
            same = g[1:] == g[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            a, b = linked(g[~alone], f[~alone], refs, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=shape)

        for batch in batches:
            group = np.concatenate((group, batch.column("group").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy().view(np.uint64)))
            if len(group) and group[0] != group[-1]:
                whole = np.searchsorted(group, group[-1])  # the last group may go on in the next batch
                yield out(group[:whole], fps[:whole])
                group, fps = group[whole:], fps[whole:]
        if len(group):
            yield out(group, fps)

    return grouped.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, kind: str = "long") -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row of `docs` (doc_id of type `kind`, text).

    Null and wordless texts share fingerprint 0 and link like any other. Repeated rows stay; a null doc_id gets the
    component of its fingerprint. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, kind), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = components(links(classes, distance))
    heads = (
        classes.join(found, classes.fp == found.node, "left")
        .select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    )
    least = heads.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = heads.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
