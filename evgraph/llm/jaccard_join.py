"""Jaccard join of shingle sets by partitions of the universe and the pigeonhole principle.

Sets are put into bands by size; the larger set of a pair decides where the two meet, and the smaller one is listed
there too. Two similar sets of a band differ in at most H tokens. The band's universe of hashed tokens is cut into
H + 1 segments, and each segment gets a share: 0 (not looked at), 1 (sets with an equal subset in it meet) or 2 (so do
sets whose subsets differ in one token: each set is also listed under its subset with one token deleted). If the shares
sum to H + 1, some segment differs in fewer tokens than its share, so similar sets meet. Shares are moved from segments
where many sets meet to ones where few do, if that costs less than listing the deletions there. Sets below the largest of
a band share several keys if they are similar; then only the rarest of each set are looked at.

Equal sets are one node. The sets that meet are verified exactly: first with the member of their bucket that meets
most others; what is not one component in a bucket by then is compared pair by pair, portion by portion if many.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evgraph.llm.components import components
from evgraph.llm.near_copies import shingles
from evgraph.session import materialize

WIDTH = 3
LEAST, OF = 90, 100  # similar: OF * common >= LEAST * (a + b - common)
DELETION_PRICE = 1.0  # of listing one deletion, in units of an eighth of a token verified
WIDER = 4  # halves: a band's sizes double, so that few sets are listed in two
SMALL = 16  # members of a bucket whose pairs are listed
KNOWN_SETS = 100_000
BITMAP_BITS = 1 << 25
MEMBERS, TOKENS = 512, 400_000  # of a portion
COLUMNS_AT_ONCE = 4096
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def similar(common, a, b):
    return (LEAST + OF) * common >= LEAST * (a + b)


class Bands:
    """Band b holds the sizes lows[b] .. lows[b + 1] - 1; a set is similar to none beyond the band next to its own."""

    def __init__(self):
        self.lows = [1]

    def of(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, self.lows[-1] * WIDER // 2))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def top(self, band: int) -> int:
        while len(self.lows) < band + 2:
            self.of(self.lows[-1])
        return self.lows[band + 1] - 1

    def segments(self, band: int) -> int:
        """One more than the tokens that similar sets can differ in where the larger one is of this band."""
        return 2 * self.top(band) * (OF - LEAST) // (OF + LEAST) + 1

    def surplus(self, size: int, band: int) -> int:
        """Keys that a set and any similar one share in a band beyond the first; those of most sets need not be looked at."""
        largest = min(self.top(band), size * OF // LEAST)
        return self.segments(band) - (size + largest) * (OF - LEAST) // (OF + LEAST) - 1

    def listed_in(self, size: int) -> list[int]:
        own = self.of(size)
        return [own] + [own + 1] * (size * OF // LEAST > self.top(own))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _named(sums: np.ndarray, sizes: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    at = mixed(segment.astype(np.uint64) + np.uint64(1 + (band << 32)))
    return mixed(sums + sizes.astype(np.uint64) * _A + at).view(np.int64)


def segment_keys(tokens: np.ndarray, band: int, segments: int, deletions_in: np.ndarray | None = None) -> np.ndarray:
    """Keys of the subsets of ascending `tokens` by segment, or those of all subsets less one token in `deletions_in`."""
    segment = ((tokens >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)  # ascends with the tokens
    bounds = np.searchsorted(segment, np.arange(segments + 1, dtype=np.uint64))
    values = mixed(tokens * _A)
    up_to = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    sums, sizes = up_to[bounds[1:]] - up_to[bounds[:-1]], np.diff(bounds)
    if deletions_in is None:
        return _named(sums, sizes, np.arange(segments), band)
    place = segment.astype(np.int64)
    chosen = np.isin(place, deletions_in)
    place = place[chosen]
    return _named(sums[place] - values[chosen], sizes[place] - 1, place, band)


def shares(excess: np.ndarray, peers: int, top: int, price: float = DELETION_PRICE) -> np.ndarray:
    """Share of each segment, in sum one each. `excess` counts the members beyond the first of its buckets, `peers` the
    sets of the band, `top` the tokens of the largest."""
    n = len(excess)
    out = np.ones(n, np.int64)
    order = np.argsort(excess, kind="stable")
    verify, listing = top / 8, price * peers * (1 + top / n)
    for cheap, dear in zip(order[: n // 2], order[::-1]):
        if verify * excess[dear] <= 3 * verify * excess[cheap] + listing:
            break
        out[cheap], out[dear] = 2, 0
    return out


def _hash(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text, 7)).view(np.int64))


def _name(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


class _Fresh:
    """True for a name that is not among the latest KNOWN_SETS."""

    def __init__(self):
        self.seen = set()

    def __call__(self, name: bytes) -> bool:
        if name in self.seen:
            return False
        if len(self.seen) >= KNOWN_SETS:
            self.seen.clear()
        self.seen.add(name)
        return True


def _listed(docs: DataFrame) -> DataFrame:
    """(doc_id, name, size, text_hash, band, own, next): `own` and `next` are the keys of the set in its band and the next.

    They are null for a set that the task has listed already, and where there is none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "name", "size", "text_hash", "band", "own", "next"]

    def run(batches):
        bands, fresh = Bands(), _Fresh()
        for batch in batches:
            out = {n: [] for n in names[1:]}
            for text in batch.column("text"):
                text = text.as_py() or b""
                own = shingles(text, WIDTH)
                name = _name(own)
                keys, band = [None, None], None
                if len(own):
                    band = bands.of(len(own))
                    if fresh(name):
                        for i, b in enumerate(bands.listed_in(len(own))):
                            keys[i] = segment_keys(own, b, bands.segments(b))
                for n, v in zip(names[1:], (name, len(own), _hash(text), band, *keys)):
                    out[n].append(v)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [batch.column("doc_id")] + [pa.array(out[n], t) for n, t in zip(names[1:], types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    shape = f"doc_id {kind}, name binary, size long, text_hash long, band int, own array<long>, next array<long>"
    return texts.mapInArrow(run, shape)


def _exploded(listed: DataFrame) -> DataFrame:
    """(node, size, band, segment, key)"""
    own = listed.select("node", "size", "band", F.posexplode("own").alias("segment", "key"))
    beyond = listed.filter(F.col("next").isNotNull()).select("node", "size", (F.col("band") + 1).alias("band"), F.posexplode("next").alias("segment", "key"))
    return own.union(beyond)


def _met(listed: DataFrame, shared: DataFrame, size: int = BITMAP_BITS) -> DataFrame:
    """The rows of `_exploded` whose key is one of `shared` (key, n), with n and `surplus`.

    A bitmap of the shared keys passes over most of the others before anything is shuffled; the join decides.
    """
    bits = listed.sparkSession.sparkContext.broadcast(_bitmap(shared.select("key"), size))
    kinds = {"node": pa.int64(), "size": pa.int64(), "band": pa.int32(), "segment": pa.int32(), "key": pa.int64(), "surplus": pa.int64()}
    bands = Bands()

    def run(batches):
        bitmap = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for column, beyond in (("own", 0), ("next", 1)):
                lists = batch.column(column)
                keys, lengths = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
                segment = np.arange(len(keys)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                at = keys & (size - 1)
                hit = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1))
                row = np.repeat(np.arange(batch.num_rows), lengths)[hit]
                node, own, band = (batch.column(c).to_numpy()[row] for c in ("node", "size", "band"))
                pairs, which = np.unique(np.stack((own, band + beyond)), axis=1, return_inverse=True)
                surplus = np.array([bands.surplus(*p) for p in pairs.T.tolist()], np.int64)[which.ravel()]
                out = zip((node, own, band + beyond, segment[hit], keys[hit], surplus), kinds.values())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in out], names=list(kinds))

    found = listed.select("node", "size", "band", "own", "next").mapInArrow(run, "node long, size long, band int, segment int, key long, surplus long")
    return found.join(shared, "key")


def _rarest(met: DataFrame) -> DataFrame:
    """Of the keys that a set shares with others in a band, all but the `surplus` most frequent.

    Similar sets share surplus + 1 keys at least. In one order of all keys, by frequency, they therefore share one that is
    not among the last `surplus` keys of either; keys that are a set's own are the first in that order.
    """
    own = W.partitionBy("node", "band")
    ranked = met.withColumn("rank", F.row_number().over(own.orderBy("n", "key"))).withColumn("k", F.count("*").over(own))
    return ranked.filter(F.col("rank") <= F.col("k") - F.col("surplus"))


def _allocated(rows: DataFrame, met: DataFrame, price: float) -> DataFrame:
    """(band, segment, share) where the share is not one."""
    listed_in = F.when(F.col("next").isNull(), F.array("band")).otherwise(F.array("band", F.col("band") + 1))
    peers = rows.select(F.explode(listed_in).alias("band")).groupBy("band").agg(F.count("*").alias("peers"))
    buckets = met.groupBy("band", "segment", "key").agg(F.count("*").alias("n"))
    stats = buckets.groupBy("band", "segment").agg(F.sum(F.col("n") - 1).alias("excess")).join(peers, "band")

    def move(rows):
        bands, band = Bands(), int(rows["band"].iloc[0])
        excess = np.zeros(bands.segments(band), np.int64)
        excess[rows["segment"].to_numpy()] = rows["excess"].to_numpy()
        share = shares(excess, int(rows["peers"].iloc[0]), bands.top(band), price)
        at = np.flatnonzero(share != 1)
        return pd.DataFrame({"band": band, "segment": at, "share": share[at]})

    return stats.groupBy("band").applyInPandas(move, "band int, segment int, share long")


def _bitmap(hashes: DataFrame, size: int) -> bytes:
    """`size` bits (a power of two), set at each of the one column of `hashes`; at most size / 8 bytes come to the driver."""
    bit = F.pmod(hashes.columns[0], F.lit(size))
    words = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    out = np.zeros(size // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("at").to_numpy()] = batch.column("word").to_numpy()
    return out.tobytes()


def _sets(docs: DataFrame, wanted: DataFrame, size: int = BITMAP_BITS) -> DataFrame:
    """(node, own): the tokens of each of `wanted` (node, name, text_hash). Only texts in a bitmap of these are read."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("text_hash"), size))

    def run(batches):
        bits, fresh = np.frombuffer(shared.value, np.uint8), _Fresh()
        for batch in batches:
            names, found = [], []
            for text in batch.column("text"):
                text = text.as_py() or b""
                at = _hash(text) % size
                if bits[at >> 3] >> (at & 7) & 1:
                    own = shingles(text, WIDTH)
                    if fresh(name := _name(own)):
                        names.append(name)
                        found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["name", "own"])

    texts = docs.select(F.col("text").cast("string").cast("binary").alias("text"))
    read = texts.mapInArrow(run, "name binary, own array<long>").join(wanted.select("name", "node"), "name")
    return read.dropDuplicates(["node"]).select("node", "own")


def _deletions(sets: DataFrame, raised: DataFrame) -> DataFrame:
    """(node, size, key): the subsets less one token in the segments of `raised` (band, segments)."""

    def run(batches):
        bands = Bands()
        for batch in batches:
            for node, own, band, at in zip(batch.column("node"), batch.column("own"), batch.column("band").to_pylist(), batch.column("segments")):
                tokens = np.asarray(own.values).view(np.uint64)
                keys = segment_keys(np.sort(tokens), band, bands.segments(band), np.asarray(at.values))
                columns = [pa.array([node.as_py()] * len(keys), pa.int64()), pa.array([len(tokens)] * len(keys), pa.int64()), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "key"])

    return sets.join(raised, "band").select("node", "own", "band", "segments").mapInArrow(run, "node long, size long, key long")


def links_within(nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """Links between similar sets of different `groups`, one of each `side` where there are two; connected as all are."""
    if len(np.unique(groups)) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    token, number, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = np.repeat(np.arange(len(sets)), sizes)
    keep = often[number] > 1
    column = (np.cumsum(often > 1) - 1)[number[keep]]
    order = np.argsort(column, kind="stable")
    held, column = held[keep][order], column[order]
    two = len(np.unique(side)) > 1
    first = np.flatnonzero(side == side[0]) if two else np.arange(len(sets))
    second = np.flatnonzero(side != side[0]) if two else first
    common = np.zeros((len(first), len(second)), np.int64)
    row = np.zeros(len(sets), np.int64)
    row[second] = np.arange(len(second))
    own = np.zeros(len(sets), np.int64)
    own[first] = np.arange(len(first))
    in_first, in_second = np.isin(np.arange(len(sets)), first), np.isin(np.arange(len(sets)), second)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS_AT_ONCE)))
        h, c = held[part], column[part] - at
        left = np.zeros((len(first), min(COLUMNS_AT_ONCE, int(c.max()) + 1)), np.float32)
        left[own[h[in_first[h]]], c[in_first[h]]] = 1
        right = left
        if two:
            right = np.zeros((len(second), left.shape[1]), np.float32)
            right[row[h[in_second[h]]], c[in_second[h]]] = 1
        common += (left @ right.T).astype(np.int64)
    near = similar(common, sizes[first][:, None], sizes[second][None, :]) & (groups[first][:, None] != groups[second][None, :])
    root, links = np.unique(groups, return_inverse=True)[1], []
    for i in np.flatnonzero(near.any(1)).tolist():
        for j in np.flatnonzero(near[i]).tolist():
            a, b = first[i], second[j]
            if root[a] != root[b]:
                links.append((int(nodes[a]), int(nodes[b])))
                root[root == root[b]] = root[a]
    return links


def _small_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the pairs of `members` (key, node, size, component) of different components, in buckets of few members."""
    mine = members.select("key", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_component"))
    met = mine.join(members, "key").filter((F.col("a") < F.col("node")) & (F.col("a_component") != F.col("component")))
    return met.filter(_fits(F.col("a_size"), F.col("size"))).select("a", F.col("node").alias("b")).distinct()


def _across(members: DataFrame, sets: DataFrame, most: int, tokens: int) -> DataFrame:
    """(a, b): links inside the buckets of `members` (key, node, size, component) between different components.

    A bucket of more than `most` members or `tokens` tokens is cut into portions, and each two of them are a group.
    """
    spans = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    portions = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("tokens") / tokens)).cast("long")
    open_keys = spans.select("key", portions.alias("portions"))
    spread = (
        members.join(open_keys, "key")
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("portions")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
        .join(sets, "node")
        .select("key", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"), "mine", "node", "component", "own")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, component, mine = (group.column(c).to_numpy() for c in ("node", "component", "mine"))
        cross = group.column("first")[0] != group.column("second")[0]
        links = links_within(node, component, [np.asarray(s.values) for s in group.column("own")], mine if cross else np.zeros(len(node)))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return spread.groupBy("key", "first", "second").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The similar ones of `pairs` (a, b). The hub's set comes last: its rows are wide by then and can be split."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("right")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("own").alias("left")), "a"
    )
    common = F.size(F.array_intersect("left", "right"))
    return both.filter(similar(common, F.size("left"), F.size("right"))).select("a", "b")


def _fits(a: Column, b: Column) -> Column:
    return OF * F.least(a, b) >= LEAST * F.greatest(a, b)


def joined(docs: DataFrame, price: float = DELETION_PRICE, small: int = SMALL, most: int = MEMBERS, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text).

    Rows whose sets of WIDTH-word shingles have a Jaccard similarity of LEAST / OF or more are linked; component_id is
    the smallest doc_id that links reach. Equal sets are linked, so repeated rows and copies share a component; an empty
    set (null or wordless text) is linked with nothing and has its own doc_id. A null doc_id takes part, and is the
    component only where no row of it has an id. An empty table gives an empty result; other columns are ignored.
    """
    listed = materialize(_listed(docs).withColumn("row", F.monotonically_increasing_id()), "listed_sets")
    nodes = (
        listed.filter("size > 0")
        .groupBy("name")
        .agg(F.min(F.when(F.col("own").isNotNull(), F.col("row"))).alias("node"), F.min("doc_id").alias("first_id"))
    )
    nodes = materialize(nodes, "set_nodes")
    rows = listed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    keys = rows.select(F.explode("own").alias("key")).union(rows.select(F.explode("next").alias("key")))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared_keys")
    met = materialize(_met(rows, shared), "met_sets")
    allocated = materialize(_allocated(rows, met, price), "set_shares")
    raised = allocated.filter("share = 2")
    moved = met.join(allocated.select("band").distinct(), "band", "left_semi").join(allocated, ["band", "segment"], "left_anti")
    buckets = _rarest(met.join(allocated.select("band"), "band", "left_anti")).select("key", "node", "size", "n").union(
        moved.select("key", "node", "size", "n"))
    named = rows.select("node", "name", "text_hash")
    if not raised.isEmpty():
        # where deletions are listed, a set that is alone with its subset may still meet those of others
        every = _exploded(rows).join(raised, ["band", "segment"], "left_semi").select("key", "node", "size", F.lit(True).alias("whole"))
        bands = raised.groupBy("band").agg(F.collect_list("segment").alias("segments"))
        in_raised = _exploded(rows).filter("segment = 0").select("node", "band").join(bands.select("band"), "band", "left_semi").distinct()
        sets_there = _sets(docs, named.join(in_raised.select("node").distinct(), "node", "left_semi")).join(in_raised, "node")
        deleted = _deletions(sets_there, bands).select("key", "node", "size", F.lit(False).alias("whole")).distinct()
        listed_there = materialize(every.union(deleted), "deletions")
        meet = listed_there.groupBy("key").agg(F.count("*").alias("n"), F.max("whole").alias("whole")).filter("n > 1 and whole").select("key", "n")
        buckets = buckets.union(listed_there.join(meet, "key").select("key", "node", "size", "n"))
    buckets = materialize(buckets, "set_buckets")
    support = buckets.groupBy("node").agg(F.sum("n").alias("support"))
    hubs = buckets.join(support, "node").groupBy("key").agg(F.max(F.struct("support", "node", "size")).alias("hub"))
    hubs = materialize(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size")), "set_hubs")
    sets = materialize(_sets(docs, named.join(support, "node", "left_semi")), "sets")
    pairs = buckets.join(hubs, "key").filter((F.col("node") != F.col("hub")) & _fits(F.col("size"), F.col("hub_size")))
    verified = materialize(_verified(pairs.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets), "similar_sets")
    rest = buckets.select("key", "node", "size").join(hubs.select("key", "hub"), "key").filter("node <> hub")  # the hub has met all
    rest = rest.join(components(verified), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    rest = materialize(rest, "set_members")
    spans = rest.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    still = rest.join(spans.filter("low <> high").select("key", "n"), "key")
    few = _verified(_small_pairs(still.filter(F.col("n") <= small).drop("n")), sets)
    found = components(verified.union(few).union(_across(still.filter(F.col("n") > small).drop("n"), sets, most, tokens)))
    heads = nodes.join(found, "node", "left").select("name", "first_id", F.coalesce("component", "node").alias("component"))
    least = heads.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = heads.join(least, "component").select("name", "component_id")
    named_rows = listed.select("doc_id", "name", F.col("size").alias("n_shingles")).join(ids, "name", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return named_rows.select("doc_id", "n_shingles", own.alias("component_id"))
