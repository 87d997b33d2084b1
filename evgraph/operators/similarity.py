"""Neighbours of a work: shared citations, method lineage, embedding cosine, and their blends.

Nothing here enumerates the pairs of a popular group. References cited by more than
`heavy_df` works are handled through citation profiles, lineage search forwards only the
best k per work and hop, and vectors are compared block by block with exact pruning.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.functions import scores as sf
from evgraph.operators.tables import crowded, dealt_out, in_every_part, in_parts, in_rounds, top_k
from evgraph.session import discard, materialize

K = 32
HEAVY_DF = 512
HUB_PART = 4096  # edges or links of one work that a task extends at a time
ROWS_A_ROUND, MOST_ROUNDS = 16_000_000, 16  # links whose works meet at a time
SKETCH_REFS = 256  # works with more references have no sketch: nothing of theirs is passed over


def _best() -> list[Column]:
    return [F.desc("score"), F.asc("neighbor_work_id")]


# --- shared references and shared citers -------------------------------------------------


def shared_link_neighbors(
    links: DataFrame, k: int = K, heavy_df: int = HEAVY_DF, seeds: DataFrame | None = None
) -> DataFrame:
    """Top k works by links in common: score = sum m_a*m_b / sqrt(n_a*n_b), ties by id.

    `links`: (entity, ref), repeats count. With `seeds` (work_id) only those works get a list.
    """
    incidence = links.where("entity IS NOT NULL AND ref IS NOT NULL").groupBy("entity", "ref").agg(
        F.count("*").alias("m")
    )
    spread = incidence.groupBy("ref").agg(F.count("*").alias("df")).where("df > 1")
    sizes = incidence.groupBy("entity").agg(F.sum("m").alias("n"))
    # A reference with one citer joins no pair; it only counts in n.
    # staged: read by the floors, both sides of the pair join and the profiles
    weighted = materialize(incidence.join(spread, "ref").join(sizes, "entity"), "links")
    rounds = min(MOST_ROUNDS, 1 + weighted.count() // ROWS_A_ROUND)
    traits = known = materialize(_traits(weighted, heavy_df, k, seeds, rounds), "link_traits")
    light = weighted.where(F.col("df") <= heavy_df)
    if weighted.where(F.col("df") > heavy_df).isEmpty():
        met = _light_pairs(light, traits, seeds, rounds)
        best = in_rounds(met, "work_id", rounds, "best_pairs", lambda some, _: _rank_in_parts(_above_floor(_summed(some)), k))
        discard(met, known, weighted)
        return _best_of_parts(best, k)

    profiles, profile_pairs = _profiles(weighted.where(F.col("df") > heavy_df))
    profiles, profile_pairs = materialize(profiles, "link_profiles"), materialize(profile_pairs, "profile_pairs")
    traits = traits.join(profiles.select("entity", "profile"), "entity", "left")
    extra = profile_pairs.withColumnRenamed("dot", "heavy_dot")
    met = _light_pairs(light, traits, seeds, rounds, ["profile"])
    only_heavy = materialize(_profile_candidates(profiles, profile_pairs, k, seeds), "heavy_pairs")

    def ranked(some: DataFrame, turn) -> DataFrame:
        pairs = _summed(some).join(extra, ["profile_a", "profile_b"], "left").withColumn("dot", F.col("dot") + F.coalesce("heavy_dot", F.lit(0)))
        both = _above_floor(pairs).select(*only_heavy.columns).unionByName(turn(only_heavy, "work_id"))
        return _rank_pairs(both.groupBy("work_id", "neighbor_work_id", "n_a", "n_b").agg(F.max("dot").alias("dot")), k)

    best = in_rounds(met, "work_id", rounds, "best_pairs", ranked)
    discard(met, known, weighted)
    return best


def _strength() -> Column:
    """Square of the score. One division: equal rational scores give equal doubles, so ties are real ties."""
    return F.col("dot") * F.col("dot") / (F.col("n_a") * F.col("n_b"))


def _score_floors(light: DataFrame, k: int, seeds: DataFrame | None, rounds: int, probe: int = 4) -> DataFrame:
    """(entity, floor): k other works certainly reach this squared score, so weaker pairs need no ranking.

    Found among the `probe` strongest citers of each reference; works with too few of them have no floor.
    """
    head = top_k(light, ["ref"], [F.desc(F.col("m") * F.col("m") / F.col("n")), F.asc("entity")], probe)
    strong = head.select("ref", F.col("entity").alias("neighbor_work_id"), F.col("m").alias("m_b"), F.col("n").alias("n_b"))
    strong = materialize(strong, "strong_citers")
    mine = light.select("ref", F.col("entity").alias("work_id"), F.col("m").alias("m_a"), F.col("n").alias("n_a"))
    if seeds is not None:
        mine = mine.join(seeds.select("work_id").distinct(), "work_id", "left_semi")

    def reached(some: DataFrame, _) -> DataFrame:
        met = (
            dealt_out(some, "ref").join(strong.hint("merge"), "ref").where("work_id <> neighbor_work_id")
            .withColumn("dot", F.col("m_a") * F.col("m_b"))
            .select("work_id", "neighbor_work_id", _strength().alias("score"))
        )
        # dealt by work alone: pairs are merged and ranked where they arrive
        best = dealt_out(met, "work_id").groupBy("work_id", "neighbor_work_id").agg(F.max("score").alias("score"))
        last = top_k(best, ["work_id"], _best(), k, rank="place").where(F.col("place") == k)
        return last.select(F.col("work_id").alias("entity"), F.col("score").alias("floor"))

    return in_rounds(mine, "work_id", rounds, "floors", reached)


def _sketches(weighted: DataFrame) -> DataFrame:
    """(entity, sketch, most): distinct 16-bit hashes of the references, and the most links behind one of the hashes.

    The product of two works is at most the number of hashes in common times both `most`.
    """
    mark = (F.pmod(F.xxhash64("ref"), F.lit(65536)) - 32768).cast("short")
    held = weighted.groupBy("entity").agg(F.collect_set(mark).alias("_marks"), F.count("*").alias("_refs"), F.max("m").alias("_most"))
    short = F.when(F.col("_refs") <= SKETCH_REFS, F.col("_marks"))
    return held.select("entity", short.alias("sketch"), (F.col("_most") * (1 + F.col("_refs") - F.size("_marks"))).alias("most"))


def _traits(weighted: DataFrame, heavy_df: int, k: int, seeds: DataFrame | None, rounds: int) -> DataFrame:
    """(entity, floor, sketch, most): what tells whether a pair of works can rank, a row per work."""
    light = weighted.where(F.col("df") <= heavy_df)
    return _sketches(weighted).join(_score_floors(light, k, seeds, rounds), "entity", "left")


def _above_floor(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("floor_a").isNull() | (_strength() >= F.col("floor_a")))


PAIRS_AT_ONCE = 1 << 19  # pairs that a task looks at together; those of one reference stay together
MARKS_AT_ONCE = 8192


def _light_pairs(weighted: DataFrame, traits: DataFrame, seeds: DataFrame | None, rounds: int, carry: list[str] = ()) -> DataFrame:
    """Directed pairs that share a reference of bounded popularity and may reach the floor of `work_id`, with the product of
    their links, a row per shared reference. A table."""
    asking = seeds.select(F.col("work_id").alias("entity"), F.lit(True).alias("asks")).distinct() if seeds is not None else None
    traits = traits.withColumn("asks", F.lit(True)) if seeds is None else traits.join(asking, "entity", "left")
    kinds = dict(weighted.dtypes) | dict(traits.dtypes)
    ends = {"work_id": kinds["entity"], "neighbor_work_id": kinds["entity"], "n_a": "long", "n_b": "long", "floor_a": "double"}
    ends |= {f"{c}_{s}": kinds[c] for c in carry for s in "ab"} | {"dot": "long"}
    schema = ", ".join(f"{name} {kind}" for name, kind in ends.items())

    def met(some: DataFrame, _) -> DataFrame:
        rows = some.join(traits, "entity").select("ref", "entity", "n", "m", "sketch", "most", "floor", "asks", *carry)
        # sorted by reference, the works of one lie side by side: nothing is joined, and no pair is made that can't rank
        return dealt_out(rows, "ref").sortWithinPartitions("ref").mapInArrow(lambda batches: _meetings(batches, carry), schema)

    return in_rounds(weighted, "ref", rounds, "met", met)


def _meetings(batches, carry):
    """The pairs of every reference, whose rows come side by side."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        starts = _group_starts(rows["ref"])
        done = int(starts[-1])
        if done:
            yield from _pairs_of_groups(rows.slice(0, done), starts[:-1], carry)
        held = rows.slice(done)
    if held is not None and len(held):
        yield from _pairs_of_groups(held, np.zeros(1, np.int64), carry)


def _group_starts(keys: pa.ChunkedArray) -> np.ndarray:
    if not len(keys):
        return np.zeros(1, np.int64)
    keys = keys.combine_chunks()
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _pairs_of_groups(rows: pa.Table, starts: np.ndarray, carry):
    sizes = np.diff(np.append(starts, len(rows)))
    used = lo = 0
    for g, size in enumerate(sizes):
        if used and used + size * size > PAIRS_AT_ONCE:
            yield _able_pairs(rows.slice(starts[lo], starts[g] - starts[lo]), sizes[lo:g], carry)
            used, lo = 0, g
        used += size * size
    yield _able_pairs(rows.slice(starts[lo]), sizes[lo:], carry)


def _able_pairs(rows: pa.Table, sizes: np.ndarray, carry) -> pa.RecordBatch:
    """Pairs inside each group of `sizes` rows that can reach the floor of their first work.

    The product of two works is at most the number of hashes in common times both `most`; without a sketch nothing is known.
    """
    cells = {c: rows[c].combine_chunks() for c in rows.column_names}
    n, m, most = (cells[c].to_numpy(zero_copy_only=False) for c in ("n", "m", "most"))
    floor = cells["floor"].cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    asks = np.flatnonzero(cells["asks"].fill_null(False).to_numpy(zero_copy_only=False))
    group = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    times = sizes[group[asks]]
    i = np.repeat(asks, times)
    j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + first[group[i]]
    unknown = cells["sketch"].is_null().to_numpy(zero_copy_only=False)
    top = _common_marks(cells["sketch"], unknown, group, sizes, first, asks, i) * most[i] * most[j]
    # a little more, for products that a double can't hold
    able = unknown[i] | unknown[j] | (top * top / (n[i].astype(float) * n[j]) * (1 + 1e-12) >= floor[i])
    able &= i != j
    i, j = pa.array(i[able]), pa.array(j[able])
    out = {"work_id": cells["entity"].take(i), "neighbor_work_id": cells["entity"].take(j), "n_a": cells["n"].take(i), "n_b": cells["n"].take(j),
           "floor_a": cells["floor"].take(i)}
    out |= {f"{c}_{s}": cells[c].take(x) for c in carry for s, x in (("a", i), ("b", j))}
    return pa.RecordBatch.from_pydict(out | {"dot": pa.array(m[i.to_numpy()] * m[j.to_numpy()])})


def _common_marks(sketches, unknown, group, sizes, first, asks, i) -> np.ndarray:
    """How many hashes the two works of every pair have in common; `i` is the first work of each, all partners of one in a row."""
    known = np.flatnonzero(~unknown)
    row = np.repeat(known, pc.list_value_length(sketches).drop_null().to_numpy(zero_copy_only=False))
    key = group[row] * 65536 + pc.list_flatten(sketches).to_numpy(zero_copy_only=False).astype(np.int64) + 32768
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(key)))
    of = group[row[begin]] if len(begin) else np.zeros(0, np.int64)
    # hashes that all works of the group have, as that of the reference itself, are counted once for all pairs
    whole = length == np.bincount(group[known], minlength=len(sizes))[of]
    common = np.bincount(of[whole], minlength=len(sizes)).astype(float)[group[i]]
    some = np.flatnonzero((length > 1) & ~whole)
    if not len(some):
        return common
    pairs_before = np.concatenate(([0], np.cumsum(sizes[group[asks]])))  # of each asking work
    cut = np.flatnonzero(np.diff(of[some])) + 1
    for marks in np.split(some, cut):
        g = of[marks[0]]
        lo, hi = np.searchsorted(asks, [first[g], first[g] + sizes[g]])
        if lo == hi:
            continue
        found = np.zeros((hi - lo, sizes[g]), np.float32)
        for at in range(0, len(marks), MARKS_AT_ONCE):
            part = marks[at : at + MARKS_AT_ONCE]
            held = np.zeros((sizes[g], len(part)), np.float32)
            entries = np.repeat(begin[part], length[part]) + _counted_within(length[part])
            held[row[entries] - first[g], np.repeat(np.arange(len(part)), length[part])] = 1
            found += held[asks[lo:hi] - first[g]] @ held.T
        common[pairs_before[lo] : pairs_before[hi]] += found.ravel()
    return common


def _counted_within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _summed(met: DataFrame) -> DataFrame:
    """The pairs with the sum of their products. The pairs of a work are dealt by the work, those of one with many links into parts."""
    keys = [c for c in met.columns if c != "dot"]
    part = F.pmod(F.xxhash64("neighbor_work_id"), F.ceil(F.col("n_a") / HUB_PART).cast("long")).alias("part")
    return dealt_out(met.select("*", part), "work_id", "part").groupBy("part", *keys).agg(F.sum("dot").alias("dot"))


def _profiles(heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works with equal links to popular references share a profile.

    Returns (entity, profile, n) and the products of every two profiles that meet. A profile is
    named by an order-free fingerprint of its links, so no link list is gathered.
    """
    link = F.xxhash64("ref", "m")
    profiles = (
        heavy.groupBy("entity")
        .agg(
            F.max("n").alias("n"),
            F.sha2(
                F.concat_ws(
                    ":",
                    F.count("*"), F.sum("m"), F.bit_xor(link), F.sum(link.bitwiseAND(F.lit(0xFFFFFFFF))),
                    F.bit_xor(F.xxhash64("m", "ref", F.lit(1))),
                ), 256,
            ).alias("profile"),
        )
    )
    owner = profiles.groupBy("profile").agg(F.min("entity").alias("entity"))
    content = heavy.select("entity", "ref", "m").join(owner, "entity").select("profile", "ref", "m")
    side = lambda s: content.select("ref", F.col("profile").alias(f"profile_{s}"), F.col("m").alias(f"m_{s}"))
    pairs = (
        side("a").join(side("b"), "ref").groupBy("profile_a", "profile_b")
        .agg(F.sum(F.col("m_a") * F.col("m_b")).alias("dot"))
    )
    return profiles, pairs


def _profile_candidates(profiles: DataFrame, pairs: DataFrame, k: int, seeds: DataFrame | None) -> DataFrame:
    """Best partners through popular references alone.

    Inside one profile the order of partners (smallest n, then id) is the same for every work, so
    k + 1 members per profile and k + 1 partners per profile are enough for an exact top k.
    """
    head = top_k(profiles, ["profile"], [F.asc("n"), F.asc("entity")], k + 1)
    members = head.select(F.col("profile").alias("profile_b"), F.col("entity").alias("neighbor_work_id"), F.col("n").alias("n_b"))
    ratio = F.desc(F.col("dot") * F.col("dot") / F.col("n_b"))
    partners = top_k(pairs.join(members, "profile_b"), ["profile_a"], [ratio, F.asc("neighbor_work_id")], k + 1)
    works = profiles.select(
        F.col("profile").alias("profile_a"), F.col("entity").alias("work_id"), F.col("n").alias("n_a"))
    if seeds is not None:
        works = works.join(seeds.select("work_id").distinct(), "work_id", "left_semi")
    return (
        works.join(partners, "profile_a").where("work_id <> neighbor_work_id")
        .select("work_id", "neighbor_work_id", "n_a", "n_b", "dot")
    )


def _rank_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(pairs.select("work_id", "neighbor_work_id", F.sqrt(_strength()).alias("score")), ["work_id"], _best(), k)


def _rank_in_parts(pairs: DataFrame, k: int) -> DataFrame:
    """The best k of every work and part, ranked where they are."""
    scored = pairs.select("work_id", "part", "neighbor_work_id", F.sqrt(_strength()).alias("score"), (F.col("n_a") > HUB_PART).alias("in_parts"))
    return top_k(scored, ["work_id", "part"], _best(), k)


def _best_of_parts(ranked: DataFrame, k: int) -> DataFrame:
    columns = ["work_id", "neighbor_work_id", "score"]
    again = top_k(ranked.where("in_parts"), ["work_id"], _best(), k)
    return ranked.where("NOT in_parts").select(columns).unionByName(again.select(columns))


def bibliographic_coupling(citations: DataFrame, k: int = K, heavy_df: int = HEAVY_DF, seeds=None) -> DataFrame:
    """Works that cite the same works."""
    links = citations.select(F.col("citing_work_id").alias("entity"), F.col("cited_work_id").alias("ref"))
    return shared_link_neighbors(links, k, heavy_df, seeds)


def co_citation(citations: DataFrame, k: int = K, heavy_df: int = HEAVY_DF, seeds=None) -> DataFrame:
    """Works cited by the same works."""
    links = citations.select(F.col("cited_work_id").alias("entity"), F.col("citing_work_id").alias("ref"))
    return shared_link_neighbors(links, k, heavy_df, seeds)


def strongest(*directed: DataFrame) -> DataFrame:
    """Union of neighbour lists, one row per pair with the highest score."""
    out = directed[0]
    for more in directed[1:]:
        out = out.unionByName(more)
    # dealt by work alone, as a list is short: rows are merged, and may be ranked, where they arrive
    return dealt_out(out, "work_id").groupBy("work_id", "neighbor_work_id").agg(F.max("score").alias("score"))


def symmetric(directed: DataFrame) -> DataFrame:
    """Both directions of every pair, highest score kept."""
    both = directed.select(
        F.inline(
            F.array(
                F.struct("work_id", "neighbor_work_id", "score"),
                F.struct(F.col("neighbor_work_id").alias("work_id"), F.col("work_id").alias("neighbor_work_id"), "score"),
            )
        )
    )
    return both.groupBy("work_id", "neighbor_work_id").agg(F.max("score").alias("score"))


def trim(directed: DataFrame, k: int = K) -> DataFrame:
    return top_k(directed, ["work_id"], _best(), k)


def citation_neighbors(citations: DataFrame, k: int = K, heavy_df: int = HEAVY_DF, seeds=None) -> DataFrame:
    """Citation dimension: better of coupling and co-citation, top k, made symmetric, trimmed to k."""
    both = strongest(
        bibliographic_coupling(citations, k, heavy_df, seeds), co_citation(citations, k, heavy_df, seeds)
    )
    return trim(symmetric(materialize(trim(both, k), "citation_lists")), k)


# --- method lineage ----------------------------------------------------------------------


def lineage_edges(relations: DataFrame, members: DataFrame) -> DataFrame:
    """Undirected (work_id, neighbor_work_id, length) between anchored works of method relations."""
    usable = relations.where(tx.is_method_lineage(F.col("type")) & (F.col("review_status") != "rejected"))
    end = lambda role, name: members.where((F.col("role") == role) & F.col("anchor_work_id").isNotNull()).select(
        "relation_id", F.col("anchor_work_id").alias(name))
    directed = (
        usable.select("relation_id", F.when(F.col("review_status") == "confirmed", 1).otherwise(2).alias("length"))
        .join(end("source", "work_id"), "relation_id")
        .join(end("target", "neighbor_work_id"), "relation_id")
        .where("work_id <> neighbor_work_id")
    )
    there = F.struct("work_id", "neighbor_work_id", "length")
    back = F.struct(F.col("neighbor_work_id").alias("work_id"), F.col("work_id").alias("neighbor_work_id"), "length")
    return (
        directed.select(F.inline(F.array(there, back)))
        .groupBy("work_id", "neighbor_work_id")
        .agg(F.min("length").alias("length"))
    )


def lineage_neighbors(
    edges: DataFrame, k: int = K, hops: int = 4, seeds: DataFrame | None = None, hub_part: int = HUB_PART
) -> DataFrame:
    """k nearest works over at most `hops` edges: score = 1 / max(distance, 1).

    Round h extends the lists of round h-1 by one edge and keeps k per work. That is exact: when x
    is the first step from a towards b, anything x ranks before b is also at least as near to a.
    Only entries that round h-1 brought or shortened are extended, since the others were in the round before, and
    only what comes before the last of a full list is shuffled. A round therefore moves at most k rows per edge,
    whatever the degree of a hub. The edges that lead to a hub are dealt into parts of about `hub_part`, each with
    a copy of the hub's list, so that no task extends them all.
    """
    near = [F.asc("length"), F.asc("neighbor_work_id")]
    edges = materialize(edges, "lineage")
    hubs = materialize(crowded(edges, "work_id", hub_part).withColumnRenamed("work_id", "via"), "lineage_hubs")
    need = _needed_by_hop(edges, hops, seeds)
    scoped = lambda df, h: df if need is None else df.join(need[h], "work_id", "left_semi")
    first = scoped(edges, 1).groupBy("work_id", "neighbor_work_id").agg(F.min("length").alias("length"))
    lists = top_k(first, ["work_id"], near, k).withColumn("fresh", F.lit(True))
    for hop in range(2, hops + 1):
        lists = materialize(lists, "lineage_lists")
        onward = lists.where("fresh").select(
            F.col("work_id").alias("via"), F.col("neighbor_work_id").alias("_end"), F.col("length").alias("_rest"))
        place = F.struct("length", "neighbor_work_id")
        full = lists.groupBy("work_id").agg(F.count("*").alias("_n"), F.max(place).alias("_last")).where(F.col("_n") >= k)
        step = scoped(edges, hop).join(full.select("work_id", "_last"), "work_id", "left")
        inward = in_parts(step.withColumnRenamed("neighbor_work_id", "via"), "via", hubs, "work_id")
        walked = (
            dealt_out(inward, "via", "part")
            .join(in_every_part(onward, "via", hubs).hint("merge"), ["via", "part"])
            .where("_end <> work_id")
            .select("work_id", F.col("_end").alias("neighbor_work_id"), (F.col("length") + F.col("_rest")).alias("length"), "_last")
            .where(F.col("_last").isNull() | (place < F.col("_last"))).drop("_last")
        )
        held = scoped(lists, hop).select("work_id", "neighbor_work_id", "length", F.col("length").alias("_held"))
        # dealt by work alone: walks are merged and ranked where they arrive
        found = dealt_out(walked.withColumn("_held", F.lit(None).cast("int")).unionByName(held), "work_id")
        shortest = found.groupBy("work_id", "neighbor_work_id").agg(F.min("length").alias("length"), F.min("_held").alias("_held"))
        fresh = F.col("_held").isNull() | (F.col("length") < F.col("_held"))
        lists = top_k(shortest, ["work_id"], near, k).withColumn("fresh", fresh).drop("_held")
    return lists.select("work_id", "neighbor_work_id", (F.lit(1.0) / F.greatest("length", F.lit(1))).alias("score"))


def within_steps(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(work_id) of the works that are at most `steps` edges (work_id, neighbor_work_id) away from `starts`."""
    edges = materialize(edges, "steps")
    reached = frontier = materialize(starts.select("work_id").distinct(), "reached")
    for _ in range(steps):
        onward = edges.join(frontier, "work_id", "left_semi").select(F.col("neighbor_work_id").alias("work_id")).distinct()
        frontier = materialize(onward.join(reached, "work_id", "left_anti"), "reached")
        reached = reached.union(frontier)
    return reached


def _needed_by_hop(edges: DataFrame, hops: int, seeds: DataFrame | None):
    """Works whose list of length h is read on the way to the seeds' lists of length `hops`: they and their neighbours."""
    if seeds is None:
        return None
    need = {hops: materialize(seeds.select("work_id").distinct(), "needed")}
    for h in range(hops - 1, 0, -1):
        reached = edges.join(need[h + 1], "work_id", "left_semi").select(F.col("neighbor_work_id").alias("work_id"))
        need[h] = materialize(reached.union(need[h + 1]).distinct(), "needed")
    return need


# --- embeddings --------------------------------------------------------------------------

BLOCK_ROWS = 8192
MAX_PIVOTS = 128
SLICE = 1024  # queries compared with a block at a time
VISITS_AT_ONCE = 16_384  # rows of one frame of visits
_SLACK = 1e-9


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosine_neighbors(
    embeddings: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """Exact directed top k by cosine inside each field: (field, work_id, neighbor_work_id, score).

    `embeddings`: entity_id, field, vec. Equal vectors are compared once. The distinct ones are cut
    into blocks around at most `max_pivots` pivots per field; a vector visits another block only if
    the block's angle bound can still beat the vector's k-th best score so far.
    """
    usable = embeddings.where(F.exists("vec", lambda x: x != 0)).select("field", "entity_id", "vec")
    half = lambda c: F.lpad(F.hex(F.xxhash64(c)), 16, "0")
    keyed = usable.withColumn("twin", F.concat(half("vec"), half(F.reverse("vec"))))
    distinct = keyed.groupBy("field", "twin").agg(F.min_by("vec", "entity_id").alias("vec"), F.count("*").alias("copies"))
    counts = {r["field"]: r["n"] for r in distinct.groupBy("field").agg(F.count("*").alias("n")).collect()}
    id_type = embeddings.schema["entity_id"].dataType.simpleString()
    if max(counts.values(), default=0) <= block_rows:
        pairs = _one_block_per_field(distinct, k)
    else:
        pairs = _pruned_blocks(distinct, counts, k, block_rows, max_pivots)
    return _expand_twins(keyed, pairs, k, id_type)


def _expand_twins(keyed: DataFrame, pairs: DataFrame, k: int, id_type: str) -> DataFrame:
    """From pairs of distinct vectors (itself included) to pairs of works; k + 1 ids per vector suffice."""
    head = top_k(keyed.select("field", "twin", "entity_id"), ["field", "twin"], [F.asc("entity_id")], k + 1)
    ends = head.select("field", F.col("twin").alias("other_twin"), F.col("entity_id").alias("neighbor_work_id"))
    reachable = top_k(
        pairs.join(ends, ["field", "other_twin"]), ["field", "twin"], _best(), k + 1
    )
    starts = keyed.select("field", "twin", F.col("entity_id").alias("work_id"))
    out = starts.join(reachable, ["field", "twin"]).where("work_id <> neighbor_work_id")
    return top_k(out, ["field", "work_id"], _best(), k).select("field", "work_id", "neighbor_work_id", "score")


_PAIR = "field string, twin string, other_twin string, score double"


def _best_in_slices(field, query_ids, query, data_ids, data, k):
    """Top k + 1 of one block for every query vector, in frames of `SLICE` queries."""
    width = min(k + 1, len(data_ids))
    for lo in range(0, len(query_ids), SLICE):
        sims = query[lo : lo + SLICE] @ data.T
        if width < sims.shape[1]:
            # keep everything level with the last place: ties are settled by id later
            floor = np.partition(sims, sims.shape[1] - width, axis=1)[:, -width]
            rows, cols = np.nonzero(sims >= floor[:, None] - _SLACK)
        else:
            rows, cols = np.nonzero(np.ones_like(sims, dtype=bool))
        yield pd.DataFrame({
            "field": field, "twin": query_ids[lo : lo + SLICE][rows], "other_twin": data_ids[cols],
            "score": sims[rows, cols]})


_BLOCK = ["field", "cluster", "block", "portion"]


def _meet_blocks(batches, k: int):
    """Best partners of every query row in its block. Rows of one block lie side by side, those of the block itself before
    those that ask (`asks`): a task holds one block and one batch of queries, however many there are."""
    at = None
    for pdf in batches:
        for key, part in pdf.groupby(_BLOCK, sort=False):
            if key != at:
                at, held, ids, block = key, [], None, None
            asks = part["asks"].to_numpy(dtype=bool)
            if not asks.all():
                held.append((part["twin"].to_numpy()[~asks], _unit(part["vec"][~asks])))
            if asks.any() and held:
                if block is None:
                    ids, block = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held = [(ids, block)]
                yield from _best_in_slices(key[0], part["twin"].to_numpy()[asks], _unit(part["vec"][asks]), ids, block, k)


def _one_block_per_field(distinct: DataFrame, k: int) -> DataFrame:
    def whole(key, pdf):
        ids, m = pdf["twin"].to_numpy(), _unit(pdf["vec"])
        return pd.concat(_best_in_slices(key[0], ids, m, ids, m, k))

    return distinct.select("field", "twin", "vec").groupBy("field").applyInPandas(whole, _PAIR)


def _pruned_blocks(distinct: DataFrame, counts: dict, k: int, block_rows: int, max_pivots: int) -> DataFrame:
    """Blocks around pivots; sizes on the driver are bounded by fields x max_pivots."""
    sampled = top_k(distinct.select("field", "twin", "vec"), ["field"], [F.asc("twin")], max_pivots)
    pivots: dict = {}
    for row in sampled.orderBy("field", "twin").collect():
        wanted = -(-counts[row["field"]] // block_rows)
        if len(pivots.setdefault(row["field"], [])) < wanted:
            pivots[row["field"]].append(row["vec"])
    pivots = {f: _unit(pd.Series(list(v))) for f, v in pivots.items()}

    def assign(batches):
        for pdf in batches:
            for field, part in pdf.groupby("field", sort=False):
                cos = _unit(part["vec"]) @ pivots[field].T
                best = cos.argmax(axis=1)
                yield part.assign(cluster=best.astype(np.int32), closeness=cos[np.arange(len(best)), best])

    placed = distinct.select("field", "twin", "vec").mapInPandas(
        assign, "field string, twin string, vec array<float>, cluster int, closeness double"
    )
    stats = placed.groupBy("field", "cluster").agg(F.count("*").alias("n"), F.min("closeness").alias("reach")).collect()
    # per field: cluster ids, angle from pivot to farthest member, number of blocks
    shape: dict = {}
    for r in stats:
        blocks = -(-r["n"] // block_rows)
        shape.setdefault(r["field"], []).append((r["cluster"], float(np.arccos(np.clip(r["reach"], -1, 1))), blocks))
    shape = {f: tuple(np.array(x) for x in zip(*sorted(v))) for f, v in shape.items()}
    split = {(f, int(c)): int(b) for f, (cs, _, bs) in shape.items() for c, b in zip(cs, bs)}

    def block_of(batches):
        for pdf in batches:
            n = [split[key] for key in zip(pdf["field"], pdf["cluster"])]
            digest = pdf["twin"].str.slice(0, 12).map(lambda t: int(t, 16)).to_numpy()
            yield pdf.assign(block=(digest % np.array(n)).astype(np.int32))[["field", "twin", "vec", "cluster", "block"]]

    columns = "field string, twin string, vec array<float>, cluster int, block int"
    blocks = placed.mapInPandas(block_of, columns)

    def first_bound(key, pdf):
        m = _unit(pdf["vec"])
        bound = np.full(len(m), -2.0)
        if len(m) > k:
            for lo in range(0, len(m), 1024):
                sims = m[lo : lo + 1024] @ m.T
                bound[lo : lo + 1024] = np.partition(sims, len(m) - k - 1, axis=1)[:, -(k + 1)]
        return pdf.assign(bound=bound)

    bounded = blocks.groupBy("field", "cluster", "block").applyInPandas(first_bound, columns + ", bound double")

    def visits(batches):
        for pdf in batches:
            for field, part in pdf.groupby("field", sort=False):
                clusters, radius, n_blocks = shape[field]
                angle = np.arccos(np.clip(_unit(part["vec"]) @ pivots[field][clusters].T, -1, 1))
                ceiling = np.cos(np.maximum(angle - radius - 1e-7, 0.0))
                visited = ceiling >= part["bound"].to_numpy()[:, None] - 1e-7
                twin, vec = part["twin"].to_numpy(), part["vec"].to_numpy()
                step = max(1, VISITS_AT_ONCE // int(n_blocks.sum()))  # a vector may visit every block of its field
                for lo in range(0, len(part), step):
                    rows, cols = np.nonzero(visited[lo : lo + step])
                    times = n_blocks[cols]
                    rows, cols = np.repeat(rows + lo, times), np.repeat(cols, times)
                    starts = np.cumsum(times) - times
                    block = np.arange(len(rows)) - np.repeat(starts, times)
                    yield pd.DataFrame({
                        "field": field, "twin": twin[rows], "vec": vec[rows],
                        "cluster": clusters[cols].astype(np.int32), "block": block.astype(np.int32)})

    # a popular block receives its visitors in several portions, each with a copy of the block
    portions = max(1, max(counts.values()) // (16 * block_rows))
    queries = bounded.mapInPandas(visits, columns).withColumn("portion", F.pmod(F.xxhash64("twin"), F.lit(portions)))
    data = blocks.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(portions - 1).cast("long"))))
    both = data.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    return dealt_out(both, *_BLOCK).sortWithinPartitions(*_BLOCK, "asks").mapInPandas(lambda b: _meet_blocks(b, k), _PAIR)


def aspect_neighbors(embeddings: DataFrame, k: int = K, cleared: DataFrame | None = None, **how) -> DataFrame:
    """Neighbours of every aspect dimension: (dimension, work_id, neighbor_work_id, score), symmetric, k per work.

    `cleared`: (field, work_id) whose aspect text became empty; they keep no list of their own.
    """
    directed = cosine_neighbors(embeddings, k, **how)
    if cleared is not None:
        directed = directed.join(cleared, ["field", "work_id"], "left_anti")
    both = directed.select(
        F.inline(
            F.array(
                F.struct("field", "work_id", "neighbor_work_id", "score"),
                F.struct("field", F.col("neighbor_work_id").alias("work_id"), F.col("work_id").alias("neighbor_work_id"), "score"),
            )
        )
    )
    if cleared is not None:
        both = both.join(cleared, ["field", "work_id"], "left_anti")
    merged = both.groupBy("field", "work_id", "neighbor_work_id").agg(F.max("score").alias("score"))
    dimension = F.concat(F.lit("aspect_"), F.substring_index("field", ":", -1)).alias("dimension")
    return top_k(merged, ["field", "work_id"], _best(), k).select(dimension, "work_id", "neighbor_work_id", "score")


# --- reading neighbour tables (dimension, work_id, neighbor_work_id, score) ------------------------


def blend(neighbors: DataFrame, weights: dict[str, float], topic: bool = False) -> DataFrame:
    """Weighted sum over the graph dimensions, divided by the sum of weights (1 when that is 0)."""
    used = {d: float(weights.get(d, 0.0)) for d in ("citation_coupling", "method_lineage")}
    if topic and weights.get("topic", 0) > 0:
        used["topic"] = float(weights["topic"])
    total = sum(used.values()) or 1.0
    share = F.create_map(*[F.lit(x) for d, w in used.items() for x in (d, w)])[F.col("dimension")]
    return (
        neighbors.where(F.col("dimension").isin(list(used)))
        .groupBy("work_id", "neighbor_work_id")
        .agg(F.sum(F.col("score") * share / total).alias("score"))
    )


def blend_views(neighbors: DataFrame, views: DataFrame) -> DataFrame:
    """The blend of every saved view: `views` has view_id and weights {dimension: double}."""
    w = F.col("weights")
    total = w["citation_coupling"] + w["method_lineage"] + F.greatest(w["topic"], F.lit(0.0))
    shares = views.select(
        "view_id",
        F.explode(F.create_map(
            F.lit("citation_coupling"), w["citation_coupling"], F.lit("method_lineage"), w["method_lineage"],
            F.lit("topic"), F.when(w["topic"] > 0, w["topic"]))).alias("dimension", "weight"),
        F.when(total == 0, 1.0).otherwise(total).alias("total"),
    ).where("weight IS NOT NULL")
    return (
        neighbors.join(shares, "dimension")
        .groupBy("view_id", "work_id", "neighbor_work_id")
        .agg(F.sum(F.col("score") * F.col("weight") / F.col("total")).alias("score"))
    )


def single_dimension(neighbors: DataFrame, dimension: str, k: int = 12, floor: float = 0.28) -> DataFrame:
    """Strongest k neighbours of one dimension above a floor (12 at 0.28 to draw, 6 at 0.4 to lay out)."""
    chosen = neighbors.where((F.col("dimension") == dimension) & (F.col("score") >= floor))
    return top_k(chosen.select("work_id", "neighbor_work_id", "score"), ["work_id"], _best(), k)


def strongest_blended(blended: DataFrame, k: int = 6, floor: float = 0.05) -> DataFrame:
    finite = (F.col("score") >= floor) & ~F.isnan("score") & (F.col("score") < float("inf"))
    usable = blended.where(finite & (F.col("work_id") != F.col("neighbor_work_id")))
    return top_k(usable.select("work_id", "neighbor_work_id", "score"), ["work_id"], _best(), k)


def undirected(directed: DataFrame) -> DataFrame:
    """One row per pair, smaller id first, highest score."""
    return (
        directed.where("work_id <> neighbor_work_id")
        .groupBy(F.least("work_id", "neighbor_work_id").alias("source_id"), F.greatest("work_id", "neighbor_work_id").alias("target_id"))
        .agg(F.max("score").alias("score"))
    )


def layout_springs(directed: DataFrame) -> DataFrame:
    score: Column = F.col("score")
    return undirected(directed.where(~F.isnan("score") & (F.abs("score") < float("inf")))).select(
        "source_id", "target_id", "score", sf.spring_length(score).alias("ideal_length"),
        sf.spring_elasticity(score).alias("elasticity"))


def unconnected(nodes: DataFrame, directed: DataFrame) -> DataFrame:
    return nodes.join(directed.select("work_id"), "work_id", "left_anti")


def visible_similarity(directed: DataFrame, threshold: float = 0.5) -> DataFrame:
    return undirected(directed).where(F.col("score") >= threshold)
