import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from evgraph.operators import similarity as sim
from tests.helpers import rows


def brute_shared(links, k):
    m, n = defaultdict(int), defaultdict(int)
    for e, r in links:
        m[e, r] += 1
        n[e] += 1
    by_ref = defaultdict(list)
    for (e, r), c in m.items():
        by_ref[r].append((e, c))
    dot = defaultdict(int)
    for group in by_ref.values():
        for a, ca in group:
            for b, cb in group:
                if a != b:
                    dot[a, b] += ca * cb
    best = defaultdict(list)
    for (a, b), d in dot.items():
        best[a].append((-math.sqrt(d * d / (n[a] * n[b])), b))
    return sorted((a, b, round(-s, 9)) for a, l in best.items() for s, b in sorted(l)[:k])


def got_pairs(df):
    return sorted((r["work_id"], r["neighbor_work_id"], round(r["score"], 9)) for r in df.collect())


def hub_links(seed, works=60, refs=25, hubs=2):
    """Random links; hub references are cited by most works, some with repeats, some works cite only hubs."""
    rng = random.Random(seed)
    links = []
    for w in range(works):
        for h in range(hubs):
            if rng.random() < 0.7:
                links += [(w, 1000 + h)] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.6:
            links += [(w, rng.randrange(refs)) for _ in range(rng.randrange(1, 5))]
    return links


@pytest.mark.parametrize("seed", range(4))
def test_shared_links_with_hubs(spark, seed):
    links = hub_links(seed)
    df = spark.createDataFrame(links, "entity long, ref long")
    want = brute_shared(links, 5)
    assert got_pairs(sim.shared_link_neighbors(df, 5, heavy_df=6)) == want
    assert got_pairs(sim.shared_link_neighbors(df, 5, heavy_df=1)) == want
    assert got_pairs(sim.shared_link_neighbors(df, 5)) == want


def test_shared_links_of_seeds(spark):
    links = hub_links(9)
    df = spark.createDataFrame(links, "entity long, ref long")
    seeds = spark.createDataFrame([(3,), (7,), (8,)], "work_id long")
    want = [r for r in brute_shared(links, 5) if r[0] in (3, 7, 8)]
    for heavy in (6, 512):
        assert got_pairs(sim.shared_link_neighbors(df, 5, heavy, seeds)) == want


def test_weak_pairs_are_passed_over_before_they_are_shuffled(spark, monkeypatch):
    rng = random.Random(3)
    links = [(w, rng.randrange(120)) for w in range(200) for _ in range(rng.randrange(2, 30))]
    df = spark.createDataFrame(links, "entity long, ref long")
    whole = len(brute_shared(links, 10_000))
    want = brute_shared(links, 3)
    counted, above = [], sim._above_floor
    monkeypatch.setattr(sim, "_above_floor", lambda pairs: counted.append(pairs.count()) or above(pairs))
    assert got_pairs(sim.shared_link_neighbors(df, 3)) == want
    monkeypatch.setattr(sim, "SKETCH_REFS", 6)  # works with more references are never passed over
    assert got_pairs(sim.shared_link_neighbors(df, 3)) == want
    assert got_pairs(sim.shared_link_neighbors(df, 3, heavy_df=20)) == want
    assert counted[0] < counted[1] < whole


def test_shared_links_in_rounds_and_parts(spark, monkeypatch):
    """Rounds, works in parts, references whose rows lie in several batches, and repeated and unknown links change nothing."""
    rng = random.Random(11)
    links = hub_links(1) + [(w, 50 + rng.randrange(9)) for w in range(60) for _ in range(rng.randrange(8))]
    df = spark.createDataFrame(links + [(None, 3), (5, None)], "entity long, ref long")
    named = spark.createDataFrame([(f"w{e:02}", f"r{r}") for e, r in links], "entity string, ref string")
    want = brute_shared(links, 5)
    monkeypatch.setattr(sim, "ROWS_A_ROUND", 60)
    monkeypatch.setattr(sim, "HUB_PART", 4)
    monkeypatch.setattr(sim, "MARKS_AT_ONCE", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for heavy in (6, 512):
            assert got_pairs(sim.shared_link_neighbors(df, 5, heavy)) == want
        assert got_pairs(sim.shared_link_neighbors(named, 5)) == [(f"w{a:02}", f"w{b:02}", s) for a, b, s in want]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sim.shared_link_neighbors(df.limit(0), 5).collect() == []


def test_common_marks_equal_sets():
    """Rows of one reference after the other; what a pair has in common is counted, and pairs below the floor are dropped."""
    import pyarrow as pa

    rng = random.Random(2)
    sizes = np.array([3, 1, 6, 9])
    marks = [sorted({7 * g} | {rng.randrange(-40, 40) for _ in range(12)}) for g, s in enumerate(sizes) for _ in range(s)]
    marks[4] = None
    count = len(marks)
    rows = pa.table({
        "entity": [f"e{i}" for i in range(count)], "n": [9] * count, "m": [1] * count, "most": [1] * count, "asks": [i % 5 > 0 for i in range(count)],
        "floor": [None if i % 7 == 0 else 36 / 81 for i in range(count)], "sketch": pa.array(marks, pa.list_(pa.int16()))})
    found = sim._able_pairs(rows, sizes, [])
    group = np.repeat(np.arange(4), sizes)
    want = {(f"e{i}", f"e{j}") for i in range(count) for j in range(count) if i != j and group[i] == group[j] and i % 5 and
            (i % 7 == 0 or marks[i] is None or marks[j] is None or len(set(marks[i]) & set(marks[j])) >= 6)}
    assert 0 < len(want) < int((sizes * (sizes - 1)).sum())
    assert sorted(zip(found["work_id"].to_pylist(), found["neighbor_work_id"].to_pylist())) == sorted(want)


def test_staged_tables_leave_no_shuffles(spark):
    from pyspark.sql import functions as F

    from evgraph.session import SHUFFLES_GO, discard, materialize

    assert spark.conf.get(SHUFFLES_GO, "false") == "false"
    kept = materialize(spark.range(50).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert rows(kept, "k", "count") == [(k, 8 if k < 1 else 7) for k in range(7)]
    assert spark.conf.get(SHUFFLES_GO, "false") == "false"
    discard(kept)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept.collect()


def test_symmetry_before_trim(spark):
    links = hub_links(2)
    df = spark.createDataFrame(links, "citing_work_id long, cited_work_id long")
    both = sim.symmetric(sim.trim(sim.bibliographic_coupling(df, 4), 4))
    pairs = got_pairs(both)
    assert pairs == sorted((b, a, s) for a, b, s in pairs)


def bounded_walks(edges, hops, k):
    adj = defaultdict(list)
    for a, b, w in edges:
        adj[a].append((b, w))
    out = []
    for start in list(adj):
        best = {start: 0}
        layer = {start: 0}
        for _ in range(hops):
            nxt = {}
            for node, d in layer.items():
                for other, w in adj[node]:
                    nxt[other] = min(nxt.get(other, 99), d + w)
            for node, d in nxt.items():
                best[node] = min(best.get(node, 99), d)
            layer = nxt
        ranked = sorted((d, b) for b, d in best.items() if b != start)[:k]
        out += [(start, b, round(1 / max(d, 1), 9)) for d, b in ranked]
    return sorted(out)


def test_lineage_rounds_move_new_near_entries_only(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(a, b) for a in range(150) for b in rng.sample(range(150), 3) if a < b}
    edges = [(x, y, 1 + (a + b) % 2) for a, b in pairs for x, y in ((a, b), (b, a))]
    df = spark.createDataFrame(edges + edges[:20], "work_id long, neighbor_work_id long, length int")
    dealt, deal = [], sim.dealt_out
    monkeypatch.setattr(sim, "dealt_out", lambda rows, *keys: (dealt.append(rows.count()) if keys == ("work_id",) else None) or deal(rows, *keys))
    assert got_pairs(sim.lineage_neighbors(df, 4)) == bounded_walks(edges, 4, 4)
    assert len(dealt) == 3 and sum(dealt) < 3 * 4 * len(edges) / 2


@pytest.mark.parametrize("seed", range(4))
def test_lineage_is_exact_when_pruned(spark, seed):
    rng = random.Random(seed)
    undirected = {}
    for _ in range(70):
        a, b = rng.randrange(40), rng.randrange(40)
        if seed % 2:
            a = 0 if rng.random() < 0.3 else a  # a hub
        if a != b:
            undirected[min(a, b), max(a, b)] = rng.choice([1, 2])
    edges = [(a, b, w) for (a, b), w in undirected.items()] + [(b, a, w) for (a, b), w in undirected.items()]
    df = spark.createDataFrame(edges, "work_id long, neighbor_work_id long, length int")
    for k in (3, 32):
        assert got_pairs(sim.lineage_neighbors(df, k, hub_part=4096 if k == 3 else 2)) == bounded_walks(edges, 4, k)
    seeds = spark.createDataFrame([(0,), (5,)], "work_id long")
    want = [r for r in bounded_walks(edges, 4, 3) if r[0] in (0, 5)]
    assert got_pairs(sim.lineage_neighbors(df, 3, seeds=seeds)) == want


def brute_cosine(vectors, k):
    out = []
    for f in {f for _, f, _ in vectors}:
        part = [(i, np.array(v, dtype=np.float64)) for i, g, v in vectors if g == f]
        for i, v in part:
            scored = sorted(
                (-round(float(v @ w / np.sqrt((v @ v) * (w @ w))), 9), j) for j, w in part if j != i
            )
            out += [(f, i, j, -s) for s, j in scored[:k]]
    return sorted(out)


def clustered_vectors(seed, copies):
    rng = np.random.default_rng(seed)
    vectors, i = [], 0
    for field, n in (("aspect:problem", 150), ("aspect:theory", 40)):
        centers = rng.normal(size=(6, 8)) * 3
        for _ in range(n):
            v = centers[rng.integers(6)] + rng.normal(size=8) * 0.3
            vectors.append((i, field, [float(np.float32(x)) for x in v]))
            i += 1
    hot = vectors[3][2]
    for _ in range(copies):  # a third of the field are equal vectors
        vectors.append((i, "aspect:problem", hot))
        i += 1
    return vectors


@pytest.mark.parametrize("block_rows,pivots", [(8192, 128), (20, 4), (7, 16)])
def test_cosine_is_exact(spark, block_rows, pivots):
    vectors = clustered_vectors(1, 70)
    df = spark.createDataFrame(vectors, "entity_id long, field string, vec array<float>")
    got = sim.cosine_neighbors(df, 5, block_rows, pivots).collect()
    got = sorted((r["field"], r["work_id"], r["neighbor_work_id"], round(r["score"], 9)) for r in got)
    want = brute_cosine(vectors, 5)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose(sorted(r[3] for r in got), sorted(r[3] for r in want))
    assert [r[:3] for r in got if r[3] < 0.999999] == [r[:3] for r in want if r[3] < 0.999999]


def test_block_meets_its_queries_a_slice_at_a_time():
    rng = np.random.default_rng(4)
    block, asking = rng.normal(size=(300, 6)), rng.normal(size=(5000, 6))
    rows = [("f", f"b{i}", v, False) for i, v in enumerate(block)] + [("f", f"q{i}", v, True) for i, v in enumerate(asking)]
    pdf = pd.DataFrame(rows, columns=["field", "twin", "vec", "asks"]).assign(cluster=0, block=0, portion=0)
    alone = pdf[300:350].assign(block=1)  # a block without rows of its own
    frames = list(sim._meet_blocks([pdf[:100], pdf[100:2000], pdf[2000:], alone], 4))
    assert max(map(len, frames)) <= 5 * sim.SLICE
    unit = lambda m: m / np.sqrt((m * m).sum(1, keepdims=True))
    best = np.argsort(-(unit(asking) @ unit(block).T), axis=1)[:, :5]
    want = {(f"q{i}", f"b{j}") for i, near in enumerate(best) for j in near}
    found = pd.concat(frames)
    assert len(found) == len(want) and set(zip(found["twin"], found["other_twin"])) == want


def test_cleared_aspects_have_no_list(spark):
    df = spark.createDataFrame(
        [(1, "aspect:theory", [1.0, 0.0]), (2, "aspect:theory", [1.0, 1.0]), (3, "aspect:theory", [0.0, 0.0])],
        "entity_id long, field string, vec array<float>",
    )
    assert {r["work_id"] for r in sim.aspect_neighbors(df).collect()} == {1, 2}
    cleared = spark.createDataFrame([("aspect:theory", 1)], "field string, work_id long")
    assert {r["work_id"] for r in sim.aspect_neighbors(df, cleared=cleared).collect()} == {2}


def neighbors(spark, data):
    return spark.createDataFrame(data, "dimension string, work_id string, neighbor_work_id string, score double")


def test_blend_and_views(spark):
    n = neighbors(
        spark, [("citation_coupling", "w1", "w2", 1.0), ("method_lineage", "w1", "w2", 1.0), ("topic", "w1", "w2", 0.5)]
    )
    assert rows(sim.blend(n, {"citation_coupling": 0.5, "method_lineage": 0.5})) == [("w1", "w2", 1.0)]
    assert rows(sim.blend(n, {})) == [("w1", "w2", 0.0)]
    assert rows(sim.blend(n, {"citation_coupling": 1, "method_lineage": 1, "topic": 2}, topic=True)) == [("w1", "w2", 0.75)]


def test_strongest_and_springs(spark):
    d = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.7), ("a", "d", 0.2), ("a", "a", 1.0), ("a", "e", float("nan"))],
        "work_id string, neighbor_work_id string, score double",
    )
    assert rows(sim.strongest_blended(d, 2, 0.3), "neighbor_work_id") == [("b",), ("c",)]
    two = spark.createDataFrame(
        [("a", "b", 0.9), ("a", "c", 0.7), ("b", "a", 0.85), ("b", "c", 0.6)], "work_id string, neighbor_work_id string, score double"
    )
    springs = {(r["source_id"], r["target_id"]): r for r in sim.layout_springs(two).collect()}
    assert set(springs) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert springs["a", "b"]["score"] == 0.9
    assert springs["a", "b"]["ideal_length"] < springs["a", "c"]["ideal_length"]
    assert rows(sim.visible_similarity(two, 0.7), "target_id") == [("b",), ("c",)]
