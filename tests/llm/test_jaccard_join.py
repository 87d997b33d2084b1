"""Components of similar shingle sets against all pairs, and the pigeonhole under any shares."""

import re

import numpy as np
import pytest

from evgraph.llm import jaccard_join as jj


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain(docs):
    sets = [plain_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(((d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def got(spark, docs, **limits):
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in docs], "doc_id long, text string, size long, node string").repartition(4)
    return sorted((tuple(r) for r in jj.joined(df, **limits).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def texts(seed, groups=8, members=14):
    """Groups of edited copies of texts of many lengths, a chain each, and unlike texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(900)]
    out = []
    for g in range(groups):
        base = rng.choice(words, int(rng.integers(8, 260))).tolist()
        now = list(base)
        for _ in range(members):
            out.append(" ".join(now))
            source = base if rng.random() < 0.5 else now
            now = list(source)
            for at in rng.choice(len(now), int(rng.integers(1, 1 + max(2, len(now) // 40))), replace=False):
                now[at] = f"n{rng.integers(10**6)}"
            if rng.random() < 0.3:
                now = now[: len(now) - int(rng.integers(0, 2))]
    return out + [" ".join(rng.choice(words[:12], int(rng.integers(1, 25)))) for _ in range(60)]


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"price": 0.0}), (3, {"small": 1, "most": 5, "tokens": 300}), (4, {"price": 0.0, "small": 3, "most": 3})])
def test_equals_all_pairs(spark, seed, limits):
    docs = [(i * 3 % 1009, t) for i, t in enumerate(texts(seed))]
    docs += [(None, docs[0][1]), (None, "only without id"), (5000, "Only  WITHOUT\tid x"), (5001, None), (5002, ""), (5003, " \n"), (None, None)]
    docs += [(5004, "one"), (5005, "ONE"), (5006, "one two"), (5004, "one"), (5007, "Été"), (5008, "été")]
    want = plain(docs)
    assert got(spark, docs, **limits) == want
    assert len({c for _, n, c in want if n}) < len(docs) - 40


def test_long_text_and_no_rows(spark):
    rng = np.random.default_rng(9)
    long = rng.integers(0, 10**6, 30_000).astype(str).tolist()
    near = list(long)
    for at in range(0, 30_000, 70):
        near[at] = "x"
    far = list(long)
    for at in range(0, 30_000, 40):
        far[at] = "y"
    docs = [(3, " ".join(long)), (2, " ".join(near)), (1, " ".join(far))]
    assert got(spark, docs) == plain(docs)
    assert got(spark, []) == []


def test_similar_sets_share_a_key_under_any_shares():
    rng, bands, met = np.random.default_rng(5), jj.Bands(), 0
    for _ in range(400):
        size = int(rng.integers(1, 120))
        base = rng.integers(0, 2**64, size, np.uint64)
        drop, add = rng.integers(0, 1 + size // 10, 2)
        a, b = np.unique(base), np.unique(np.concatenate((base[drop:], rng.integers(0, 2**64, add, np.uint64))))
        common = len(np.intersect1d(a, b))
        if not (len(a) and len(b) and 100 * common >= 90 * (len(a) + len(b) - common)):
            continue
        met += 1
        band = bands.of(max(len(a), len(b)))
        assert band in bands.listed_in(len(a)) and band in bands.listed_in(len(b))
        n = bands.segments(band)
        assert len(np.setxor1d(a, b)) < n
        share = jj.shares(rng.integers(0, 100, n), 1, bands.top(band), 0.0)
        assert share.sum() == n
        keys = []
        for s in (a, b):
            whole = jj.segment_keys(s, band, n)[share > 0]
            keys.append((set(whole.tolist()), set(jj.segment_keys(s, band, n, np.flatnonzero(share == 2)).tolist())))
        (aw, ad), (bw, bd) = keys
        assert aw & bw or aw & bd or ad & bw
    assert met > 150


def test_bands_hold_what_a_set_can_be_similar_to():
    bands = jj.Bands()
    for size in range(1, 3000):
        largest = size * 100 // 90
        assert bands.of(largest) in bands.listed_in(size)
        assert 20 * largest // 190 < bands.segments(bands.of(largest))


def test_similar_sets_share_more_keys_than_their_surplus():
    rng, bands, met = np.random.default_rng(8), jj.Bands(), 0
    for _ in range(300):
        size = int(rng.integers(1, 400))
        base = rng.integers(0, 2**64, size, np.uint64)
        drop, add = rng.integers(0, 1 + size // 15, 2)
        a, b = np.unique(base), np.unique(np.concatenate((base[drop:], rng.integers(0, 2**64, add, np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            band = bands.of(max(len(a), len(b)))
            n = bands.segments(band)
            shared = np.sum(jj.segment_keys(a, band, n) == jj.segment_keys(b, band, n))
            assert shared > max(bands.surplus(len(a), band), bands.surplus(len(b), band)) >= 0
            met += bands.surplus(len(a), band) > 2
    assert met > 50


def test_shares_move_from_crowded_segments():
    share = jj.shares(np.array([0, 10**6, 0, 5]), 10, 40)
    assert share.tolist() == [2, 0, 1, 1] and jj.shares(np.array([3, 3, 3]), 10, 40).tolist() == [1, 1, 1]


def test_blocks_of_two_portions_compare_across_only():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 50)
    sets = [np.sort(np.concatenate((base[i:], rng.integers(0, 2**62, i)))) for i in (0, 1, 2, 9, 0)]
    nodes = groups = np.arange(5)
    assert len(jj.links_within(nodes, groups, sets, np.zeros(5))) == 3
    assert sorted(map(sorted, jj.links_within(nodes, groups, sets, np.array([0, 0, 0, 1, 1])))) == [[0, 4], [1, 4], [2, 4]]
    assert jj.links_within(nodes, np.zeros(5), sets, np.zeros(5)) == []
