import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evgraph import taxonomy as tx
from evgraph.operators import ego
from evgraph.operators import relations as rel
from evgraph.session import materialize
from tests.helpers import rows

EDGE = (
    "relation_id long, source_work_id string, target_work_id string, relation_type string, review_status string, "
    "source_layer string, confidence double, explanation string, review_count long"
)


def edge_table(spark, data):
    return spark.createDataFrame([(*d[:5], "ai_candidate", None, "", d[5]) for d in data], EDGE)


def test_bundles(spark):
    edges = edge_table(spark, [
        (1, "a", "b", "improves_on", "confirmed", 1), (2, "b", "a", "uses_method_from", "unreviewed", 0),
        (3, "a", "b", "supports_claim", "disputed", 2), (4, "a", "b", "compares_against", "confirmed", 1),
        (5, "a", "b", "reproduces", "confirmed", 1), (6, "a", "b", "prerequisite_for", "unreviewed", 0),
        (7, "b", "a", "alternative_to", "unreviewed", 0), (8, "a", "b", "alternative_to", "confirmed", 4),
    ])
    got = {(r["symmetric"], r["bundle_source"], r["bundle_target"], r["semantic_group"]): r for r in rel.bundle_edges(edges).collect()}
    assert got[False, "a", "b", "method"]["count"] == 1 and got[False, "b", "a", "method"]["count"] == 1
    both = got[False, "a", "b", "experiment"]
    assert (both["count"], both["label"], both["status"]) == (2, "experiment ×2", "confirmed")
    # four groups from a to b, the weakest is left out
    assert (False, "a", "b", "reading") not in got
    undirected = got[True, "a", "b", "method"]
    assert (undirected["count"], undirected["review_count"], undirected["status"]) == (2, 4, "confirmed")


def test_relation_validation(spark):
    relations = spark.createDataFrame(
        [(1, 0.5), (2, 1.5), (3, float("nan")), (4, None), (5, None), (6, None)], "relation_id long, confidence double")
    members = spark.createDataFrame(
        [(1, "work", 1, "source", 1), (1, "work", 2, "target", None), (2, "work", 1, "source", 2), (2, "work", 1, "target", 1),
         (3, "work", 1, "source", None), (3, "work", 2, "source", None), (4, "claim", 9, "source", 1), (4, "work", 99, "target", 98),
         (5, "dataset", 3, "source", 1), (5, "work", 2, "target", 2)],
        "relation_id long, entity_kind string, entity_id long, role string, anchor_work_id long")
    owner = lambda data: spark.createDataFrame(data, "entity_id long, work_id long")
    owners = {"work": owner([(1, 1), (2, 2)]), "claim": owner([(9, 2)]), "dataset": owner([(3, None)])}
    got = dict(rows(rel.validate_relations(relations, members, owners), "relation_id", "reasons"))
    assert got[1] == [] and got[5] == []
    assert got[2] == ["source equals target", "confidence outside 0..1", "anchor does not own member"]
    assert got[3] == ["needs one source and one target", "confidence outside 0..1"]
    assert got[4] == ["unknown member", "unknown anchor", "anchor does not own member"]
    assert got[6] == ["needs one source and one target"]


def test_evidence_pages(spark):
    ev = spark.createDataFrame([(1, 5, None, None, 1, 0, "q")], "evidence_id long, relation_id long, claim_id long, extraction_field string, version_id long, page int, text string")
    versions = spark.createDataFrame([(1,)], "version_id long")
    assert rows(rel.validate_evidence(ev, versions), "reasons") == [(["page too low"],)]
    assert rows(rel.validate_evidence(ev, versions, lowest_page=0), "reasons") == [([],)]


def test_invalid_output_is_rejected(spark):
    raw = '{"relations":[{"type":"improves_on","source_paper":"B","target_paper":"A","explanation":"e","evidence_quote":"q","confidence":0.5}]}'
    outputs = spark.createDataFrame(
        [(1, 10, 2, 20, raw), (3, 30, 4, 40, raw + "}"), (5, 50, 5, 51, raw)],
        "a_work_id long, a_version_id long, b_work_id long, b_version_id long, raw string")
    relations = spark.createDataFrame([], "relation_id long, type string, review_status string")
    members = spark.createDataFrame([], "relation_id long, entity_kind string, entity_id long, role string")
    got = rel.pair_candidates(outputs, relations, members).collect()
    # the quote side defaults to the source tag, here B
    assert [(r["source_work_id"], r["target_work_id"], r["version_id"], r["page"]) for r in got] == [(2, 1, 20, 0)]


def plain_neighbourhoods(n, edges, members, readers, kept, expanded):
    """Per centre: rows (other, relation, direction, score) of both hops, and the best others."""
    anchors = {(r, a) for r, _, a in members if a is not None}

    def collect(anchor, center, seen):
        out = []
        for r, a, b, _, status, _, conf, _, votes in edges:
            if (r, anchor) not in anchors or r in seen:
                continue
            other, way = (b, "out") if a == center else (a, "in") if b == center else (b, "out") if a == anchor else (a, "in") if b == anchor else (None, "")
            if other is None:
                continue
            seen.add(r)
            base = tx.STATUS_WEIGHTS[status] * (1 + conf) + votes * 0.2
            out.append((other, r, way, base + readers[other] * 0.15))
        return out

    def best_of(found):
        best = {}
        for other, _, _, s in found:
            best[other] = max(best.get(other, -1), s)
        return sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))

    out = {}
    for c in range(n):
        seen = set()
        found = collect(c, c, seen)
        if found:
            for hop, _ in best_of(found)[:expanded]:
                found += collect(hop, c, seen)
            out[c] = found, best_of(found)[:kept]
    return out


def test_what_the_expansion_multiplies_meets_no_other_table(spark):
    columns = "center_id long, neighbor_work_id long, relation_id long, direction string, score double, from_anchor boolean, to_anchor boolean"
    scored = spark.createDataFrame([(1, 2, 1, "out", 1.0, True, True), (2, 1, 1, "in", 1.0, True, True), (2, 3, 2, "out", 0.5, True, None)], columns)
    found = ego.two_hop_candidates(scored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # parts of hubs, before the expansion
    assert rows(found, "center_id", "neighbor_work_id", "relation_id") == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2)]


@pytest.mark.parametrize("seed,hub_part", [(0, 4096), (2, 5), (3, 1)])
def test_two_hops_like_full_search(spark, seed, hub_part):
    rng = random.Random(seed)
    n, edges, members = 40, [], []
    kinds = {}
    for i in range(150):
        a, b = rng.randrange(n), rng.randrange(n)
        if rng.random() < 0.3:
            a = 0
        if a == b:
            continue
        conf, status = rng.random(), rng.choice(["confirmed", "unreviewed", "disputed"])
        kinds[i] = rng.choice(["improves_on", "improves_on", "uses_method_from"])
        edges.append((i, a, b, kinds[i], status, "ai_candidate", conf, "", rng.randrange(3)))
        members += [(i, "source", a if rng.random() < 0.8 else None), (i, "target", b if rng.random() < 0.8 else None)]
    reading = [(u, rng.randrange(n), "read") for u in range(60)]
    readers = defaultdict(int)
    for _, w, _ in reading:
        readers[w] += 1
    want = plain_neighbourhoods(n, edges, members, readers, kept=6, expanded=3)
    e = spark.createDataFrame(
        edges, EDGE.replace("source_work_id string, target_work_id string", "source_work_id long, target_work_id long"))
    m = spark.createDataFrame(members, "relation_id long, role string, anchor_work_id long")
    r = spark.createDataFrame(reading, "user_id long, work_id long, status string")
    scored = ego.scored_ends(e, m, r)
    best = sorted((c, o, round(s, 6)) for c, (_, kept) in want.items() for o, s in kept)
    out = ego.two_hop_others(scored, k=6, expanded=3).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, out.select("center_id", "neighbor_work_id", "score").collect())) == best

    found = ego.two_hop_candidates(scored, 3, hub_part)
    got = found.select("center_id", "neighbor_work_id", "relation_id", "direction", F.round("score", 6))
    assert sorted(map(tuple, got.collect())) == sorted((c, o, i, way, round(s, 6)) for c, (rows_, _) in want.items() for o, i, way, s in rows_)
    kept = ego.kept_others(found, 6)
    assert sorted(map(tuple, kept.select("center_id", "neighbor_work_id", F.round("score", 6)).collect())) == best
    groups = defaultdict(set)
    shown = set()
    ends = {i: (a, b) for i, a, b, *_ in edges}
    for c, (rows_, best_) in want.items():
        inside = {o for o, _ in best_}
        for o, i, way, _ in rows_:
            if o not in inside:
                groups[c, f"{kinds[i]}:{way}"].add(o)
            if set(ends[i]) <= inside | {c}:
                shown.add((c, str(i)))
    over = ego.overflow_members(found, kept)
    summed = ego.overflow_groups(over)
    assert rows(summed, "center_id", "group_key", "members") == sorted(
        ((c, k, len(o)) for (c, k), o in groups.items()), key=lambda x: [str(y) for y in x])
    assert {(x.center_id, x.group_key, x.neighbor_work_id) for x in over.collect()} == {(c, k, o) for (c, k), os in groups.items() for o in os}
    lines = ego.ego_edges(found, kept, summed)
    assert {(x.center_id, x.edge_id) for x in lines.where("bundle_key IS NOT NULL").collect()} == shown
    assert lines.where("bundle_key IS NULL").count() == len(groups) > 20


def test_two_hop_views_in_rounds(spark, monkeypatch):
    """Centres are looked at in turns; what is counted and drawn stays the same, and no shuffle of the candidates waits for the end."""
    rng = random.Random(4)
    edges = [(i, rng.randrange(25), rng.randrange(25), rng.choice(["improves_on", "uses_method_from"]), "confirmed", "x", rng.random(), "", 0) for i in range(120)]
    edges = [e for e in edges if e[1] != e[2]]
    e = spark.createDataFrame(edges, EDGE.replace("source_work_id string, target_work_id string", "source_work_id long, target_work_id long"))
    m = spark.createDataFrame([(i, role, w) for i, a, b, *_ in edges for role, w in (("source", a), ("target", b))], "relation_id long, role string, anchor_work_id long")
    scored = materialize(ego.scored_ends(e, m, spark.createDataFrame([], "user_id long, work_id long, status string")), "scored")
    monkeypatch.setattr(ego, "ENDS_A_ROUND", 100)
    assert ego.rounds_of(scored) == 3
    found = ego.two_hop_candidates(scored, 3)
    seen = []
    for n in (0, 3):
        kept = ego.kept_others(found, 4, n)
        groups = ego.overflow_groups(ego.overflow_members(found, kept), n)
        drawn = ego.ego_edges(found, kept, groups, n)
        seen.append([rows(df, *sorted(df.columns)) for df in (kept, groups, drawn)])
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in plan) == (n == 0)
    assert seen[0] == seen[1] and all(seen[0])



def test_positions_over_strides(spark):
    data = [("a", i) for i in range(0, 50, 3)] + [("b", 7), ("b", 1)]
    df = spark.createDataFrame(data, "k string, o int")
    got = rows(rel.positions_within(df, ["k"], "o", "p", stride=4), "k", "o", "p")
    want = [("a", o, i) for i, o in enumerate(range(0, 50, 3))] + [("b", 1, 0), ("b", 7, 1)]
    assert sorted(got) == sorted(want)


def test_grounding_ignores_case(spark):
    ev = spark.createDataFrame([(1, 1, 1, "HELLO WORLDs apart", None), (2, 1, 1, "zzz", None), (3, 1, 2, "x", "[1,2,30,40]")],
                               "evidence_id long, version_id long, page int, text string, bbox string")
    seg = spark.createDataFrame([(1, 1, 5, "say hello worlds"), (1, 1, 3, "Hello World!"), (1, 1, 4, "hello worlds")],
                                "version_id long, page int, segment_no int, text string")
    got = {r["evidence_id"]: (r["how"], r["segment_no"]) for r in rel.ground_evidence(ev, seg).collect()}
    assert got == {1: ("segment", 4), 2: ("none", None), 3: ("box", None)}


def one_by_one(quotes, segments):
    """Every quote against every segment of its page."""
    out = {}
    for evidence, version, page, text, box in quotes:
        head = (text or "")[:12].lower()
        found = [no for v, p, no, body in segments if (v, p) == (version, page) and body is not None and head in body.lower()]
        if box is not None:
            out[evidence] = ("box", None)
        else:
            out[evidence] = ("segment", min(found)) if head and version is not None and found else ("none", None)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_evidence_grounded_like_one_by_one(spark, seed):
    """Short, empty and missing quotes, copies, segments longer than a stretch, a page with most rows."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    segments = [(rng.choice([1, 1, 1, 2]), rng.randrange(2), no, text(rng.choice([0, 3, 30, 1700]))) for no in range(40)]
    segments += [(1, 0, 40, None)] + segments[:3]
    quotes = []
    for i in range(120):
        version, page, _, body = rng.choice(segments)
        start = rng.randrange(len(body or "") + 1)
        quote = rng.choice([(body or "")[start : start + rng.choice([1, 5, 11, 12, 40])], text(7), "", None])
        quotes.append((i, rng.choice([version, version, None]), page, quote, (1.0, 2.0, 3.0, 4.0) if rng.random() < 0.1 else None))
    ev = spark.createDataFrame(
        quotes, "evidence_id long, version_id long, page int, text string, bbox struct<x:double,y:double,w:double,h:double>")
    seg = spark.createDataFrame(segments, "version_id long, page int, segment_no int, text string")
    got = {r["evidence_id"]: (r["how"], r["segment_no"]) for r in rel.ground_evidence(ev, seg).collect()}
    assert got == one_by_one(quotes, segments)
    assert rel.ground_evidence(ev.limit(0), seg).count() == 0
    assert {r["how"] for r in rel.ground_evidence(ev, seg.limit(0)).collect()} <= {"box", "none"}


def test_queue_variants(spark):
    data = [
        (1, "cites", 0.9, "ai_candidate", "unreviewed", 1), (2, "version_of", 0.9, "ai_candidate", "unreviewed", 2),
        (3, "improves_on", 0.7, "ai_candidate", "unreviewed", 3), (4, "contradicts_claim", None, "ai_candidate", "unreviewed", 4),
        (5, "improves_on", 0.8, "ai_candidate", "unreviewed", 5), (6, "improves_on", 0.9, "team_record", "unreviewed", 6),
        (7, "improves_on", 0.9, "ai_candidate", "confirmed", 7),
    ]
    relations = spark.createDataFrame(data, "relation_id long, type string, confidence double, source string, review_status string, created_at long")
    members = spark.createDataFrame([(i, 100) for i in range(1, 8)], "relation_id long, anchor_work_id long")
    ids = lambda **how: [r["relation_id"] for r in rel.review_queue(relations, members, **how).collect()]
    assert ids() == [5, 4]
    assert ids(only_unreviewed=False) == [7, 5, 4, 3, 2]
    assert ids(work_id=100) == [1, 2, 3, 4, 5]
    assert ids(work_id=100, only_unreviewed=False, limit=2, offset=4) == [5, 7]


def test_replies_name_contexts_of_their_own_batch_only(spark):
    """Thirteen contexts make two batches; the first batch's first item wins, whatever the context's number."""
    import json

    from evgraph.operators.relations import context_candidates

    item = lambda c, kind, **more: {"context_id": c, "type": kind, "confidence": 0.9, "explanation": c, **more}
    replies = [
        (0, [item("c12", "improves_on"), item("c3", "improves_on"), item("c2", "improves_on")]),
        (1, [item("c0", "improves_on"), item("c12", "improves_on"), item("c12", "alternative_to")]),
    ]
    outputs = spark.createDataFrame(
        [(1, 10, b, json.dumps({"classifications": r})) for b, r in replies], "work_id long, version_id long, batch int, raw string")
    contexts = spark.createDataFrame(
        [(1, n // 12, f"c{n}", "#b0", f"text {n}", 1, None) for n in range(13)],
        "work_id long, batch int, context_id string, target string, text string, page int, bbox string")
    resolved = spark.createDataFrame([(1, "#b0", 2)], "work_id long, target string, resolved_work_id long")
    relations = spark.createDataFrame([], "relation_id long, type string, assertion_mode string, review_status string")
    members = spark.createDataFrame([], "relation_id long, entity_id long, role string")
    got = {r["type"]: r["explanation"] for r in context_candidates(outputs, contexts, resolved, relations, members).collect()}
    assert got == {"improves_on": "c3", "alternative_to": "c12"}


def test_pieces_that_no_quote_wants_stay_where_they_were_cut(spark):
    """One quote of a page: few places of its text are looked up. Very many quotes: all of them are found."""
    text = "".join(f"word{i:04d} " for i in range(1500))
    seg = spark.createDataFrame([(1, 1, 7, text), (1, 2, 8, text.upper()), (2, None, 9, text)], "version_id long, page long, segment_no long, text string")
    one = spark.createDataFrame([(1, 1, text[900:912])], "version_id long, page long, _piece string")
    pieces = rel.segment_pieces(seg, one).collect()
    assert len(pieces) < 60 and (1, 1, 7, text[900:912]) in [tuple(p) for p in pieces]
    starts = range(0, len(text) - 12, 4)
    many = [(i, 1, 2, text[i : i + 12] + "and more", None) for i in starts] + [(-1, 1, 2, "nowhere at all", None), (-2, 1, 1, text[900:912], None)]
    ev = spark.createDataFrame(many, "evidence_id long, version_id long, page long, text string, bbox string")
    got = {r["evidence_id"]: (r["how"], r["segment_no"]) for r in rel.ground_evidence(ev, seg).collect()}
    assert got == {i: ("segment", 8) for i in starts} | {-1: ("none", None), -2: ("segment", 7)}
