import datetime
import random

import pytest
from pyspark.sql import functions as F

from evgraph.operators import consensus, evaluation, extraction, reads, tables
from evgraph.plans import registry, stream_queries  # noqa: F401
from evgraph.session import fresh_path, materialize
from evgraph.sources import gold, paper_text
from evgraph.sources.bindings import Library
from evgraph.streaming import change_feeds as feeds
from tests.helpers import rows

VOTE = "review_id long, subject_kind string, subject_id long, user_id long, verdict string, created_at long"


def votes(spark, data):
    return spark.createDataFrame([(i, "relation", s, u, v, t) for i, (s, u, v, t) in enumerate(data)], VOTE)


def test_status(spark):
    data = [(1, 1, "agree", 1), (1, 2, "disagree", 2), (2, 1, "disagree", 1), (3, 1, "disagree", 1), (3, 1, "agree", 2)]
    status = consensus.relation_status(consensus.latest_reviews(votes(spark, data)))
    assert rows(status) == [(1, "disputed"), (2, "rejected"), (3, "confirmed")]


@pytest.mark.parametrize("seed", range(3))
def test_overrides_in_order(spark, seed):
    rng = random.Random(seed)
    log = []
    for i in range(120):
        kind = rng.choice(["vote"] * 3 + ["confirmed", "rejected", "unreviewed", "disputed"])
        log.append((i, rng.randrange(12), rng.randrange(4), kind, rng.choice(["agree", "disagree"])))
    state = {}
    for _, s, u, kind, verdict in log:
        cast, _ = state.setdefault(s, ({}, "unreviewed"))
        if kind == "unreviewed":
            state[s] = ({}, "unreviewed")
            continue
        if kind == "disputed":
            state[s] = (cast, "disputed")
            continue
        cast[u] = {"confirmed": "agree", "rejected": "disagree"}.get(kind, verdict)
        said = set(cast.values())
        state[s] = (cast, "disputed" if len(said) == 2 else "confirmed" if said == {"agree"} else "rejected")
    reviews = spark.createDataFrame([(i, "relation", s, u, v, i) for i, s, u, k, v in log if k == "vote"], VOTE)
    overrides = spark.createDataFrame(
        [(s, u, k, i, i) for i, s, u, k, _ in log if k != "vote"],
        "subject_id long, user_id long, status string, created_at long, review_id long")
    assert dict(rows(consensus.override_status(reviews, overrides))) == {s: st for s, (_, st) in state.items()}


def test_promotion(spark):
    sel = spark.createDataFrame([(1, 5, 50, 9, "claim", "quote", 3), (2, 5, 50, 9, "bare", " 　", 3), (3, 5, 50, 9, " ", "q", 1)],
                                "selection_id long, work_id long, version_id long, user_id long, claim_text string, source_text string, page int")
    claims, evidence = consensus.promote_selections(sel)
    assert rows(claims, "text", "source", "review_status") == [("bare", "team_record", "confirmed"), ("claim", "team_record", "confirmed")]
    assert rows(evidence, "extraction_field", "text") == [("promoted_claim", "quote")]


def test_table_maintenance(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, t long")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, "e", 1)], "k long, v string, t long")
    assert rows(tables.upsert(now, new, ["k"], ["t"])) == [(1, "a", 1), (2, "c", 5), (3, "e", 1)]
    assert rows(tables.insert_ignore(now, new, ["k"]), "k") == [(3,)]
    members = spark.createDataFrame([(7, 1, 0)], "graph_id long, work_id long, added_by long")
    assert rows(tables.add_to_graph(members, spark.createDataFrame([(1,), (2,)], "work_id long"), 7, 9)) == [(7, 2, 9)]


def test_comment_rules(spark):
    schema = "comment_id long, graph_id long, work_id long, user_id long, visibility string, body string, parent_id long"
    stored = spark.createDataFrame([(1, 1, 1, 5, "private", "x", None), (2, 1, 2, 5, "team", "x", None)], schema)
    nodes = spark.createDataFrame([(1, 1), (1, 2)], "graph_id long, work_id long")
    new = spark.createDataFrame(
        [(10, 1, 1, 5, "private", "  idea  ", 1), (11, 1, 1, 5, "team", "x", 1), (12, 1, 1, 6, "private", "x", 1), (13, 1, 1, 5, "team", " ", 2),
         (14, 1, 9, 5, "team", "x" * 20001, None), (15, 1, 1, 5, "team", "x", 99)], schema)
    got = {r["comment_id"]: (r["body"], r["reasons"]) for r in reads.validate_comments(new, stored, nodes).collect()}
    assert got[10] == ("idea", [])
    assert got[11][1] == ["reply must be private"]
    assert got[12][1] == ["unknown parent"]
    assert got[13][1] == ["body required", "parent elsewhere"]
    assert got[14][1] == ["body too long", "work not in graph"]
    assert got[15][1] == ["unknown parent"]


def test_deletes(spark):
    schema = "annotation_id long, user_id long, parent_id long"
    notes = spark.createDataFrame([(1, 5, None), (2, 6, 1), (3, 7, 2), (4, 5, None)], schema)
    asked = spark.createDataFrame([(1, 5), (4, 6)], "annotation_id long, user_id long")
    assert rows(reads.delete_own_annotations(notes, asked), "annotation_id") == [(4,)]
    comments = notes.withColumnRenamed("annotation_id", "comment_id")
    left = reads.delete_own_comments(comments, asked.withColumnRenamed("annotation_id", "comment_id"))
    assert rows(left, "comment_id", "parent_id") == [(2, None), (3, 2), (4, None)]


def test_deletes_reach_deep_threads_in_few_rounds(spark, monkeypatch):
    """A thread of a thousand replies, one of which is deleted, a wide one, and one that replies to itself."""
    deep = [(i, 1, i - 1 if i else None) for i in range(1000)]
    wide = [(2000, 1, None)] + [(2001 + i, 2, 2000) for i in range(300)]
    odd = [(5000, 1, 5001), (5001, 1, 5000), (6000, 1, 6001), (6001, 1, 6000), (7000, 1, 9999), (7001, 2, 7000)]
    schema = "annotation_id long, user_id long, parent_id long"
    notes = spark.createDataFrame(deep + wide + odd, schema).repartition(4)
    asked = spark.createDataFrame([(400, 1), (400, 1), (2000, 1), (2001, 1), (6001, 1), (5, 2)], "annotation_id long, user_id long")
    rounds = []
    monkeypatch.setattr(reads, "MOST_DOUBLINGS", 14)
    monkeypatch.setattr(reads, "materialize", lambda df, label: rounds.append(label) or materialize(df, label))
    got = {r.annotation_id for r in reads.delete_own_annotations(notes, asked).collect()}
    assert got == set(range(400)) | {5000, 5001, 7000, 7001}
    assert len(rounds) <= 14
    rounds.clear()
    straight = spark.createDataFrame(deep, schema)
    assert reads.delete_own_annotations(straight, asked).count() == 400 and len(rounds) <= 11
    assert reads.delete_own_annotations(straight, asked.limit(0)).count() == 1000


def test_pages_list_author_names_in_order(spark):
    page = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, None, "c")], "work_id long, primary_version_id long, title string")
    links = spark.createDataFrame([(10, 7, 2), (10, 8, 1), (10, 9, 2), (11, 7, 1)], "version_id long, author_id long, position int")
    people = spark.createDataFrame([(7, "Seven"), (8, "Eight"), (9, "Nine")], "author_id long, full_name string")
    got = dict(rows(reads.with_author_names(page, links, people), "work_id", "authors"))
    assert got == {1: ["Eight", "Seven", "Nine"], 2: [], 3: []}


def test_cards_fall_back_to_the_first_version(spark):
    works = spark.createDataFrame([(1, 12), (2, None), (3, None)], "work_id long, primary_version_id long")
    versions = spark.createDataFrame([(11, 1, 1), (12, 1, 2), (22, 2, 9), (23, 2, 4), (24, 2, 4)], "version_id long, work_id long, created_at long")
    assert rows(reads.with_shown_version(works, versions), "work_id", "primary_version_id") == [(1, 12), (2, 23), (3, None)]


def test_triage(spark):
    asked = spark.createDataFrame([(c,) for c in "abcdefg"], "custom_id string")
    results = spark.createDataFrame(
        [("a", "boom", "{}", "{}"), ("b", None, None, None), ("c", None, "{}", None), ("d", None, "{}", "{oops"), ("e", None, "{}", "{} x"),
         ("f", None, "{}", '{"a":1}')], "custom_id string, error string, message string, text string")
    got = dict(rows(extraction.triage_results(asked, results), "custom_id", "outcome"))
    assert got == {"a": "provider error", "b": "no message", "c": "no text", "d": "invalid JSON", "e": "invalid JSON", "f": "ok", "g": "missing"}


def test_extraction_rows(spark):
    raw = (
        '```json\n{"methods":{"summary":" Sum ","bullets":[" Sum "," ","B"],"source_text":"src","page":-3},'
        '"findings":{"summary":"only summary","bullets":[],"source_text":""}}\n```'
    )
    outputs = spark.createDataFrame([(1, 10, raw), (2, 20, "no json")], "work_id long, version_id long, raw string")
    objects = extraction.aspect_objects(outputs)
    assert rows(extraction.aspect_rows(objects), "aspect", "summary", "page") == [("findings", "only summary", 0), ("methods", "Sum", 0)]
    methods, evidence = extraction.method_rows(objects)
    assert rows(methods, "name", "description") == [("B", "Sum"), ("Sum", "")]
    assert rows(evidence, "extraction_field", "text") == [("method:B", "src"), ("method:Sum", "src")]
    claims, quotes = extraction.claim_rows(objects)
    assert rows(claims, "text") == [("only summary",)] and quotes.count() == 0
    assert rows(extraction.field_evidence(objects), "extraction_field", "text") == [("methods", " Sum ")]


def test_gold_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"arxiv_id":"1111.11111",\n"dna":{"claims":[{"text":""}],"methods":[{"source_text":"x"}]},'
        '"relations":[{"type":"nope","target_arxiv":"2222.22222"},{"type":"cites","target_arxiv":"2222.22222"},{"type":"cites"}],'
        '"citation_contexts":[{"gold_type":null}]}'
    )
    (tmp_path / "b.json").write_text('{"title":"x"}')
    items = gold.read_gold(spark, str(tmp_path))
    errors = rows(evaluation.gold_errors(items), "name", "error", "value")
    assert errors == sorted([
        ("a.json", "claim missing text", None), ("a.json", "invalid cite gold_type", None), ("a.json", "invalid relation type", "nope"),
        ("a.json", "method missing name", None), ("a.json", "relation missing target_arxiv", None), ("b.json", "missing arxiv_id", None)],
        key=lambda r: [str(x) for x in r])
    assert rows(evaluation.gold_counts(items)) == [(2, 1, 1, 3, 1)]
    versions = spark.createDataFrame([("1111.11111", 1), ("2222.22222", 2)], "arxiv_id string, work_id long")
    relations = spark.createDataFrame([(5, "cites")], "relation_id long, type string")
    members = spark.createDataFrame([(5, "source", 1), (5, "target", 2)], "relation_id long, role string, anchor_work_id long")
    cov = evaluation.relation_coverage(items, versions, relations, members)
    assert rows(cov, "item_no", "outcome") == [(0, "not found"), (1, "hit"), (2, "target unknown")]
    assert rows(evaluation.coverage_summary(cov)) == [(1, 3)]


def test_versions_to_read(spark):
    works = spark.createDataFrame([(1, None), (2, 21), (3, 31)], "work_id long, primary_version_id long")
    versions = spark.createDataFrame(
        [(10, 1, 2, "t", "a"), (11, 1, 1, "t", "a"), (20, 2, 1, "t", "a"), (21, 2, 2, "t", "a"), (31, 2, 1, "t", "a")],
        "version_id long, work_id long, created_at long, title string, abstract string")
    asked = spark.createDataFrame([(2, 20)], "work_id long, version_id long")
    assert rows(paper_text.chosen_versions(works, versions), "work_id", "version_id") == [(1, 11), (2, 21)]
    assert rows(paper_text.chosen_versions(works, versions, asked), "work_id", "version_id") == [(1, 11), (2, 20)]
    markup = spark.createDataFrame([(11, "p.html", "<p>" + "x" * 3000)], "version_id long, path string, html string")
    got = paper_text.read_sources(paper_text.chosen_versions(works, versions), markup, 10).orderBy("work_id").collect()
    assert [(r["source_kind"], r["original_chars"], r["truncated"], len(r["text"])) for r in got] == [
        ("html", 3000, True, 1000), ("metadata", 4, False, 4)]


def test_late_votes_do_not_win(spark, tmp_path):
    data = [(1, 1, "agree", 9), (2, 1, "disagree", 3), (1, 1, "disagree", 5), (2, 2, "agree", 8), (1, 2, "agree", 1)]
    for i, row in enumerate(data):
        one = spark.createDataFrame([(i, "relation", *row)], VOTE)
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = fresh_path(spark, "late")
    feeds.follow_reviews(stream, folder).awaitTermination()
    want = rows(consensus.relation_status(consensus.latest_reviews(votes(spark, data))))
    assert rows(feeds.live_status(spark, folder)) == want == [(1, "confirmed"), (2, "disputed")]


def test_votes_are_kept_by_an_aggregate(spark, tmp_path):
    spark.createDataFrame([(1, "relation", 1, 1, "agree", 9)], VOTE).write.parquet(str(tmp_path / "in"))
    following = feeds.follow_reviews(spark.readStream.schema(VOTE).parquet(str(tmp_path / "in")), fresh_path(spark, "plain"))
    following.awaitTermination()
    operators = [o.operatorName for o in following.lastProgress.stateOperators]
    assert operators == ["stateStoreSave"]


def test_live_status_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.randrange(6), rng.randrange(4), rng.choice(["agree", "disagree", "unsure"]), rng.randrange(30)) for _ in range(90)]
    folder = fresh_path(spark, "restarts")
    for i in range(0, 90, 30):
        part = [(n, "relation" if n % 7 else "claim", *row) for n, row in enumerate(data)][i : i + 30]
        for half in (part[:20], part[20:] + part[:5]):  # some votes are delivered twice
            spark.createDataFrame(half, VOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VOTE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        feeds.follow_reviews(stream, folder).awaitTermination()
        seen = spark.createDataFrame([(n, "relation" if n % 7 else "claim", *row) for n, row in enumerate(data)][: i + 30], VOTE)
        want = rows(consensus.relation_status(consensus.latest_reviews(seen)))
        assert rows(feeds.live_status(spark, folder)) == want and len(want) == 6


def test_changes_reach_only_works_near_them(spark, tmp_path):
    from evgraph.operators import similarity as sim

    chain = [(i, "improves_on", "unreviewed") for i in range(30)] + [(90, "improves_on", "rejected")]
    ends = [(i, "source", i) for i in range(30)] + [(i, "target", i + 1) for i in range(30)] + [(90, "source", 0), (90, "target", 29)]
    schema = "relation_id long, type string, review_status string"
    before = spark.createDataFrame(chain, schema)
    after = spark.createDataFrame([(i, k, "confirmed" if i == 10 else s) for i, k, s in chain], schema)
    members = spark.createDataFrame(ends, "relation_id long, role string, anchor_work_id long")
    stored = sim.lineage_neighbors(sim.lineage_edges(before, members))
    spark.createDataFrame([(10,), (11,)], "work_id long").write.parquet(str(tmp_path / "in"))
    folder = fresh_path(spark, "near")
    stream = spark.readStream.schema("work_id long").parquet(str(tmp_path / "in"))
    near = feeds.affected_by_lineage(lambda: before, lambda: after, lambda: members)
    feeds.follow_works(stream, feeds.refresh_lineage(lambda: after, lambda: members), folder, affected=near).awaitTermination()
    got = feeds.current_neighbors(spark, stored, folder)
    assert rows(got, "work_id", "neighbor_work_id", "score") == rows(sim.lineage_neighbors(sim.lineage_edges(after, members)))
    assert {r.work_id for r in near(spark.createDataFrame([(10,), (11,)], "work_id long")).collect()} == set(range(7, 15))


def test_results_applied_once_over_restarts(spark, tmp_path):
    schema = "batch_id string, custom_id string, seq long"
    folder, source = fresh_path(spark, "once"), str(tmp_path / "in")
    for wave in ([("b", "x", 1), ("b", "x", 2)], [("b", "x", 3), ("b", "y", 4), ("c", "x", 5)]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.follow_results(stream, folder).awaitTermination()
    got = rows(feeds.applied_results(spark, folder, schema), "batch_id", "custom_id")
    assert got == [("b", "x"), ("b", "y"), ("c", "x")]


def test_results_keep_every_column(spark, tmp_path):
    """Late and repeated rows, missing keys and numbers, quotes in texts, microseconds."""
    schema = "batch_id string, custom_id string, seq long, body string, at timestamp_ntz, cost double, n long"
    at = datetime.datetime(2024, 5, 6, 7, 8, 9, 123456)
    big = 2**53 + 1
    waves = [
        [("b", "x", 7, 'a "quoted"\nline', at, 0.1, big), ("b", "x", None, "no number", at, 0.2, None), (None, "y", 1, None, None, None, None)],
        [("b", "x", 9, "too late", at, 0.3, 1), (None, "y", 2, "again", at, None, 2), ("b", None, None, "p", None, None, None),
         ("b", None, None, "q", None, None, None), ("", "", 3, "", None, float("nan"), 0)],
    ]
    folder, source = fresh_path(spark, "columns"), str(tmp_path / "in")
    for wave in waves:
        spark.createDataFrame(wave, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        feeds.follow_results(stream, folder).awaitTermination()
    got = {tuple(r)[:2]: tuple(r)[2:7] for r in feeds.applied_results(spark, folder, schema).collect()}
    assert got.pop(("", ""))[:3] == (3, "", None)
    assert got == {
        ("b", "x"): (7, 'a "quoted"\nline', at, 0.1, big), (None, "y"): (1, None, None, None, None),
        ("b", None): (None, "q", None, None, None)}


def test_results_are_settled_in_the_state_store(spark, tmp_path):
    """No Python per key; numbers that a double can't tell apart; a key that was written twice stays as it was first."""
    schema = "batch_id string, custom_id string, seq long"
    big = 2**53
    folder, source = fresh_path(spark, "settled"), str(tmp_path / "in")
    for wave in ([("b", "x", -big), ("b", "x", -big - 1), ("b", "x", None)], [("b", "x", 5), ("b", "y", 1)], [("b", "y", 2)]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        stream = feeds.follow_results(spark.readStream.schema(schema).parquet(source), folder)
        stream.awaitTermination()
        assert [s["operatorName"] for s in stream.lastProgress["stateOperators"]] == ["stateStoreSave"]
    written = spark.read.schema(schema).parquet(f"{folder}/applied/batch=*")
    assert rows(written, "batch_id", "custom_id", "seq") == [("b", "x", -big), ("b", "y", 1)]
    spark.createDataFrame([("b", "y", 9)], schema).write.parquet(f"{folder}/applied/batch=7")
    assert rows(feeds.applied_results(spark, folder, schema), "batch_id", "custom_id", "seq") == [("b", "x", -big), ("b", "y", 1)]


def test_feed_and_cursors(spark, tmp_path):
    schema = "comment_id long, graph_id long, work_id long, user_id long, visibility string, updated_at long"
    rows_in = [(1, 1, 1, 5, "team", 10), (2, 1, 1, 5, "private", 11), (3, 1, 1, 6, "team", 3), (4, 2, 1, 6, "team", 99)]
    spark.createDataFrame(rows_in, schema).write.parquet(str(tmp_path / "in"))
    viewers = spark.createDataFrame([(5, 1, 5), (6, 1, 0)], "viewer_id long, graph_id long, since long")
    folder = fresh_path(spark, "feed")
    feeds.follow_comments(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), viewers, folder).awaitTermination()
    feed = feeds.comment_feed(spark, folder, schema + ", viewer_id long")
    assert rows(feed, "viewer_id", "comment_id") == [(5, 1), (5, 2), (6, 1), (6, 3)]
    assert rows(feeds.next_cursors(feed)) == [(5, 11), (6, 10)]


def test_feed_stores_a_comment_once_and_equals_the_pairs(spark, tmp_path, monkeypatch):
    """Two runs with viewers of their own, nulls, repeats and different cursors; nothing is stored per comment and member."""
    monkeypatch.setattr(feeds, "VIEWERS_AT_ONCE", 3)
    rng = random.Random(5)
    schema = "comment_id long, graph_id long, user_id long, visibility string, updated_at long"
    some = lambda *x: rng.choice([*x, None]) if rng.random() < 0.1 else rng.choice(x)
    folder, source, pairs, sent = fresh_path(spark, "feed"), str(tmp_path / "in"), [], 0
    for run in range(2):
        talk = [(1000 * run + i, some(1, 2, 3), some(*range(6)), some("team", "team", "private"), some(*range(50))) for i in range(60)]
        talk += talk[:5]
        uniform = [(v, g, v % 4 * 10) for v in range(20) for g in ((1, 2) if v % 2 else (1, 3))]
        mixed = [(some(*range(18, 24)), some(1, 2, 3), some(0, 20, 40)) for _ in range(25)]
        viewing = uniform + mixed + uniform[:3]
        viewers = spark.createDataFrame(viewing, "viewer_id long, graph_id long, since long")
        spark.createDataFrame(talk, schema).coalesce(1).write.mode("append").parquet(source)
        feeds.follow_comments(spark.readStream.schema(schema).parquet(source), viewers, folder).awaitTermination()
        sent += len(talk)
        pairs += [(v, t, c) for c, g, u, vis, t in talk for v, h, s in viewing
                  if None not in (g, t, s) and g == h and t > s and (vis == "team" or (u is not None and u == v))]
    assert spark.read.parquet(f"{folder}/comments/batch=*").count() == sent
    wanted = schema + ", viewer_id long"
    every = feeds.comment_feed(spark, folder, wanted)
    assert rows(every, "viewer_id", "updated_at", "comment_id") == sorted(pairs, key=lambda r: [str(x) for x in r])
    for k in (1, 4, 1000):
        newest = []
        for viewer in {p[0] for p in pairs}:
            newest += sorted((p for p in pairs if p[0] == viewer), key=lambda p: p[1:], reverse=True)[:k]
        got = feeds.comment_feed(spark, folder, wanted, k)
        assert rows(got, "viewer_id", "updated_at", "comment_id") == sorted(newest, key=lambda r: [str(x) for x in r])
    assert feeds.comment_feed(spark, fresh_path(spark, "nothing"), wanted, 3).collect() == []


def test_feed_of_a_table_in_several_files_or_without_rows(spark, tmp_path):
    turns = "conv_id long, turn long, role string, text string"
    query = registry.PLANS["i4_comment_feed"]
    for name, talk, want in (("parts", [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "user", "c")], {1001, 1002}), ("none", [], set())):
        folder = tmp_path / name
        spark.createDataFrame(talk, turns).repartition(3).write.parquet(f"{folder}/conversations.parquet")
        spark.createDataFrame([(1, 1, 0.0)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
        spark.createDataFrame([(1, 1, "n")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
        fed = query(Library(spark, str(folder)))
        assert {r["comment_id"] for r in fed.collect()} == want


def test_recall_prefers_strong_signals(spark):
    from evgraph.operators.relations import recall_candidates

    works = spark.createDataFrame([(i, i) for i in range(60)], "work_id long, created_at long")
    near = spark.createDataFrame([("citation_coupling", 1, 2, 0.05), ("topic", 1, 3, 0.9), ("aspect_theory", 1, 4, 0.99)],
                                 "dimension string, work_id long, neighbor_work_id long, score double")
    cites = spark.createDataFrame([(1, 5), (6, 1)], "citing_work_id long, cited_work_id long")
    projects = spark.createDataFrame([(1, 9), (7, 9)], "work_id long, project_id long")
    relations = spark.createDataFrame([(1, "improves_on", "confirmed"), (2, "cites", "confirmed")], "relation_id long, type string, review_status string")
    members = spark.createDataFrame([(1, "work", 1, "source"), (1, "work", 59, "target"), (2, "work", 1, "source"), (2, "work", 58, "target")],
                                    "relation_id long, entity_kind string, entity_id long, role string")
    out = recall_candidates(works, near, cites, projects, relations, members)
    got = [(r["neighbor_work_id"], r["score"]) for r in out.where("work_id = 1").orderBy(F.desc("score"), "neighbor_work_id").collect()]
    assert got[:4] == [(3, 0.9), (5, 0.55), (6, 0.5), (7, 0.2)]
    # 59 is related already, so the latest works start with 58; ties go by id
    assert got[4:] == [(i, 0.12) for i in range(12, 18)]
