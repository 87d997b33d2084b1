"""Operators take the tables as declared in `schemas.TABLES`: same names, timestamps as times, ids long or string."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from evgraph import schemas
from evgraph.operators import consensus, linkage, merge, reads
from evgraph.operators import relations as rel
from evgraph.operators import similarity as sim
from evgraph.sources import paper_text
from tests.helpers import rows

WORD_IDS = re.compile(r"`(\w*_id|created_by|created_by_user|added_by)` long")


class Declared:
    """Empty tables, as attributes."""

    def __init__(self, spark, kind):
        self.spark, self.kind = spark, kind

    def __getattr__(self, name):
        return self.spark.createDataFrame([], self.schema(name))

    def schema(self, name):
        return schemas.TABLES[name] if self.kind == "long" else WORD_IDS.sub(r"`\1` string", schemas.TABLES[name])


OPERATORS = {
    "search": lambda t: reads.search_works(t.works, t.versions, "x"),
    "authors": lambda t: reads.with_author_names(t.works, t.version_authors, t.authors),
    "shown": lambda t: reads.with_shown_version(t.works, t.versions),
    "claims": lambda t: reads.claims_listed(t.claims, t.evidence_spans, t.claim_judgments, t.reviews),
    "evidence": lambda t: reads.evidence_of_works(t.evidence_spans, t.versions, t.claims, t.relation_members),
    "groups": lambda t: reads.groups_of_users(t.research_groups, t.group_members, t.graphs),
    "graphs": lambda t: reads.graphs_of_groups(t.research_groups, t.graphs, t.graph_works),
    "members": lambda t: reads.members_listed(t.group_members, t.users),
    "reading": lambda t: reads.reading_listed(t.reading_status),
    "threads": lambda t: reads.comment_threads(t.node_comments),
    "comments": lambda t: reads.comments_with_authors(t.node_comments, t.users, "1"),
    "annotations": lambda t: reads.annotation_counts(t.annotations),
    "votes": lambda t: consensus.relation_status(consensus.latest_reviews(t.reviews)),
    "disputes": lambda t: consensus.judgment_disputes(t.claim_judgments, t.reviews),
    "claim_disputes": lambda t: consensus.propagate_claim_disputes(t.claims, t.claim_judgments, t.reviews),
    "citations": lambda t: sim.citation_neighbors(t.citations),
    "lineage": lambda t: sim.lineage_neighbors(sim.lineage_edges(t.relations, t.relation_members)),
    "aspects": lambda t: sim.aspect_neighbors(t.embeddings),
    "blend": lambda t: sim.blend(t.neighbors, {"topic": 1}, topic=True),
    "one_dimension": lambda t: sim.single_dimension(t.neighbors, "topic"),
    "recall": lambda t: rel.recall_candidates(
        t.works, t.neighbors, t.citations, t.work_projects, t.relations, t.relation_members),
    "queue": lambda t: rel.review_queue(t.relations, t.relation_members),
    "grounding": lambda t: rel.ground_evidence(
        t.evidence_spans, t.versions.select("version_id", F.lit(1).alias("page"), F.lit(0).alias("segment_no"), F.lit("a").alias("text"))),
    "primary": lambda t: linkage.repair_primary(t.works, t.versions),
    "versions_read": lambda t: paper_text.chosen_versions(t.works, t.versions),
}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_operators_on_declared_tables(spark, kind):
    tables = Declared(spark, kind)
    failed = {}
    for name, build in OPERATORS.items():
        try:
            assert build(tables).collect() == []
        except Exception as error:  # noqa: BLE001 - all names that fail are reported at once
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
    assert failed == {}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_recall_by_time(spark, kind):
    """The latest works come first, by timestamp, then by id; ids are only compared."""
    tables = Declared(spark, kind)
    name = int if kind == "long" else (lambda i: f"w{i}")
    day = lambda i: datetime.datetime(2024, 1, 1 + i)
    moments = [(1, 0), (2, 3), (3, 3), (4, 9), (5, 1)]
    works = spark.createDataFrame([(name(i), f"t{i}", None, None, day(d)) for i, d in moments], tables.schema("works"))
    near = spark.createDataFrame([("citation_coupling", name(1), name(2), 0.9)],
                                 tables.schema("neighbors"))
    got = rel.recall_candidates(
        works, near, tables.citations, tables.work_projects, tables.relations, tables.relation_members, k=4, recent=2)
    mine = [r for r in rows(got, "work_id", "neighbor_work_id") if r[0] == name(1)]
    assert mine == [(name(1), name(2)), (name(1), name(3)), (name(1), name(4))]
