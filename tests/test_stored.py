"""Stored neighbour lists are built once for a session and input folder."""

from evgraph.plans import similarity_queries as sq
from evgraph.sources.bindings import Library


def test_built_once_and_equal_to_the_builder(spark):
    t = Library(spark, "/root/testdata/sf0.001")
    first = sq.stored_neighbors(t, "method_lineage")
    assert sq.stored_neighbors(Library(spark, "/root/testdata/sf0.001"), "method_lineage") is first
    built = sq._BUILDERS["method_lineage"](t)
    assert first.count() == built.count()
    assert first.select("work_id", "neighbor_work_id").exceptAll(built.select("work_id", "neighbor_work_id")).isEmpty()
