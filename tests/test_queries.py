import duckdb
import pytest

import __spark_entry__ as entry
from tests.helpers import rows
from tools.check_oracles import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = ["a2_reading_list_lines", "c1_resolved_works", "c8_merge_verdicts", "d2_work_cards", "e7_assertion_edges",
        "e12_overflow_groups", "f3_status_overrides", "g1_bibliographic_coupling", "g5_lineage_neighbors", "g6_aspect_neighbors",
        "h2_method_rows", "i1_live_status", "j2_relation_coverage"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, db, name):
    got = rows_of(entry.queries()[name](spark, SF).toPandas())
    assert got == rows_of(db.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["work_id", "neighbor_work_id", "score"]


def test_typed_load(spark, tmp_path):
    from evgraph.sources.tables import load

    data = spark.createDataFrame([(1, 2)], "work_id long, project_id long")
    data.write.parquet(str(tmp_path / "work_projects.parquet"))
    assert rows(load(spark, str(tmp_path), ["work_projects"])["work_projects"]) == [(1, 2)]
