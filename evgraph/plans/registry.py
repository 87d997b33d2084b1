"""Named queries: a Spark plan over the bound tables, and the same result in SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from evgraph.plans.oracle_views import oracle
from evgraph.sources.bindings import Library

PLANS: dict[str, Callable[[Library], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        PLANS[name] = plan
        if sql is not None:
            STATEMENTS[name] = oracle(sql)
        return plan

    return register


def load_all() -> None:
    from evgraph.plans import (  # noqa: F401
        consensus_queries,
        extraction_queries,
        ingest_queries,
        reading_queries,
        relation_queries,
        similarity_queries,
        stream_queries,
        text_queries,
    )
