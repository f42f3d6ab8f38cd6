"""Name -> query and name -> DuckDB SQL for the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from quillgraph.plans import clinical_queries, curation_queries, evidence_queries, graph_queries, ingest_queries, prepare_queries, retrieval_queries, store_queries, stream_queries, tabular_queries  # noqa: E402, F401
