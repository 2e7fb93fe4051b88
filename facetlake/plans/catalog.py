"""All registered queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetlake.plans import corpus, facets, files, rasters, scenes, streams

PARTS = (scenes, facets, rasters, corpus, files, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
