"""Every registered query of the library's own operators against its DuckDB twin."""

import math

import duckdb
import pytest
from facetlake.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "-"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):  # a column of whole numbers with nulls comes as floats from one engine
        return str(int(v)) if v.is_integer() else repr(round(v, 6) + 0.0)
    return str(v)


def rows(frame, columns):
    return sorted("|".join(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
