"""Every registered query against its DuckDB oracle."""

import math

import duckdb
import pytest

from lakeglass.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(wanted)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
