"""Every registered query with SQL gives the same rows in DuckDB, over the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from cadentia import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "isoformat"):
            return x.isoformat()[:10]
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    out = plans.QUERIES[name](spark, sf_dir)
    got = normal([tuple(r) for r in out.collect()], out.columns)
    ran = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in ran.description]
    assert sorted(out.columns) == sorted(columns)
    assert got == normal(ran.fetchall(), columns)
