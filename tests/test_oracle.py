"""Every registered document query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from docsheaf.plans.catalogue import QUERIES
from docsheaf.plans.oracle import ORACLE_SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


def test_all_twins_belong_to_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)
    assert rows
    if name not in ORACLE_SQL:
        return
    want = duck.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: TYPES[t] for c, t in got.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
