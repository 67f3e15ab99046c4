"""Every catalogue query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from strandflow import catalog
from strandflow.registry import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(None if r[i] is None else float(r[i]) if isinstance(r[i], int | float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cursor = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm(df.collect(), df.columns) == norm(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_only_the_pool_claims_the_pool():
    assert {n for n, e in REGISTRY.items() if {"JON05", "STR10"} & {*e.implements}} == {"book_pool"}
