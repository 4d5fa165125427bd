"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

from axialis.plans import queries as Q
from axialis.plans import registry


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", list(registry.SQL))
def test_rows_agree(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert (got == want).all().all()


def test_euler(spark, sf_dir):
    n = Q.neighbor_counts(spark, sf_dir).groupBy("image_id").agg({"n_neighbours": "sum", "id": "count"}).collect()
    for row in n:
        edges, points = row[1] / 2, row[2]
        assert edges <= 3 * points - 6


def test_persistence_has_one_component(spark, sf_dir):
    rows = Q.persistence(spark, sf_dir).where("dim = 0 and death = double('inf')").groupBy("image_id").count().collect()
    assert rows and all(r[1] == 1 for r in rows)
