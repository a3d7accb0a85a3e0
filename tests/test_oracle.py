"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from feedloom.plans.oracles import SQL
from feedloom.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


# Its vectors come from a randomized factoring; tests/test_latent.py compares them with a plain one.
WITHOUT_SQL = {"embed_latent"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), con, SQL[name]) is None


def test_every_text_has_a_vector(spark, con):
    rows = QUERIES["embed_latent"](spark, SF_DIR).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents WHERE text <> ''").fetchone()[0] + sum(r.dim < 1 for r in rows)
    assert {r.length for r in rows if r.dim > 0} <= {0.0, 1.0}


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_id", "score"]
