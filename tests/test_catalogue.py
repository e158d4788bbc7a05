"""Every registered query against the same query in SQL, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lodestar.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(entry.queries()[name](spark, sf_dir), entry.oracle_sql()[name])


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("order", "customer"), [("true", "true"), ("false", "true"), ("true", "false")])
def test_affected_rows_count_every_customer(order, customer, spark, tmp_path):
    """Customers who never ordered, twice the same and one without a key; orders of strangers, without a key, at 10**9 and below zero."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT k::BIGINT AS c_custkey FROM (VALUES (0), (1), (1), (2), (7), (NULL)) x(k) WHERE {customer}")
    con.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_orderkey, c::BIGINT AS o_custkey, 'F' AS o_orderstatus, p::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM (VALUES (-1, 0, 250000), (0, 0, 150000), (1, 1, 5), (1000000001, 1, 300000), (1000000002, 9, NULL), (5, NULL, 250000), (NULL, 2, 250000)) x(k, c, p) WHERE {order}")
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    found = entry.queries()["affected_rows"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == con.execute(entry.oracle_sql()["affected_rows"]).fetchall()
