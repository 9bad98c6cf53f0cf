"""Every catalogue query with SQL against DuckDB over the smallest test tables."""

import datetime
import decimal
import itertools
import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.datetime | datetime.date) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.core.SQL))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_flagship_sums_in_the_order_of_keys(spark, tmp_path):
    """Half a unit or a little less by the order of the same four numbers: the orders' keys decide, not their places in files."""
    cases = list(itertools.permutations([2.8, 0.3, 0.1, 3.3]))
    want = sorted(7 if ((a + b) + c) + d >= 6.5 else 6 for a, b, c, d in cases)
    assert want.count(6) == want.count(7)
    customers = spark.createDataFrame([(i, f"c{i}", float(i), "A") for i in range(len(cases))], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")
    rows = [(4 * i + k, i, x) for i, c in enumerate(cases) for k, x in enumerate(c)]
    for n, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[2]))):
        customers.write.parquet(f"{tmp_path}/{n}/customer.parquet")
        spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_totalprice double").repartition(3).write.parquet(f"{tmp_path}/{n}/orders.parquet")
        out = entry.queries()["flagship"](spark, f"{tmp_path}/{n}").collect()
        assert sorted(r.total for r in out) == want and {r.n for r in out} == {4}
