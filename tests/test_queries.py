"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from sedimenta import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_batches_keep_order_and_limits(spark):
    from sedimenta.operators.fragments import batches

    got = batches(spark.createDataFrame([(1, k, 500 if k % 2 else 100) for k in range(20)], "d long, p long, n long"), "d", "p", "n").orderBy("p").collect()
    ids = [r["batch_id"] for r in got]
    assert ids == sorted(ids)
    for b in set(ids):
        own = [r["n"] for r in got if r["batch_id"] == b]
        assert len(own) <= 8 and sum(own) <= 1200


def test_forms(spark):
    from pyspark.sql import functions as F

    from sedimenta.functions.forms import matches_form

    df = spark.createDataFrame([("10-K",), ("10-K/A",), ("10-K405",), (" 10-k ",)], "f string")
    assert [r[0] for r in df.select(matches_form(F.col("f"), F.lit("10-K"))).collect()] == [True, True, False, True]
