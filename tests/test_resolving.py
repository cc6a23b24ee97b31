"""A table of queries against one query at a time."""

from pyspark.sql import functions as F

from sedimenta.operators import companies
from sedimenta.operators.resolving import matches, resolve_all

NAMES = ["Ring Holdings", "ring", "Small Ring Co.", "Bearing & Ring, Inc", "STRING  theory", "Zürich Ré", "a", "Alpha-Beta Gamma", "alpha beta gamma", "", None, "Beta", "ta ga"]
QUERIES = [" Ring ", "ring", "ri", "g", "t-1", "T.2", "CIK 0000000003", "cik", "17", "0", "00", "12345678901", "9999999999", "beta gam", "ha beta ga", "alpha beta gamma", "beta gamma", "rich r", "ré", "&&&", "", "   ", None, "ring holdings x", "zz", "TA", "co", " ring ", "99999999999999999999999"]


def test_as_one_by_one(spark):
    rows = [(k, f"T.{k % 4}" if k % 5 else "", t) for k, t in enumerate(NAMES * 3)]
    directory = spark.createDataFrame(rows, "cik long, ticker string, title string")
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")
    top, answers = (x.cache() for x in resolve_all(directory, queries, 5))
    got_top, got = {}, {r["query_id"]: r.asDict() for r in answers.collect()}
    for r in top.collect():
        got_top.setdefault(r["query_id"], []).append((r["rank"], r["cik"], r["score"], r["matched_by"]))
    assert len(got) == len(QUERIES)
    # brute force: the rule for one query over all rows, without its plan
    for k, query in enumerate(QUERIES):
        q = companies.asked(query or "")
        fits = companies.candidates(directory, q).orderBy(*companies.order()).collect() if q and len(q) < 20 else []
        assert sorted(got_top.get(k, [])) == [(n + 1, r["cik"], r["score"], r["matched_by"]) for n, r in enumerate(fits[:5])], query
        assert got[k]["candidates_total"] == len(fits) and got[k]["query"] == q
    for k in (0, 4, 6, 8, 11, 12, 13, 20, 23):
        want = companies.resolve(directory, QUERIES[k], 5)[1].first().asDict()
        assert {c: got[k][c] for c in want} == want, QUERIES[k]


def test_empty(spark):
    directory = spark.createDataFrame([], "cik long, ticker string, title string")
    top, answers = resolve_all(directory, spark.createDataFrame([(1, "x")], "query_id int, query string"))
    assert top.count() == 0 and answers.first()["error"] == "no_match"


def test_no_nested_loop_over_the_directory(spark):
    directory = spark.range(5000).selectExpr("id cik", "concat('T', id) ticker", "concat('Company ', id) title")
    queries = spark.range(1000).selectExpr("id query_id", "concat('pany ', id) query")
    top, answers = resolve_all(directory, queries)
    assert answers.where("name is not null").count() == 1000
    found = matches(directory, queries.select(F.col("query").alias("q")))
    for df in (top, answers, found):
        assert "NestedLoop" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
