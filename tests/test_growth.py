"""What a task of library queries reads does not grow with rows that have no part in the result."""

import re

FILES = "path string, mode string, size long, sha256 string"
RECORD = "cik string, accn string, status string, original_path string, output_path string, dir string"


def _exchanges(df) -> str:
    return df._jdf.queryExecution().toString()


def test_status_has_parts_for_its_rows(spark, monkeypatch):
    from sedimenta.operators import library

    monkeypatch.setattr(library, "PART_ROWS", 1)
    rec = spark.createDataFrame([("0000000001", "0000000001-26-000001", "complete", "/b/A.epub", "/b/z.epub", "/w")], RECORD)
    inv = spark.createDataFrame([(p, "file", 1, "h") for p in ["/b/a.epub", "/b/z.epub", "/b/q.epub.tmp", *(f"/x/{k}" for k in range(60))]], FILES)
    got = library.library_status(rec, inv)
    assert re.search(r"hashpartitioning\(low#\d+, 63\), REPARTITION_BY_NUM", _exchanges(got)) or re.search(r"hashpartitioning\(low#\d+, 64\), REPARTITION_BY_NUM", _exchanges(got))
    r = got.first()
    assert (r["original_present"], r["output_present"], r["blocked"]) == (False, True, "path in another case")


def test_files_outside_records_do_not_meet_in_one_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sedimenta.operators import library

    seen = []
    monkeypatch.setattr(library, "deletion_order", lambda files: seen.append(files) or files.withColumn("place", F.lit(1)))
    rec = spark.createDataFrame([("0000000001", "0000000001-26-000001", "/w/0000000001/0000000001-26-000001", None, "missing", "/b/x", "/b/y")], "cik string, accn string, dir string, blocked string, presence string, original_path string, output_path string")
    inv = spark.createDataFrame([("/w/0000000001/0000000001-26-000001/page.htm", "file", 1, "a"), *((f"/b/{k}.epub", "file", 1, "b") for k in range(9))], FILES)
    assert [r["path"] for r in library.cleaning_plan(rec, inv, rec.select("cik", "accn"))[0].collect()] == ["/w/0000000001/0000000001-26-000001/page.htm"]
    assert "NOT (dir" in _exchanges(seen[0])


def test_lost_contents_are_met_before_owned_paths(spark):
    from sedimenta.operators import library

    files = spark.createDataFrame([("/a", "1"), ("/B", "1"), ("/c", "2"), ("/d", "9")], "path string, sha256 string")
    lost = spark.createDataFrame([("c", "a1", "1"), ("c", "a2", "2"), ("c", "a3", "3")], "cik string, accn string, sha256 string")
    owned = spark.createDataFrame([("/b",), ("/b",), ("/C",)], "path string")
    df = library.relink(files, lost, owned)
    assert {r["accn"]: (r["paths"], r["error"]) for r in df.collect()} == {"a1": (["/a"], None), "a2": ([], "not found"), "a3": ([], "not found")}
    assert "LeftAnti" not in _exchanges(df)


def test_facts_are_dealt_once_by_keys(spark, monkeypatch):
    """Periods and counts take one shuffle of the facts, and none by tag, of which there are a few for all companies."""
    from sedimenta.operators import facts

    tables = []
    monkeypatch.setattr(facts, "written", lambda df, name: tables.append(df) or df)
    raw = [(1, "Cash", "USD", None, "2024-03-31", 5, "a", "2024-05-01", 0), (1, "Cash", "USD", None, "2024-03-31", 6, "b", "2024-06-01", 1), (1, "Cash", "USD", None, "2024-03-31", 6, "c", "2024-07-01", 2), (1, "Cash", "EUR", None, "2024-06-30", 7, "a", "2024-05-01", 3), (2, "Cash", "EUR", None, "2024-03-31", None, "a", "2024-05-01", 0)]
    rows = spark.createDataFrame(raw, "cik long, tag string, unit string, start string, end string, val long, accn string, filed string, pos long")
    defs = facts.definitions(spark, [("cash", "instant", "USD", ["Cash"]), ("revenue", "duration", "USD", ["Revenues"])])
    got, info = facts.periods(rows.join(defs, "tag"), ["cik", "tag"])
    plan = tables[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?<!Broadcast)Exchange ", plan)) == 1 and re.search(r"Exchange hashpartitioning\(cik#\d+L, tag#\d+, ", plan)
    assert [(r["cik"], r["accn"], r["val"], r["prev"], r["folded"], r["revised"], r["period_pos"]) for r in got.collect()] == [(1, "c", 6, 5, 2, True, 1)]
    assert sorted((r["cik"], r["unit"], r["entries"], r["skipped"], r["periods"], r["error"]) for r in info.collect()) == [(1, "USD", 3, 0, 1, None), (2, "EUR", 1, 1, 0, "no period")]


def test_days_of_odd_dates(spark):
    from pyspark.sql import functions as F

    from sedimenta.functions.dates import day

    texts = ["2024-02-29", "2023-02-29", "2026-13-01", "0000-01-01", "0001-01-01", "2024-01-01\n", " 2024-01-01", "2024-1-1", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(day(F.col("x")).cast("string")).collect()]
    assert got == ["2024-02-29", None, None, "0000-01-01", "0001-01-01", *[None] * 5]
