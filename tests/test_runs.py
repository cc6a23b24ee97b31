"""Whole runs against files, searches of a session, books and their checks."""

import datetime as dt
import json

from pyspark.sql import functions as F


def test_a_run_from_subscriptions_to_books(spark, tmp_path):
    """Two companies: one document is missing; its company's baseline stays and it is new again in the next run."""
    from sedimenta.operators import runs
    from sedimenta.operators import updates as u
    from sedimenta.sources.fetch import file_transport
    from sedimenta.sources.state import Versions

    def put(cik, accn, name, body):
        d = tmp_path / "web" / "www.sec.gov" / "Archives" / "edgar" / "data" / str(cik) / accn.replace("-", "")
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(body)

    page = "<html><body><script>x</script><p>" + "word " * 80 + "</p></body></html>"
    put(1, "1-1", "a.htm", page)
    put(1, "1-2", "a.htm", page)
    put(2, "2-1", "b.htm", page)
    put(2, "2-3", "b.htm", "short")
    rows = [("1", "1-1", "8-K", "2024-01-01", "a.htm", 0), ("1", "1-2", "8-K", "2024-01-02", "a.htm", 1), ("2", "2-1", "10-Q", "2024-01-03", "b.htm", 0), ("2", "2-2", "10-Q", "2024-01-04", "b.htm", 1), ("2", "2-3", "10-Q", "2024-01-05", "b.htm", 2)]
    listing = spark.createDataFrame(rows, "cik string, accn string, form string, date string, primary string, pos long")
    subs = Versions(spark, str(tmp_path / "subs"))
    subs.publish(u.subscriptions(spark.createDataFrame([("1",), ("2",), ("3",)], "cik string").withColumn("seen_upto_date", F.lit("2023-01-01"))))
    n = []

    def keep(outcomes):
        n.append(1)
        outcomes.write.parquet(str(tmp_path / f"books{len(n)}"))
        return spark.read.parquet(str(tmp_path / f"books{len(n)}"))

    got, info = runs.run(listing, subs, file_transport(str(tmp_path / "web")), keep, have=spark.createDataFrame([("0000000001", "1-1")], "cik string, accn string"))
    out = {r["accn"]: r for r in got.collect()}
    assert {a: (r["outcome"], r["why"]) for a, r in out.items()} == {"1-1": ("reused", None), "1-2": ("made", None), "2-1": ("made", None), "2-2": ("failed", "notfound"), "2-3": ("failed", "too short")}
    assert out["1-2"]["html"].startswith("<p>word") and out["2-2"]["html"] is None
    assert tuple(info.first()) == (6, 2, 1, 1, 2, 0, sum(r["bytes"] for r in out.values()))
    state = {r["cik"]: r for r in subs.load().collect()}
    assert state["0000000001"]["seen_upto_date"] == "2024-01-02" and state["0000000002"]["seen_upto_date"] == "2023-01-01" and state["0000000002"]["seen"] == ["2-1"]
    put(2, "2-2", "b.htm", page)
    put(2, "2-3", "b.htm", page)
    got, info = runs.run(listing, subs, file_transport(str(tmp_path / "web")), keep)
    assert sorted((r["accn"], r["outcome"]) for r in got.collect()) == [("2-2", "made"), ("2-3", "made")]
    assert {r["cik"]: r["seen_upto_date"] for r in subs.load().collect()}["0000000002"] == "2024-01-05"


def test_a_search_of_a_session(spark):
    from sedimenta.operators.runs import Search

    calls = []
    directory = spark.createDataFrame([(1, "A", "Acme Corp"), (2, "ACM", "Acme Other")], "cik long, ticker string, title string")
    forms = ["10-K", "10-Q", "10-K/A", "8-K"]
    body = json.dumps({"name": "Acme", "filings": {"recent": {"form": forms, "filingDate": ["2024-05-01", "2024-04-01", "2023-01-01", "2010-01-01"], "accessionNumber": list("abcd")}}})

    def sources(cik):
        calls.append(cik)
        return spark.createDataFrame([(cik, 0, "main", None, body, None)], "cik long, source_pos int, name string, filing_to string, body string, error string")

    s = Search(directory, sources, dt.date(2024, 6, 30))
    assert [r["cik"] for r in s.start("acme").orderBy("rank").collect()] == [1, 2] and s.answer.first()["tie"]
    assert [r["form"] for r in s.load(1).orderBy("rank").collect()] == ["10-K", "10-Q", "10-K/A"]
    assert [r["form"] for r in s.refilter(1, forms=["10-K"], amendments=False).collect()] == ["10-K"] and len(calls) == 1
    assert s.refilter(1, since="2009-01-01").count() == 4 and len(calls) == 2
    assert s.refresh(1).count() == 4 and len(calls) == 3
    assert s.start("none such").count() == 0 and s.answer.first()["error"] == "no_match" and s.entries is None
    assert s.start(" ").count() == 0 and s.answer.first()["error"] == "empty"
    s.start("CIK 77")
    assert (s.answer.first()["cik"], s.answer.first()["error"], s.answer.first()["name_source"]) == ("0000000077", None, "unknown")


def test_jobs_of_old_generations(spark):
    """A new job of a name cancels those before; late results are known by their number."""
    from sedimenta.operators.runs import Generations, traced

    cancelled = []
    g = Generations(spark, "look")
    g.cancel = cancelled.append
    one = g.start()
    two = g.start()
    assert g.current(two) and not g.current(one) and cancelled == ["look-1"] and "look-2" in spark.getTags() and "look-1" not in spark.getTags()
    g.stop()
    assert not g.current(two) and cancelled == ["look-1", "look-2"] and "look-2" not in spark.getTags()
    df, seen = traced(spark.range(5), "plan")
    df.count()
    assert seen.get == {"stage": "plan", "rows": 5}


def test_books(spark):
    from sedimenta.operators import books as b

    entries = spark.createDataFrame([("x", 0, "mimetype", True, 20), ("x", 1, "c.html", False, 9), ("x", 2, "i.png", False, 0), ("y", 0, "c.html", False, 9), ("y", 1, "t.ncx", False, 9)], "book string, pos int, name string, stored boolean, size long")
    items = spark.createDataFrame([("x", "c", "c.html", "application/xhtml+xml", None), ("x", "i", "i.png", "image/png", "cover"), ("x", "i", "gone.png", "image/png", None), ("y", "t", "t.ncx", "x", "toc")], "book string, id string, name string, media_type string, role string")
    content = spark.createDataFrame([("x", "c.html", "c.html#a", 5000), ("x", "c.html", "no.html#b", 5000), ("y", "t.ncx", "c.html", 10)], "book string, name string, target string, chars long")
    got = {(r["book"], r["fault"], r["name"]) for r in b.structure(entries, items, content).collect()}
    assert got == {("x", "listed but missing", "gone.png"), ("x", "empty", "i.png"), ("x", "id is not unique", "gone.png"), ("x", "no toc", None), ("x", "target is missing", "no.html"), ("y", "mimetype is not first and stored", "c.html"), ("y", "no cover", None), ("y", "no content", None), ("y", "short", "t.ncx")}
    listed = spark.createDataFrame([("x", 0, "images/a b.png", "image/png", ""), ("x", 1, "images/a_b.png", "image/png", ""), ("x", 2, "images/1.png", "image/png", "1")], "book string, pos int, href string, media_type string, id string")
    disk = listed.select("book", "href").withColumn("size", F.lit(5))
    assert [r["id"] for r in b.manifest(listed, disk)[0].orderBy("pos").collect()] == ["images_a_b.png", "images_a_b.png-2", "i1"]
    assert b.wrapped("CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents") == ["CashCashEquivalentsRestricted", "CashAndRestrictedCashEquivalents"] and b.wrapped("Short") == ["Short"]
    meta = F.create_map(*(F.lit(x) for kv in {"percent_finished": "0.5", "font": "a", "bookmarks": "b", "last_percent": "0.4", "stats": "s"}.items() for x in kv))
    row = spark.range(1).select(b.kept_progress(meta), b.kept_progress(meta, notes=True), b.old_progress(meta), b.has_contact(F.lit("x a.b@c.org")), b.has_contact(F.lit("x@y"))).first()
    assert (row[0], row[1], row[2], row[3], row[4]) == ({"font": "a"}, {"font": "a", "bookmarks": "b"}, 0.5, True, False)
    records = spark.createDataFrame([("1", "a", "s"), ("2", "a", "s"), ("3", "a", "s")], "cik string, accn string, source_hash string")
    receipts = spark.createDataFrame([("1", "a", "relink", "s", "/p", 2), ("1", "a", "rebuild", "s", "/q", 1), ("2", "a", "relink", "old", "/p", 1)], "cik string, accn string, kind string, source_hash string, path string, given int")
    assert {r["cik"]: (r["repair"], r["repair_path"]) for r in b.repair_offers(records, receipts).collect()} == {"1": ("relink", "/p"), "2": ("stale", None), "3": (None, None)}
