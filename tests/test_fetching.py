"""Fetching: pauses that hold for a host over all tasks, one request each, restarts, and concept answers up to a report."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F


def _noting(folder, answer=lambda url: b"x" * 300):
    """A transport that notes every request in a file; answer gives the body, or None for not found."""

    def get(url):
        from sedimenta.sources.fetch import Answer

        with open(f"{folder}/{time.time_ns()}-{os.urandom(4).hex()}", "w") as f:
            f.write(url)
        body = answer(url)
        return Answer(404) if body is None else Answer(200, iter([body]))

    return get


def _asked(folder):
    return [(int(n.split("-")[0]) / 1e9, open(f"{folder}/{n}").read()) for n in sorted(os.listdir(folder))]


def test_pauses_hold_for_a_host_over_all_tasks(spark, tmp_path):
    from sedimenta.sources.fetch import fetched

    urls = [(f"https://h{k % 3}/{k}",) for k in range(24)]
    df = spark.createDataFrame(urls, "url string").repartition(8)
    assert fetched(df, "url", _noting(str(tmp_path)), pause=0.1).where("error_kind is null").count() == 24
    for h in range(3):
        at = [t for t, u in _asked(tmp_path) if u.startswith(f"https://h{h}/")]
        assert len(at) == 8 and all(b - a >= 0.095 for a, b in zip(at, at[1:], strict=False))


def test_each_filing_is_asked_for_once(spark, tmp_path):
    from sedimenta.operators.runs import made

    new = spark.createDataFrame([(f"{k % 4}", f"{k}-1", "8-K", "2024-01-01", "a.htm") for k in range(10)], "cik string, accn string, form string, date string, primary string")
    answer = lambda url: None if "/31/" in url else b"<p>short" if "/51/" in url else b"<p>" + b"word " * 80
    rows = {r["accn"]: r for r in made(new, _noting(str(tmp_path), answer)).collect()}
    assert len(_asked(tmp_path)) == 10 and {a: r["outcome"] for a, r in rows.items() if r["outcome"] != "made"} == {"3-1": "failed", "5-1": "failed"}
    assert (rows["3-1"]["why"], rows["5-1"]["why"]) == ("notfound", "too short") and all((r["html"] is None) == (r["outcome"] == "failed") for r in rows.values())


def test_answers_that_are_kept_are_not_asked_for_again(spark, tmp_path):
    from sedimenta.sources.fetch import fetched

    (tmp_path / "n").mkdir()
    df = spark.createDataFrame([("https://a/1",), ("https://a/1",), ("https://a/2",), (None,), ("https://b/none",)], "url string")
    go = lambda: sorted(str(tuple(r)) for r in fetched(df, "url", _noting(str(tmp_path / "n"), lambda u: None if "none" in u else b"b\n" + u.encode()), pause=0, kept=str(tmp_path / "k")).collect())
    first = go()
    assert len(_asked(tmp_path / "n")) == 3 and go() == first and len(_asked(tmp_path / "n")) == 3


def test_a_stream_of_urls_asks_for_nothing_twice(spark, tmp_path):
    """Two drops of URLs, some again; the first run dies at one URL and is started anew."""
    from sedimenta.streaming.fetching import answers, follow

    (tmp_path / "n").mkdir()
    folder, dead = str(tmp_path / "f"), str(tmp_path / "dead")

    def answer(url):
        if url.endswith("/5") and not os.path.exists(dead):
            open(dead, "w").close()
            os._exit(1)
        return url.encode()

    def drop(ks):
        spark.createDataFrame([(f"https://h/{k}",) for k in ks], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        q = follow(spark.readStream.schema("url string").parquet(str(tmp_path / "in")), folder, _noting(str(tmp_path / "n"), answer), pause=0)
        q.awaitTermination()

    drop(range(8))
    with pytest.raises(Exception, match="."):
        run()
    before = len(_asked(tmp_path / "n"))
    run()
    drop([3, 9, 9])
    run()
    run()
    asked = [u for _, u in _asked(tmp_path / "n")]
    assert before >= 1 and sorted(set(asked)) == sorted(f"https://h/{k}" for k in (*range(8), 9)) and len(asked) == len(set(asked)) + 1  # the one on its way
    rows = answers(spark, folder).load().collect()
    assert {r["url"]: bytes(r["body"]).decode() for r in rows} == {u: u for u in set(asked)} and len(rows) == 9


def test_concept_answers_become_a_report(spark, tmp_path):
    """Two companies: one reports two years and quarters, one lacks a tag and gives a broken answer for another."""
    from sedimenta.operators import facts, runs

    (tmp_path / "n").mkdir()
    defs = facts.definitions(spark, [("revenue", "duration", "USD", ["Revenues", "SalesRevenueNet"]), ("cash", "instant", "USD", ["Cash"])])

    def answer(url):
        tag, cik = url.rsplit("/", 1)[1], int(url.split("CIK")[1][:10])
        fact = lambda start, end, val, filed: {"start": start, "end": end, "val": val, "accn": "a", "fy": 2024, "fp": "FY", "form": "10-K", "filed": filed}
        if tag == "Revenues.json":
            return None if cik == 2 else json.dumps({"units": {"USD": [fact("2022-01-01", "2022-12-31", 5_000_000, "2023-02-01"), fact("2023-01-01", "2023-12-31", 7_000_000, "2024-02-01"), fact("2023-01-01", "2023-12-31", 7_500_000, "2024-03-01")]}}).encode()
        if tag == "Cash.json":
            return b"<html>busy</html>" if cik == 2 else json.dumps({"units": {"USD": [fact(None, "2023-12-31", 3_000_000, "2024-02-01")]}}).encode()
        return None

    shown, summary = runs.metrics(spark.createDataFrame([(1,), (2,)], "cik long"), _noting(str(tmp_path / "n"), answer), definitions=defs)
    rows = shown.where("cik = 1").orderBy("metric", F.desc("end")).collect()
    assert [(r["metric"], r["end"], r["text"]) for r in rows] == [("cash", "2023-12-31", "3"), ("revenue", "2023-12-31", "7.5"), ("revenue", "2022-12-31", "5")]
    info = {(r["cik"], r["metric"]): r for r in summary.collect()}
    assert info[1, "revenue"]["available"] and info[1, "revenue"]["tag"] == "Revenues" and not info[2, "cash"]["available"]
    assert "never reported" in info[2, "revenue"]["why"] and "no JSON" in info[2, "cash"]["why"]
    assert len(_asked(tmp_path / "n")) == 6


def test_an_increment_whose_publication_fails_takes_nothing_twice(spark, tmp_path):
    from sedimenta.operators import updates as u
    from sedimenta.sources.state import Versions
    from sedimenta.streaming.increments import step, taken_log

    subs, log, seen = Versions(spark, str(tmp_path / "subs")), taken_log(spark, str(tmp_path / "taken")), []
    subs.publish(u.subscriptions(spark.createDataFrame([("1",)], "cik string").withColumns({"seen_upto_date": F.lit("2023-01-01"), "first_run_done": F.lit(True)})))
    rows = spark.createDataFrame([("1", f"1-{k}", "8-K", f"2024-01-0{k}", k) for k in range(1, 4)], "cik string, accn string, form string, date string, pos long")

    def take(new):
        got = sorted(r["accn"] for r in new.collect())
        seen.append(got)
        return new.where("accn <> '1-2'").select("cik", "accn")

    publish = subs.publish
    subs.publish = lambda *a, **b: "disk full"
    with pytest.raises(RuntimeError, match="disk full"):
        step(rows, subs, take, log, 1)
    subs.publish = publish
    step(rows, subs, take, log, 1)
    assert seen == [["1-1", "1-2", "1-3"], ["1-2"]]
    assert sorted(subs.load().first()["seen"]) == ["1-1", "1-3"]
    step(rows, subs, lambda new: new.select("cik", "accn"), log, 2)
    assert sorted(subs.load().first()["seen"]) == ["1-1", "1-2", "1-3"]
