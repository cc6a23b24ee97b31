"""What SQL cannot express: text protection, markup, tables, references, sources, state and streams."""

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def test_dates_and_names(spark):
    from sedimenta.functions import dates, forms, text

    assert dates.years_before(dt.date(2024, 2, 29), 1) == "2023-02-28" and dates.years_before(dt.date(2024, 2, 29), 4) == "2020-02-29"
    rows = [("2026-02-31",), ("2024-1-1",), (None,), ("2024-01-31",)]
    got = spark.createDataFrame(rows, "d string").select(dates.is_date(F.col("d")), dates.day(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(True, None), (False, None), (False, None), (True, "2024-01-31")]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.pad_cik(F.lit(x))) for x in ("0", "CIK 320193", "10000000000", "9999999999", "32a")] == [None, "0000320193", None, "9999999999", None]
    assert [one(text.watch_cik(F.lit(x))) for x in ("0", "cik 3 2", "12345678901", "x")] == ["0000000000", "0000000032", None, None]
    assert one(text.utf8_trimmed(F.lit("aé€b"), 3)) == "aé…" and one(text.utf8_trimmed(F.lit("aé€b"), 2)) == "a…" and one(text.utf8_trimmed(F.lit(None).cast("string"), 2)) == ""
    assert one(text.key_values(F.lit("a=1\nbad line\nb=x=y\na=2"))) == {"a": "2", "b": "x=y"}
    assert one(text.file_part(F.lit(" a/b:\tc... "), "x")) == "a-b- c" and one(text.file_part(F.lit(".."), "x")) == "x"
    assert one(forms.in_forms(F.lit(" 10-q/A "), F.array(F.lit("10-Q")))) and not one(forms.in_forms(F.lit("10-Q/A"), F.array(F.lit("10-Q")), exact=True))
    assert [one(forms.legacy_view(F.lit(f))) for f in ("10-K", "8-K", "4")] == [False, True, True] and not one(forms.legacy_view(F.lit("8-K/A"), only_8k=True))


def test_filters_refuse_what_cannot_be_meant():
    from sedimenta.operators.filings import Filter

    assert Filter(forms="10-k ").wanted == ["10-k "] and Filter(forms=[" 10-k ", "", 3]).wanted == ["10-K"]
    for bad in ({"since": "2024-1-1"}, {"until": "x"}, {"limit": 0}, {"amendments": "some"}, {"mode": "fuzzy"}, {"max_total": 0}, {"forms": 3}):
        with pytest.raises(ValueError):
            Filter(**bad)


def test_menu_counts_with_blank_forms(spark):
    from sedimenta.operators.filings import menu_counts

    df = spark.createDataFrame([("10-K", 3), ("10-K/A", 2), ("10-K405", 5), ("", 1), ("*", 7)], "form string, n long")
    assert {r["form"]: r["n_menu"] for r in menu_counts(df).collect()} == {"10-K": 5, "10-K/A": 2, "10-K405": 5, "": 18, "*": 18}


def test_unreadable_dates_do_not_end_a_report(spark):
    from sedimenta.operators.facts import recent

    rows = [(1, "g", "2024-01-01"), (1, "g", "2026-02-31x"), (1, "g", "2020-12-27"), (1, "g", "2020-12-26"), (2, "g", "n/a"), (2, "g", "2020-01-01")]
    got = recent(spark.createDataFrame(rows, "k long, g string, d string").where("d <> '2026-02-31x' or k = 2"), ["k"], "g", "d", 1100, 9, []).collect()
    assert sorted((r["k"], r["d"]) for r in got) == [(1, "2020-12-27"), (1, "2024-01-01"), (2, "2020-01-01"), (2, "n/a")]


def test_a_batch_is_frozen_resumed_and_committed(spark):
    """Twelve filings, five at once: one is completed, four are left; the baseline moves with the last of all."""
    from sedimenta.operators import updates as u

    rows = [("1", f"a{k:02}", "10-K", f"2024-01-{k + 1:02}", k) for k in range(12)]
    listing = u.normalized(spark.createDataFrame(rows, "cik string, accession_number string, formType string, filingDate string, pos long"))
    subs = u.subscriptions(spark.createDataFrame([("CIK1", ["a00"], True)], "cik string, seen array<string>, first_run_done boolean"))
    # state is published between steps, as plans grow with every one
    kept = lambda *dfs: [spark.createDataFrame(df.collect(), df.schema) for df in dfs]
    new, ups = kept(*u.plan(listing, subs, max_new=5))
    (held,) = kept(u.freeze(subs, new, ups))
    assert ups.first()["truncated"] == 6 and [r["accn"] for r in new.orderBy("pos").collect()] == ["a11", "a10", "a09", "a08", "a07"]
    done = lambda *ids: spark.createDataFrame([("0000000001", a) for a in ids], "cik string, accn string")
    left, subs1 = kept(*u.complete(held, subs, done("a11", "zz")))
    assert left.first()["completed"] == ["a11"] and subs1.first()["seen"] == ["a11", "a00"] and subs1.first()["seen_upto_date"] is None
    assert u.checked(left, subs1).first()["error"] is None
    assert u.resume(new, done("a11")).count() == 4
    assert u.checked(left.withColumn("completed", F.array(F.lit("a10"))), subs1).first()["error"] == "broken"
    assert u.freeze(subs1, new, ups, held=left).count() == 0
    none, subs2 = kept(*u.complete(left, subs1, done("a10", "a09", "a08", "a07")))
    assert none.count() == 0 and subs2.first()["seen"] == ["a10", "a09", "a08", "a07", "a11", "a00"] and subs2.first()["seen_upto_date"] is None
    # the rest is not truncated: the baseline moves, and nothing is new after it
    new2, ups2 = kept(*u.plan(listing, subs2, max_new=8))
    (subs3,) = kept(u.commit(subs2, new2, ups2))
    assert ups2.first()["truncated"] == 0 and subs3.first()["seen_upto_date"] == "2024-01-12" and u.plan(listing, subs3)[0].count() == 0
    # a late filing of the baseline's day still counts, an earlier one is history
    late = listing.union(spark.createDataFrame([("0000000001", "b1", "10-K", "2024-01-12", "", "", 20), ("0000000001", "b2", "10-K", "2024-01-11", "", "", 21)], listing.schema))
    new4, ups4 = u.plan(late, subs3)
    assert [r["accn"] for r in new4.collect()] == ["b1"] and ups4.first()["history_skipped"] == 1
    assert u.plan(listing, u.reset(subs3, "1"))[1].first()["first_run"]


def test_first_run_makes_history(spark):
    from sedimenta.operators import updates as u

    rows = [("1", f"a{k:02}", "8-K", f"2024-01-{k + 1:02}", k) for k in range(12)]
    listing = u.normalized(spark.createDataFrame(rows, "cik string, accn string, form string, date string, pos long"))
    subs = u.subscriptions(spark.createDataFrame([("1",), ("2",)], "cik string"))
    new, ups = u.plan(listing, subs, since="2024-01-02")
    one = {r["cik"]: r for r in ups.collect()}
    assert (one["0000000001"]["first_run"], one["0000000001"]["new_count"], one["0000000001"]["truncated"], one["0000000001"]["history_skipped"], one["0000000001"]["since_skipped"]) == (True, 8, 0, 3, 1)
    assert one["0000000002"]["warning"] == "no metadata" and one["0000000002"]["new_count"] == 0
    after = {r["cik"]: r for r in u.commit(subs, new, ups).collect()}
    assert after["0000000001"]["seen_upto_date"] == "2024-01-12" and after["0000000002"]["first_run_done"]
    assert u.plan(listing, u.commit(subs, new, ups))[0].count() == 0


def test_protected_text():
    from sedimenta.operators import fragments as f

    text, kept, needs, words = f.protect("Net sales rose 12% to $5,000 on 2020-01-01 under us-gaap, see https://x.y/z?a=1 &amp; 0000320193-24-000001 SECX9X year-over-year.")
    assert kept[:2] == ["12%", "$5,000"] and "https://x.y/z?a=1" in kept and "&amp;" in kept and "SECX9X" in kept and needs and "year-over-year" in words
    assert "".join(f.units("a１b −3 é")) == "a１b −3 é"
    assert f.protect("iPhone®")[2] is False and f.protect("$5 (12%)")[2] is False and f.protect("US GAAP")[2] is False and f.protect("SEC filing")[2]
    assert f.protect("１２")[1] == ["１", "２"]
    good = "净销售额 SECX1X 增长"
    assert f.validate(good, "Sales SECX1X rose", ["12%"]) == ("净销售额 12% 增长", None)
    for bad, why in [("", "empty"), ("净<b>SECX1X", "markup"), ("净```SECX1X", "markup"), ("净\x01SECX1X", "markup"), ("净", "marks"), ("净SECX1XSECX1X", "marks"), ("净SECX2X", "marks"), ("净SECX1X 7", "marks"), ("净SECX1X -", "marks"), ("净SECX1X ٣", "marks"), ("Sales SECX1X", "language"), ("净 SECX1X", None)]:
        assert f.validate(bad, "Sales SECX1X rose", ["12%"])[1] == why
    assert f.validate("净SECX2XSECX1X", "x", ["1", "2"])[1] == "marks"
    assert f.validate("同比 year-over-year", "x", [], True, ["year-over-year"])[1] is None and f.validate("同比 a-b", "x", [], True, [])[1] == "marks"
    assert f.validate("净 销售", "净  销售", [], True)[1] == "echo" and f.validate("甲 & 乙", "x", [])[0] == "甲 &amp; 乙"
    assert f.limits(max_chars=1, max_requests=5000)["max_chars"] == 8 and f.limits(max_requests=5000)["max_requests"] == 1000
    assert f.fingerprint(version="1", endpoint="e", model="m", thinking="t", max_chars=9, language="l") != f.fingerprint(version="1", endpoint="e", model="m", thinking="t", max_chars=8, language="l")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab Z09$%-.:/&;é€x１SECX<>", max_size=60), st.integers(4, 30))
def test_units_and_pieces_lose_nothing(text, size):
    from sedimenta.operators import fragments as f

    assert "".join(f.units(text)) == text
    cut = f.pieces(text, size)
    assert cut is None or "".join(cut) == text and all(len(p.encode()) <= size for p in cut)
    protected, kept, _, _ = f.protect(text)
    assert f._MARK.sub(lambda m: kept[int(m[1]) - 1], protected) == text


def test_fragments_through_cache_and_answers(spark):
    from sedimenta.operators import fragments as f

    docs = spark.createDataFrame([(1, " Sales of $5 \n"), (2, "Costs rose"), (3, "$7"), (4, None)], "id long, text string")
    frag = f.fragments(docs, ["id"])
    rows = {r["id"]: r for r in frag.collect()}
    assert (rows[1]["leading"], rows[1]["trailing"], rows[1]["protected"]) == (" ", " \n", "Sales of SECX1X") and not rows[3]["requires_language"] and rows[4]["protected"] == ""
    keyed = frag.withColumns({"k": F.concat(F.lit("n"), F.col("id").cast("string")), "old": F.concat(F.lit("o"), F.col("id").cast("string"))})
    new = spark.createDataFrame([("n1", "销售 SECX9X")], "key string, value string")
    old = spark.createDataFrame([("o1", "销售 SECX1X"), ("o2", "Costs rose")], "key string, value string")
    got = {r["id"]: r["restored"] for r in f.cached(keyed, [("k", new), ("old", old)]).collect()}
    assert got == {1: " 销售 $5 \n", 2: None, 3: None, 4: None}
    asked = frag.where("id < 3").withColumns({"batch": F.lit("b"), "id": F.col("id").cast("int")})
    reply = lambda x: spark.createDataFrame([("b", json.dumps(x) if not isinstance(x, str) else x)], "batch string, reply string")
    answers = lambda x: {r["id"]: (r["restored"], r["error"]) for r in f.answers(reply(x), asked).collect()}
    a, b = {"id": 1, "text": "销售 SECX1X"}, {"id": 2, "text": "成本上升"}
    assert answers([a, b]) == {1: (" 销售 $5 \n", None), 2: ("成本上升", None)}
    assert {e for _, e in answers([a]).values()} == {"shape"} == {e for _, e in answers([b, a]).values()} == {e for _, e in answers([a, b | {"x": 1}]).values()} == {e for _, e in answers("no").values()}
    assert answers([a, {"id": 2, "text": "9"}]) == {1: (None, "batch"), 2: (None, "marks")}
    calls = []
    out = f.translate([{"batch": 1, "items": [1]}, {"batch": 2, "items": [2]}, {"batch": 3, "items": [3]}], lambda items: calls.append(items) or (1 / 0 if items == [2] else "ok"))
    assert [x.get("reply") for x in out] == ["ok", None, None] and out[2]["error"] == out[1]["error"] and len(calls) == 2


def test_batches_keep_order_limits_and_duplicates(spark):
    from sedimenta.operators.fragments import batches

    got = batches(spark.createDataFrame([(1, k, 500 if k % 2 else 100) for k in range(20)], "d long, p long, n long"), "d", "p", "n").orderBy("p").collect()
    ids = [r["batch_id"] for r in got]
    assert ids == sorted(ids)
    for b in set(ids):
        own = [r["n"] for r in got if r["batch_id"] == b]
        assert len(own) <= 8 and sum(own) <= 1200
    rows = spark.createDataFrame([(1, 0, 1000, "a"), (1, 1, 1000, "b"), (1, 2, 1000, "a"), (1, 3, 5000, "c"), (2, 0, 10, "a")], "d long, p long, n long, k string")
    assert [(r["d"], r["batch_id"]) for r in batches(rows, "d", "p", "n", key="k").orderBy("d", "p").collect()] == [(1, 0), (1, 1), (1, 0), (1, 2), (2, 0)]


def test_html_nodes(spark):
    from sedimenta.operators.fragments import assembled, html_pieces, nodes

    html = "<p class='a>b'>One two <!-- x < y --><b>3</b></p>"
    assert "".join(x for _, x in nodes(html)) == html and nodes("<script>1</script>") is None and nodes("a < b") is None
    docs = spark.createDataFrame([(1, html * 50), (2, "<style>x</style>"), (3, None)], "id long, html string")
    rows = html_pieces(docs, "id", "html", 10)
    assert {r["id"]: r["html"] for r in assembled(rows.where("id = 1"), "id").collect()} == {1: html * 50}
    assert [r["kind"] for r in rows.where("id = 2").collect()] == ["error"]


def test_markup():
    from sedimenta.functions import markup as m

    assert m.plain_text("<p>A&nbsp;&amp;&#65;&#x42;&unknown;&#9;&mdash;b\u2009c</p>") == "A &AB—b c"
    assert [m.is_numeric(x) for x in ("$ (1,234.5)%", "—", "", "12a", "-3", "()", "$")] == [True, True, False, False, True, False, False]
    assert m.is_amount("(12,345)") and not m.is_amount("2024") and m.has_letters("é") and not m.has_letters("12—"[:2])
    assert m.token_width("Ab 1,2") == pytest.approx(1.25) and m.text_width("€é") == pytest.approx(1.6) and m.token_width("") == 0
    assert m.unhidden("<p style='color: #FFF;font-size:1pt;display:none'>") == "<p>" and "12pt" in m.unhidden("<p style='font-size:12pt'>")
    assert m.unhidden("<p style='line-height:0'>x") == "<p>x" and "1.5" in m.unhidden("<p style='line-height:1.5'>x")
    html, n = m.subtotals("<td style='border-top:1px' class=big>1</td><tr style=\"Border-Top:0\"><td>")
    assert n == 2 and "secsum" in html.split(">")[0] and 'class="big secsum"' in html
    assert m.plain_tags("<td ALIGN=right Colspan=2 onclick='x>y' class='secsum big'><font>a<br></font><img src='u' alt=\"q\">") == '<td colspan="2" class="secsum" style="text-align:right">a<br/><img src="u" alt="q"/>'
    assert m.without("a<script>1<b></script>c<SCRIPT/>d", "script") == "acd" and m.without("x<style>y", "style") == "x"
    raw = "\ufeff<?xml version='1'?><DOCUMENT><TYPE>8-K<TEXT><html><head><title>t</title></head><body><ix:header><xbrli:context>q</xbrli:context></ix:header><p><ix:nonNumeric name='a'>Text</ix:nonNumeric></p><img src=a></body></html></TEXT></DOCUMENT>"
    assert m.clean(raw) == ('<p>Text</p><img src="a"/>', {"images": 1, "subtotal_marks": 0, "tables": 0, "split": 0, "subtables": 0, "kept": 0, "collapsed": 0})
    assert m.clean(raw, images=False)[0] == "<p>Text</p>"


def test_tables():
    from sedimenta.functions import tables as t

    g = t.grid("<table><tr><td rowspan=2>A</td><td colspan=0>B</td></tr><tr><td>C<table><tr><td>in</td></tr></table></td></tr></table>")
    assert [(c.row, c.col, c.text) for c in g.cells] == [(1, 1, "A"), (1, 2, "B"), (2, 2, "C in")]
    narrow = "<table><tr><td>a</td><td>1</td></tr></table>"
    assert t.split_wide(narrow) == (narrow, {"tables": 1, "split": 0, "subtables": 0, "kept": 1, "collapsed": 0})
    empty = "<table><tr><td>a</td><td></td><td>1</td></tr></table>"
    assert t.split_wide(empty)[0] == narrow and t.split_wide(empty)[1]["collapsed"] == 1
    assert t.split_wide("<table><tr><td>x")[0] == "<table><tr><td>x" and t.split_wide("a<b")[0] == "a<b"
    outside = "<table><table></table><tr><td>a</td><td></td></tr></table>"
    assert t.split_wide(outside)[1]["kept"] == 2 and t.split_wide(outside)[0] == outside


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([8.0, 15.0, 22.0, 30.0]))
def test_no_cell_is_lost(seed, budget):
    """Every text that begins in a live column is in some part, whatever the spans; parts hold all labels."""
    from sedimenta.functions import tables as t

    rng = random.Random(seed)
    cells, n = [], 0
    for r in range(rng.randint(1, 6)):
        row = []
        for _ in range(rng.randint(1, 9)):
            n += 1
            value = rng.choice(["", f"w{n}x", f"{n}12,345", "$", f"long words {n}q"])
            row.append(f"<td colspan='{rng.choice([1, 1, 1, 2, 3])}' rowspan={rng.choice([1, 1, 1, 2])}>{value}</td>")
        cells.append(f"<tr>{''.join(row)}</tr>")
    html = f"<p>before</p><table>{''.join(cells)}</table><p>after</p>"
    g = t.grid(html[13:-12])
    parts = t.chunks(g, budget)
    label = t.labels(g)
    assert set().union(*parts, set()) == set(g.live) and all(set(label) <= set(p) for p in parts)
    data = [c for p in parts for c in p if c not in label]
    assert len(data) == len(set(data))
    out, found = t.split_wide(html, budget)
    for c in g.cells:
        assert c.inner in out
    assert out.startswith("<p>before</p>") and out.endswith("<p>after</p>") and found["tables"] == 1


def test_references(spark):
    from sedimenta.functions import html as h
    from sedimenta.functions import urls as u

    base = "https://www.sec.gov/a/b/c.htm?q#f"
    assert [u.resolve(base, x)[0] for x in ("d.jpg", "../d.jpg", "../../../d.jpg", "/x//y/./z?k=1#t", "//h/p#t", "http://o/p#t")] == ["https://www.sec.gov/a/b/d.jpg", "https://www.sec.gov/a/d.jpg", "https://www.sec.gov/d.jpg", "https://www.sec.gov/x/y/z?k=1", "https://h/p", "http://o/p"]
    assert [u.resolve(base, x)[1] for x in (None, " ", "#a", "DATA:x", "javascript:x", "blob:x", "mailto:x")] == ["no-src", "empty", "fragment", "data-uri", "javascript", "blob", "mailto"]
    assert u.resolve(None, "x")[1] == "no-base" and u.resolve(None, "//h/p")[0] == "https://h/p"
    assert u.host_allowed("https://www.SEC.gov:443/x") and not u.host_allowed("https://sec.gov.evil/x") and u.ending("http://h/a.JPG?x") == "jpg"
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08\0\x05\0\x06\x03" + b"\0" * 9
    assert u.sniff(png) == ("image/png", 7, 9) and u.sniff(b"GIF89a\x03\0\x04\0") == ("image/gif", 3, 4) and u.sniff(jpeg) == ("image/jpeg", 6, 5)
    assert u.sniff(b"<html>xxx") is None and u.sniff(b"<?xml?><svg>")[0] == "image/svg+xml" and u.sniff(b"ab") is None
    pages = spark.createDataFrame([(1, base, "<img src='a.png'><script><img src=no></script><img src=a.png><img><img src='http://evil/x.gif'>")], "page_id long, url string, html string")
    refs, items = h.image_plan(pages)
    assert [(r["error"], r["item"] is not None) for r in refs.orderBy("pos").collect()] == [(None, True), (None, True), ("no-src", False), ("host", False)]
    one = items.first()
    assert (one["target"], one["n_refs"], one["kind"]) == ("https://www.sec.gov/a/b/a.png", 2, "image/png")
    got = spark.createDataFrame([(one["item"], bytearray(png), None)], "item string, content binary, failure string")
    done = h.image_outcome(items, got)
    assert (done.first()["outcome"], done.first()["width"]) == ("ok", 7) and h.image_statistics(done).first()["n_refs"] == 2
    assert h.image_outcome(items, got, most_bytes=3).first()["outcome"] == "too large"


def test_fetching(spark, tmp_path):
    from sedimenta.sources import fetch as s

    def scripted(*answers):
        left = list(answers)

        def get(url):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return get

    waits = []
    go = lambda *a, **k: s.fetch("https://x/y", scripted(*a), sleep=waits.append, **k)
    ok = lambda n=3: s.Answer(200, iter([b"x" * n]))
    assert go(ok())[0] == b"xxx" and go(s.Answer(500), s.Answer(error="reset"), ok())[3] == 3 and waits == [1.5, 3.0]
    assert go(s.Answer(404))[1:] == ("notfound", "status 404", 1) and go(s.Answer(400))[1] == "client"
    assert go(s.Answer(429), s.Answer(403), s.Answer(429))[1] == "ratelimit" and waits[-2:] == [3.0, 6.0]
    assert go(ok(10), most=10)[0] == b"x" * 10 and go(ok(11), most=10)[1] == "oversize" and go(ValueError("no"))[1] == "exception"
    assert s.fetch("ftp://x", scripted())[1] == "config"
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_bytes(b"{}")
    asked = spark.createDataFrame([("https://h/a.json",), ("https://h/../../etc/passwd",), ("https://h/b",)], "u string")
    got = {r["u"]: (r["body"], r["error_kind"]) for r in s.fetched(asked, "u", s.file_transport(str(tmp_path)), pause=0).collect()}
    assert got["https://h/a.json"] == (b"{}", None) and {e for b, e in got.values() if b is None} == {"notfound"}
    spark.dataSource.register(s.FilingSource)
    rows = spark.read.format("filings").option("urls", "https://h/a.json\nhttps://h/b").option("root", str(tmp_path)).load().orderBy("url").collect()
    assert [(bytes(r["body"]) if r["body"] else None, r["error_kind"]) for r in rows] == [(b"{}", None), (None, "notfound")]


def test_versions_and_snapshots(spark, tmp_path):
    from sedimenta.sources.state import Versions, cached

    v = Versions(spark, str(tmp_path / "state"))
    df = lambda n: spark.range(n)
    assert v.load() is None and v.info() is None and not v.restore()
    assert v.publish(df(3), now=100) is None and v.load().count() == 3 and v.info(150)["age"] == 50
    assert v.publish(df(1), lambda x: "bad", now=110) == "bad" and v.load().count() == 3
    assert v.publish(df(5), now=120) is None and v.load().count() == 5
    for f in (tmp_path / "state" / v.info()["name"]).glob("*"):
        f.unlink()
    assert v.load().count() == 3  # the version before serves where the current one cannot be read
    assert v.restore() and v.info()["rows"] == 3
    asked = []
    get = lambda out: lambda: asked.append(1) or out
    assert cached(v, get((df(9), None)), ttl=100, least=2, now=150)[1]["source"] == "fresh" and not asked
    assert cached(v, get((df(1), None)), ttl=10, least=2, now=150)[1] == {"source": "stale", "degraded": True, "error": "too few rows"}
    assert cached(v, get((None, "net")), ttl=10, least=2, now=150)[0].count() == 3
    assert cached(v, get((None, "config")), ttl=10, least=2, now=150) == (None, {"source": None, "degraded": False, "error": "config"})
    out, how = cached(v, get((df(9), None)), ttl=10, least=2, now=150)
    assert out.count() == 9 and how["source"] == "fetched"
    v.clear()
    assert v.load() is None


def test_filings_as_a_stream(spark, tmp_path):
    """Two drops of files: each filing is taken once, failures stay new, and the baseline follows success."""
    from sedimenta.operators import updates as u
    from sedimenta.sources.state import Versions
    from sedimenta.streaming.increments import follow

    subs = Versions(spark, str(tmp_path / "subs"))
    subs.publish(u.subscriptions(spark.createDataFrame([("1", True)], "cik string, first_run_done boolean")))
    taken = []

    def take(new):
        rows = new.select("cik", "accn").collect()
        taken.extend(r["accn"] for r in rows)
        return new.select("cik", "accn").where("accn <> 'bad'")

    schema = "cik string, accn string, form string, date string, pos long"

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = follow(stream, subs, take, str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
        return subs.load().first()

    one = drop([("1", "a1", "8-K", "2024-01-01", 0), ("1", "a2", "8-K", "2024-01-02", 1)])
    assert sorted(taken) == ["a1", "a2"] and one["seen_upto_date"] == "2024-01-02"
    two = drop([("1", "a2", "8-K", "2024-01-02", 0), ("1", "a3", "8-K", "2024-01-03", 1), ("1", "bad", "8-K", "2024-01-04", 2)])
    assert sorted(taken) == ["a1", "a2", "a3", "bad"] and two["seen_upto_date"] == "2024-01-02" and two["seen"][0] == "a3"


def test_library_records(spark):
    from sedimenta.operators import library as lib

    good = {"schema": 1, "cik": "0000000001", "accn": "0000000001-24-000001", "name": "Co", "form": "8-K", "date": "2024-01-01", "original_hash": "a" * 64, "chapters": [{"html": "x"}], "images": [{"href": "images/a.png"}], "assets": {"images/a.png": "b" * 64}, "status": None, "source_hash": "s", "state_source_hash": None}
    bad = [{"schema": 2}, {"accn": "x"}, {"name": "n" * 241}, {"date": "2024"}, {"chapters": []}, {"images": [{"href": "images/../x"}]}, {"assets": {}}, {"status": "odd"}, {"status": "complete", "state_source_hash": "t"}, {"original_hash": None}]
    schema = "schema int, cik string, accn string, name string, form string, date string, original_hash string, chapters array<struct<html: string>>, images array<struct<href: string>>, assets map<string,string>, status string, source_hash string, state_source_hash string"
    rows = [good | {"cik": good["cik"]}] + [good | b for b in bad]
    records, counts = lib.scan(spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in ["schema", "cik", "accn", "name", "form", "date", "original_hash"]) + ([tuple(c.values()) for c in r["chapters"]], [tuple(i.values()) for i in r["images"]], r["assets"], r["status"], r["source_hash"], r["state_source_hash"]) for r in rows], schema))
    assert [r["status"] for r in records.collect()] == ["pending"] and tuple(counts.first()) == (1, len(bad))
    paths = spark.createDataFrame([("/w/a/b",), ("/w/../b",), ("/w//b",), ("/x/b",), ("/w/a\tb",)], "p string")
    assert [r[0] for r in paths.select(lib.safe_path(F.col("p"), "/w")).collect()] == [True, False, False, False, False]
    inv = spark.createDataFrame([("/w", "directory"), ("/w/a", "file")], "path string, mode string")
    assert lib.bounded(inv) is None and lib.bounded(inv, files=1) == "too many files" and lib.bounded(inv, depth=0) == "too deep" and lib.bounded(inv.withColumn("mode", F.lit("link"))) == "special file"


def test_cleaning_plan_is_signed(spark):
    from sedimenta.operators import library as lib

    work = "/work/0000000001/0000000001-24-000001"
    inv = spark.createDataFrame([(f"{work}/{n}", "file", 5, "h") for n in ("source.json", "a.htm", "translation.json", "cleanup.json")] + [(work, "directory", 0, None)], "path string, mode string, size long, sha256 string")
    rec = spark.createDataFrame([("0000000001", "0000000001-24-000001", work, "/b/x.epub", "/b/y.epub", "missing", None)], "cik string, accn string, dir string, original_path string, output_path string, presence string, blocked string")
    plan, one = lib.cleaning_plan(rec, inv, rec.select("cik", "accn"))
    assert [r["path"].rsplit("/", 1)[1] for r in plan.orderBy("place").collect()] == ["a.htm", "translation.json", "cleanup.json", "source.json"]
    first = one.first()
    assert (first["n_files"], first["n_bytes"], first["error"]) == (4, 20, None)
    more = inv.union(spark.createDataFrame([("/b/new", "file", 1, "z")], inv.schema))
    assert lib.cleaning_plan(rec, more, rec.select("cik", "accn"))[1].first()["signature"] != first["signature"]
    assert lib.cleaning_plan(rec.withColumn("presence", F.lit("partial")), inv, rec.select("cik", "accn"))[1].first()["error"] == "books exist"
    assert lib.cleaning_plan(rec.limit(0), inv, rec.select("cik", "accn"))[1].first()["error"] == "gone"


def test_money_and_labels(spark):
    from sedimenta.functions import periods as p

    one = lambda c: spark.range(1).select(c).first()[0]
    dec = lambda x: F.lit(x).cast("decimal(38,0)")
    assert [one(p.millions(dec(x))) for x in (49_999, 50_000, 949_999, 950_000, 999_949_999, 999_950_000, -40_000, 0)] == ["0", "0.1", "0.9", "1", "999.9", "1,000", "-0", "0"]
    values = spark.createDataFrame([(x,) for x in (1.005, 0.125, 44.15, -0.5, 2.0, None)], "v double")
    assert [r[0] for r in values.select(p.per_share(F.col("v"))).collect()] == ["1.005", "0.125", "44.15", "-0.50", "2.00", None]
    kinds = [(76, "X"), (77, "Q"), (106, "Q"), (107, "X"), (167, "X"), (168, "H"), (197, "H"), (198, "X"), (258, "X"), (259, "N9M"), (289, "N9M"), (290, "X"), (350, "X"), (351, "FY"), (380, "FY"), (381, "X"), (0, None), (-1, None)]
    assert [one(p.caliber(F.lit(d))) for d, _ in kinds] == [k for _, k in kinds]
    label = lambda k, s, e, d: one(p.period_label(F.lit(k).cast("string"), F.lit(s).cast("string"), F.lit(e), F.lit(d).cast("int")))
    assert label("Q", "2024-07-01", "2024-09-30", 92) == "2024 Q3" and label("FY", "a", "2024-09-30", 366) == "full year (2024-09)" and label("I", None, "2024-09-30", None) == "2024-09-30" and label(None, None, "2024-09-30", None) == "0 days (nil)"
    assert one(p.text_days(F.lit("2024-02-30"), F.lit("2024-03-01"))) is None and one(p.text_days(F.lit("2024-01-01"), F.lit("2024-01-01"))) == 1


def test_directory_index_and_facts_in_small(spark):
    from sedimenta.functions import text
    from sedimenta.operators import companies, facts, filings, library, updates

    c = spark.createDataFrame([(1, "A\tB", "x\ny"), (2, "", "z")], "cik long, ticker string, title string")
    lines = companies.index_lines(c)
    assert [r["line"] for r in lines.orderBy("cik").collect()] == ["1\tA B\tx y", "2\t\tz"]
    assert not companies.index_is_sane(lines, 2) and not companies.index_is_sane(lines, 3)
    many = spark.range(1000).select(F.col("id").alias("cik"), F.lit("T").alias("ticker"), F.lit("n").alias("title"))
    assert companies.index_is_sane(companies.index_lines(many), 1000)
    assert companies.tickers_of(c).collect()[0]["tickers"] == ["A\tB"] and companies.directory(spark.createDataFrame([("<html>",), (None,)], "body string")).count() == 0
    tags = [r["tag"] for r in facts.all_tags(facts.definitions(spark)).collect()]
    assert len(tags) == 14 and tags[:2] == ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"]
    got = facts.totals(spark.createDataFrame([(1, "a", "{}", 200, 5), (1, "b", None, 404, None)], "cik long, tag string, body string, code int, bytes long")).first()
    assert tuple(got) == (1, 2, 5, 1, ["b"])
    body = json.dumps({"units": {"EUR": [{"end": "2024-01-01", "val": 1}], "USD": [{"start": "2023-01-01", "end": "2023-12-31", "val": 2.5, "accn": "a", "filed": "2024-02-01"}, {"end": "2023-12-31", "val": None}]}})
    rows = facts.facts(spark.createDataFrame([(1, "Revenues", body), (2, "Revenues", "<p>")], "cik long, tag string, body string"), ["cik", "tag"])
    assert sorted((r["unit"], r["pos"], None if r["val"] is None else float(r["val"])) for r in rows.collect()) == [("EUR", 0, 1.0), ("USD", 0, 2.5), ("USD", 1, None)]
    periods, info = facts.periods(rows.join(facts.definitions(spark), "tag"), ["cik", "tag"])
    one = info.first()
    assert periods.first()["caliber"] == "FY" and (one["unit"], one["entries"], one["skipped"], one["periods"]) == ("USD", 2, 1, 1)
    per = spark.createDataFrame([(1, 0), (1, 3), (2, 0)], "cik long, n_shown long")
    assert {r["cik"]: r["has_chapter"] for r in facts.has_chapter(per).collect()} == {1: True, 2: False}
    listing = json.dumps({"filings": {"form": ["4", "10-K405", "8-K12B", "10-Q"], "filingDate": ["2024-01-01"], "items": None}})
    src = spark.createDataFrame([(1, 0, listing), (1, 1, listing), (2, 0, "[]")], "cik long, source_pos int, body string")
    assert [(r["form"], r["date"], r["size"]) for r in filings.recent_filings(src, 2).orderBy("rank").collect()] == [("10-K405", "", 0), ("8-K12B", "", 0)]
    picked = spark.createDataFrame([("f1", "ex99.htm")], "accn string, name string")
    f = spark.createDataFrame([("f1", "8-K", "p.htm"), ("f2", "8-K", "p.htm"), ("f3", "10-K", "p.htm"), ("f4", "10-K", "")], "accn string, form string, primary string")
    assert {r["accn"]: (r["document"], r["via"]) for r in filings.content_source(f, picked, "accn").collect()} == {"f1": ("ex99.htm", "folder"), "f2": ("p.htm", "primary"), "f3": ("p.htm", "primary"), "f4": (None, "folder")}
    one = lambda x: spark.range(1).select(x).first()[0]
    assert one(text.concept_url(F.lit(5), F.lit("Assets"))).endswith("CIK0000000005/us-gaap/Assets.json") and one(text.archive_url(F.lit(5), F.lit(""))) is None
    kinds = spark.createDataFrame([(p,) for p in ("/b/x.epub", "/w/translation-cache/k", "/w/1/translation-cache/k", "/w/1/a", "/z")], "p string").select(library.storage_kind(F.col("p"), "/b", "/w"))
    assert [r[0] for r in kinds.collect()] == ["books", "legacy_cache", "cache", "work", None]
    rec = spark.createDataFrame([("1", "a", "2024-01-01", "/o", "h"), ("2", "a", "2024-01-02", "/p", "h")], "cik string, accn string, date string, original_path string, original_hash string")
    assert [r["cik"] for r in library.listed(rec).orderBy("rank").collect()] == ["2", "1"]
    assert [r["cik"] for r in library.verified(rec, spark.createDataFrame([("/o", "h"), ("/p", "x")], "path string, sha256 string")).collect()] == ["1"]
    row = spark.createDataFrame([("0000000001", 2, True, 0, 3, 0, None)], "cik string, new_count long, first_run boolean, truncated long, history_skipped long, since_skipped long, warning string")
    assert row.select(updates.summary_line()).first()[0] == "CIK 0000000001, 2 new, first run, 3 history"


def test_oversized_batches_are_not_frozen(spark):
    from sedimenta.operators import updates as u

    rows = spark.range(600).select(F.lit("1").alias("cik"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("accn"), F.lit("8-K").alias("form"), F.lit("2024-01-01").alias("date"), F.col("id").alias("pos"))
    subs = u.subscriptions(spark.createDataFrame([("1", True)], "cik string, first_run_done boolean"))
    new, ups = u.plan(u.normalized(rows), subs, max_new=600)
    assert u.freeze(subs, new, ups).count() == 0 and u.freeze(subs, *u.plan(u.normalized(rows), subs, max_new=512)).first()["new_count"] == 512


def test_pages_are_translated_from_the_cache(spark):
    """Planning and assembling share the splitting: what is missing is planned, then cached, then the page is whole; tags stay as they are."""
    from sedimenta.operators import fragments as f

    pages = spark.createDataFrame([(1, "<p class='a'>Sales rose 5%</p> <b>$7</b>"), (2, "<script>x</script>"), (3, "<i>Net</i>")], "id long, html string")
    key = lambda t: f.cache_key(t, version="1", endpoint="e", model="m", thinking="off", language="zh-CN")
    plan = f.planned(pages, "id", "html", [], key)
    todo = {(r["id"], r["text"]): r["k"] for r in plan.where("needs and done is null").collect()}
    assert set(todo) == {(1, "Sales rose 5%"), (3, "Net")}
    assert {r["id"]: r["html"] for r in f.translated(plan, "id").collect()} == {1: None, 2: None, 3: None}
    cache = spark.createDataFrame([(todo[1, "Sales rose 5%"], "销售增长 SECX1X"), (todo[3, "Net"], "Net")], "key string, value string")
    older = spark.createDataFrame([(todo[3, "Net"], "净")], "key string, value string")
    got = {r["id"]: r["html"] for r in f.translated(f.planned(pages, "id", "html", [cache, older], key), "id").collect()}
    assert got == {1: "<p class='a'>销售增长 5%</p> <b>$7</b>", 2: None, 3: "<i>净</i>"}


def test_images_in_books(spark):
    from sedimenta.functions import html as h

    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 16
    pages = spark.createDataFrame([(1, "https://www.sec.gov/a/", "<p><img src=a.png alt='A &lt;'>x<IMG SRC='http://evil/b.png' alt=B><img src='c.png'></p>")], "page_id long, url string, html string")
    refs, items = h.image_plan(pages)
    got = items.select("item", F.when(F.col("target").endswith("a.png"), F.lit(png)).alias("content"), F.when(F.col("target").endswith("c.png"), "net").alias("failure"))
    out = h.with_images(pages, refs, h.image_outcome(items, got)).first()["html"]
    item = items.where("target like '%a.png'").first()["item"]
    assert out == f'<p><img src="images/{item}.png" alt="A &lt;"/>x[B]</p>'
