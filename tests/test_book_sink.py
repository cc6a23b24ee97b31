"""Books written by the library: round trips, structure, failed and repeated attempts, overwriting."""

import io
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import books
from sedimenta.sources import book_sink


def _chapters(spark, n=7, chapters=3):
    rows = [(f"book {b}/ü", f"Title <{b}>", "en", c, f"c{c % 2}", f"Heading & {c}", "Acme" if c < 2 else "Other", f"<p>{'word ' * 600}{b}-{c}</p>") for b in range(n) for c in range(chapters)]
    return spark.createDataFrame(rows, "book string, title string, language string, pos int, id string, heading string, company string, html string")


def _images(spark, n=7):
    return spark.createDataFrame([(f"book {b}/ü", k, "pic", f"images/{k}.png", "image/png", bytes([b, k] * 50)) for b in range(n) for k in range(2)], "book string, pos int, id string, href string, media_type string, content binary")


def test_books_round_trip(spark, tmp_path):
    folder = str(tmp_path / "lib")
    book_sink.save(_chapters(spark), folder, _images(spark))
    entries = book_sink.read(spark, folder)
    items, content = book_sink.parsed(entries)
    assert books.structure(entries, items, content).collect() == []
    got = {(r["book"], r["name"]): r for r in entries.collect()}
    assert len(got) == 7 * 8
    for b in range(7):
        name = f"book {b}/ü"
        assert got[name, "mimetype"]["pos"] == 0 and got[name, "mimetype"]["stored"] and bytes(got[name, "mimetype"]["body"]) == b"application/epub+zip"
        assert bytes(got[name, "OEBPS/images/1.png"]["body"]) == bytes([b, 1] * 50) and got[name, "OEBPS/images/1.png"]["stored"]
        doc = ElementTree.fromstring(bytes(got[name, "OEBPS/content.html"]["body"]))
        own = [e for e in doc.iter() if e.tag.endswith(("h1", "h2", "}p"))]
        assert [e.text[-20:] if e.tag.endswith("}p") else e.text for e in own] == ["Acme", "Heading & 0", f"{'word ' * 4}{b}-0"[-20:], "Heading & 1", f"{'word ' * 4}{b}-1"[-20:], "Other", "Heading & 2", f"{'word ' * 4}{b}-2"[-20:]]
        assert [e.get("id") for e in own if e.tag.endswith("h1")] == ["c0", "c1", "c0-2"]
        ElementTree.fromstring(bytes(got[name, "OEBPS/content.opf"]["body"]))
        assert len(ElementTree.fromstring(bytes(got[name, "OEBPS/toc.ncx"]["body"])).findall(".//{*}navPoint")) == 3
    index = book_sink.published(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(folder)
    sums = files.select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    assert sorted(map(tuple, index.select("sha256", "bytes").collect())) == sorted(map(tuple, sums.collect())) and index.count() == 7


def test_appending_and_overwriting(spark, tmp_path):
    folder = str(tmp_path / "lib")
    assert book_sink.published(spark, folder).count() == 0
    book_sink.save(_chapters(spark, 3), folder)
    book_sink.save(_chapters(spark, 5).where("book >= 'book 3'"), folder)
    assert book_sink.published(spark, folder).count() == 5
    book_sink.save(_chapters(spark, 2), folder, mode="overwrite")
    assert sorted(r["book"] for r in book_sink.published(spark, folder).collect()) == ["book 0/ü", "book 1/ü"]
    assert sum(f.endswith(".epub") for _, _, fs in os.walk(folder) for f in fs) == 2 and not os.listdir(f"{folder}/_staging")
    book_sink.save(_chapters(spark, 2).where("false"), folder)
    assert book_sink.read(spark, folder).select("book").distinct().count() == 2


def test_a_failed_job_leaves_no_book(spark, tmp_path):
    folder = str(tmp_path / "lib")
    book_sink.save(_chapters(spark, 2), folder)
    bad = _images(spark).withColumn("content", F.when(F.col("book") == "book 4/ü", F.lit(b"")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="is empty, misnamed"):
        book_sink.save(_chapters(spark), folder, bad, mode="overwrite")
    assert sorted(r["book"] for r in book_sink.published(spark, folder).collect()) == ["book 0/ü", "book 1/ü"]
    assert sum(f.endswith(".epub") for _, _, fs in os.walk(folder) for f in fs) == 2


def test_an_attempt_that_fails_or_loses_counts_for_nothing(tmp_path):
    """Attempts of one task: one fails midway, one ends but is not chosen, one is committed."""
    folder = str(tmp_path / "lib")
    writer = book_sink._Writer(folder, False)
    row = lambda b, c, kind="chapter": {"book": b, "title": "t", "language": "en", "kind": kind, "pos": c, "id": f"c{c}", "heading": "h", "company": None, "href": None, "media_type": None, "body": b"<p>x</p>"}

    def breaks():
        yield row("a", 0)
        yield row("b", 0)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(breaks())
    assert os.listdir(f"{folder}/_staging/{writer.job}") == []
    writer.write(iter([row("a", 0), row("b", 0)]))
    chosen = writer.write(iter([row("a", 0), row("a", 1), row("b", 0)]))
    assert (chosen.books, book_sink._parts(folder)) == (2, [])
    writer.commit([chosen, None, writer.write(iter([]))])
    assert book_sink._parts(folder) == [f"part-{chosen.folder}"]
    found = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".epub")]
    assert sorted(map(os.path.basename, found)) == ["a.epub", "b.epub"]
    with zipfile.ZipFile(next(f for f in found if f.endswith("a.epub"))) as z:
        assert z.testzip() is None and z.read("OEBPS/content.html").count(b"<h1") == 2
    with open(found[0], "rb") as f:
        assert f.read(58)[30:] == b"mimetypeapplication/epub+zip"
    with pytest.raises(ValueError, match="not together"):
        writer.write(iter([row("a", 0), row("b", 0), row("a", 1)]))
    with pytest.raises(ValueError, match="no chapter"):
        writer.write(iter([row("a", 0, "image") | {"href": "images/x.png", "media_type": "image/png"}]))


def test_a_chapter_larger_than_memory_allows_is_streamed():
    p = book_sink.Package("b", None, None)
    for k in range(40):
        p.chapter(f"c{k}", "h", None, os.urandom(1 << 19).hex().encode())
    with p.finished() as whole:
        assert whole._rolled and zipfile.ZipFile(io.BytesIO(whole.read())).testzip() is None
