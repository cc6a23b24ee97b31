"""Books as files: a Spark data source that writes one package (EPUB) for each book, and reads packages entry by entry.

`df.write.format("books").mode(...).save(folder)` takes rows as `rows_of` makes them.  All rows of a
book lie in one partition, in order: images first, then chapters; a task packs one book at a time,
chapter by chapter, and holds one row of it.

Publishing has two phases.  A task writes its packages and an index of them (book, name, bytes,
sha256) below _staging, into a folder of its own attempt; what fails or is repeated leaves nothing
that counts.  The commit moves the folders of the attempts that Spark chose and then writes a list of
them below _books, in one step; only packages in listed folders are books.  So readers see all books
of a job or none, and the driver handles folders, not books.  Overwriting lists the new folders before
the old ones go.  Folders may be URIs of any file system that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sedimenta.sources.scratch import system

ROW = "book string, title string, language string, kind string, pos long, id string, heading string, company string, href string, media_type string, body binary"
ENTRY = "book string, pos int, name string, stored boolean, size long, body binary"
#: Fixed values of the package format.
MIMETYPE = b"application/epub+zip"
CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>\n'
STYLE = ".secsum { border-top: 1px solid; }\n.company { page-break-before: always; }\n"
#: Bytes of a package up to which it is put together in memory, and of a piece that is copied.
IN_MEMORY, COPY = 8 << 20, 1 << 20
#: Media types whose bytes are packed already.
PACKED = ("image/png", "image/jpeg", "image/gif", "image/webp")


def rows_of(chapters: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Rows for the sink from chapters(book, title, language, pos, id, heading, company, html) and images(book, pos, id, href, media_type, content), as a book's manifest lists them."""
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = chapters.select("book", "title", "language", F.lit("chapter").alias("kind"), F.col("pos").cast("long").alias("pos"), "id", "heading", "company", *none("href", "media_type"), F.encode("html", "UTF-8").alias("body"))
    if images is not None:
        rows = images.select("book", *none("title", "language"), F.lit("image").alias("kind"), F.col("pos").cast("long").alias("pos"), "id", *none("heading", "company"), "href", "media_type", F.col("content").alias("body")).unionByName(rows)
    return rows.repartition("book").sortWithinPartitions("book", F.desc("kind"), "pos", "id")


def save(chapters: DataFrame, folder: str, images: DataFrame | None = None, mode: str = "append") -> None:
    """Writes the books of some chapters and images."""
    chapters.sparkSession.dataSource.register(Books)
    rows_of(chapters, images).write.format("books").mode(mode).save(folder)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """book, part, name, bytes and sha256 of the books of a folder."""
    parts = _parts(folder)
    schema = "book string, part string, name string, bytes long, sha256 string"
    return spark.read.schema(schema).json([f"{folder}/{p}/index.jsonl" for p in parts]) if parts else spark.createDataFrame([], schema)


def _parts(folder: str) -> list[str]:
    """The folders that the lists below _books name."""
    files, path = system(folder)
    if files.get_file_info(f"{path}/_books").type != fs.FileType.Directory:
        return []
    out = []
    for info in sorted(files.get_file_info(fs.FileSelector(f"{path}/_books")), key=lambda x: x.path):
        if info.path.endswith(".json"):
            with files.open_input_stream(info.path) as f:
                out += json.loads(f.read())["parts"]
    return out


class Package:
    """One package as it is written: images, then chapters into one document, then its lists."""

    def __init__(self, book: str, title: str | None, language: str | None):
        self.book, self.title, self.language = book, title or book, language or "en"
        self.file = tempfile.SpooledTemporaryFile(IN_MEMORY)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("mimetype", (1980, 1, 1, 0, 0, 0)), MIMETYPE, zipfile.ZIP_STORED)
        self.items: list[tuple[str, str, str]] = []
        self.ids: set[str] = {"ncx", "content", "css"}
        self.toc: list[tuple[str, str]] = []
        self.text = self.company = None

    def _id(self, wanted: str) -> str:
        """wanted, or with a number behind it where it is taken."""
        out, n = wanted, 2
        while out in self.ids:
            out, n = f"{wanted}-{n}", n + 1
        self.ids.add(out)
        return out

    def _entry(self, name: str) -> zipfile.ZipInfo:
        return zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))

    def image(self, id_: str, href: str, kind: str, body: bytes) -> None:
        if not body or not href or not href.startswith("images/") or ".." in href or self.text:
            raise ValueError(f"{self.book}: image {href!r} is empty, misnamed or comes after chapters")
        if any(href == h for _, h, _ in self.items):
            raise ValueError(f"{self.book}: image {href!r} stands there twice")
        self.items.append((self._id(id_ or "image"), href, kind))
        self.zip.writestr(self._entry(f"OEBPS/{href}"), body, zipfile.ZIP_STORED if kind in PACKED else zipfile.ZIP_DEFLATED)

    def chapter(self, id_: str, heading: str, company: str | None, body: bytes) -> None:
        if self.text is None:
            entry = self._entry("OEBPS/content.html")
            entry.compress_type = zipfile.ZIP_DEFLATED
            self.text = self.zip.open(entry, "w", force_zip64=True)
            self.text.write(f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(self.title)}</title><link rel="stylesheet" type="text/css" href="stylesheet.css"/></head><body>\n'.encode())
        id_ = self._id(id_ or "chapter")
        if company and company != self.company:
            self.text.write(f'<h2 class="company">{escape(company)}</h2>\n'.encode())
        self.company = company or self.company
        self.text.write(f'<h1 id="{escape(id_)}">{escape(heading or "")}</h1>\n<div>'.encode())
        self.text.write(body or b"")
        self.text.write(b"</div>\n")
        self.toc.append((id_, heading or ""))

    def finished(self) -> tempfile.SpooledTemporaryFile:
        """The whole package, to be read from its beginning."""
        if self.text is None:
            raise ValueError(f"{self.book}: no chapter")
        self.text.write(b"</body></html>\n")
        self.text.close()
        points = "".join(f'<navPoint id="n{k}" playOrder="{k}"><navLabel><text>{escape(h)}</text></navLabel><content src="content.html#{escape(i)}"/></navPoint>\n' for k, (i, h) in enumerate(self.toc, 1))
        ncx = f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape(self.book)}"/></head><docTitle><text>{escape(self.title)}</text></docTitle>\n<navMap>\n{points}</navMap></ncx>\n'
        own = [("ncx", "toc.ncx", "application/x-dtbncx+xml"), ("content", "content.html", "application/xhtml+xml"), ("css", "stylesheet.css", "text/css"), *self.items]
        listed = "".join(f'<item id="{escape(i)}" href="{escape(h)}" media-type="{escape(k)}"/>\n' for i, h, k in own)
        cover = f'<meta name="cover" content="{escape(self.items[0][0])}"/>' if self.items else ""
        opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="id" version="2.0"><metadata><dc:title>{escape(self.title)}</dc:title><dc:identifier id="id">{escape(self.book)}</dc:identifier><dc:language>{escape(self.language)}</dc:language>{cover}</metadata>\n<manifest>\n{listed}</manifest>\n<spine toc="ncx"><itemref idref="content"/></spine></package>\n'
        for name, x in (("OEBPS/toc.ncx", ncx), ("OEBPS/stylesheet.css", STYLE), ("OEBPS/content.opf", opf), ("META-INF/container.xml", CONTAINER)):
            self.zip.writestr(self._entry(name), x.encode(), zipfile.ZIP_DEFLATED)
        self.zip.close()
        self.file.seek(0)
        return self.file


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written: its folder, packages and their bytes."""

    folder: str
    books: int
    bytes: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, top = system(self.folder)
        name = uuid.uuid4().hex
        attempt = f"{top}/_staging/{self.job}/{name}"
        files.create_dir(attempt)
        package, done, size = None, set(), 0
        try:
            with files.open_output_stream(f"{attempt}/index.jsonl") as index:

                def close() -> int:
                    digest, n, file = hashlib.sha256(), 0, f"{quote(package.book, safe=' ')}.epub"
                    with package.finished() as whole, files.open_output_stream(f"{attempt}/{file}") as to:
                        while part := whole.read(COPY):
                            digest.update(part)
                            n += len(part)
                            to.write(part)
                    index.write((json.dumps({"book": package.book, "part": f"part-{name}", "name": file, "bytes": n, "sha256": digest.hexdigest()}) + "\n").encode())
                    return n

                for r in iterator:
                    if package is None or r["book"] != package.book:
                        size += close() if package else 0
                        if r["book"] is None or r["book"] in done:
                            raise ValueError(f"rows of book {r['book']!r} are not together")
                        done.add(r["book"])
                        package = Package(r["book"], r["title"], r["language"])
                    package.title, package.language = r["title"] or package.title, r["language"] or package.language
                    if r["kind"] == "image":
                        package.image(r["id"], r["href"], r["media_type"], bytes(r["body"] or b""))
                    else:
                        package.chapter(r["id"], r["heading"], r["company"], bytes(r["body"] or b""))
                size += close() if package else 0
        except BaseException:
            files.delete_dir(attempt)
            raise
        return Written(name, len(done), size)

    def commit(self, messages: list) -> None:
        files, top = system(self.folder)
        before = _parts(self.folder) if self.overwrite else []
        lists = [x.path for x in files.get_file_info(fs.FileSelector(f"{top}/_books", allow_not_found=True))] if self.overwrite else []
        parts = []
        for m in messages:
            if m is not None and m.books:
                files.move(f"{top}/_staging/{self.job}/{m.folder}", f"{top}/part-{m.folder}")
                parts.append(f"part-{m.folder}")
        files.create_dir(f"{top}/_books")
        with files.open_output_stream(f"{top}/_books/{self.job}.new") as f:
            f.write(json.dumps({"parts": parts, "books": sum(m.books for m in messages if m), "bytes": sum(m.bytes for m in messages if m)}).encode())
        files.move(f"{top}/_books/{self.job}.new", f"{top}/_books/{self.job}.json")
        for x in lists:
            files.delete_file(x)
        for p in before:
            files.delete_dir(f"{top}/{p}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, top = system(self.folder)
        if files.get_file_info(f"{top}/_staging/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{top}/_staging/{self.job}")


class _Reader(DataSourceReader):
    """A partition for each folder of books; entries come out in their order."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in _parts(self.folder)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        files, top = system(self.folder)
        with files.open_input_stream(f"{top}/{partition.value}/index.jsonl") as f:
            listed = [json.loads(x) for x in f.read().splitlines()]
        for own in listed:
            with files.open_input_file(f"{top}/{partition.value}/{own['name']}") as f, zipfile.ZipFile(f) as z:
                for k, e in enumerate(z.infolist()):
                    yield own["book"], k, e.filename, e.compress_type == zipfile.ZIP_STORED, e.file_size, z.read(e)


class Books(DataSource):
    """spark.read.format("books").load(folder): the entries of all packages; df.write.format("books").save(folder): packages of rows."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """book, pos, name, stored, size and body of every entry of the books of a folder."""
    spark.dataSource.register(Books)
    return spark.read.format("books").load(folder)


def parsed(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items: book, id, name, media_type, role; content: book, name, target, chars) of packages' entries, for operators.books.structure."""
    text = F.decode("body", "UTF-8")
    opf = entries.where("name = 'OEBPS/content.opf'").select("book", text.alias("x"))
    opf = opf.select("book", F.regexp_extract("x", '<meta name="cover" content="([^"]*)"', 1).alias("cover"), F.explode(F.regexp_extract_all("x", F.lit("(<item [^>]*>)"), 1)).alias("x"))
    part = lambda a: F.regexp_extract("x", f' {a}="([^"]*)"', 1)
    items = opf.select("book", part("id").alias("id"), F.concat(F.lit("OEBPS/"), part("href")).alias("name"), part("media-type").alias("media_type"), "cover")
    items = items.withColumn("role", F.when((F.col("cover") != "") & (F.col("id") == F.col("cover")), "cover").when(F.col("media_type") == "application/x-dtbncx+xml", "toc")).drop("cover")
    docs = entries.where("name in ('OEBPS/content.html', 'OEBPS/toc.ncx')").select("book", "name", text.alias("x"))
    seen = F.char_length(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " ")).cast("long")
    targets = docs.select("book", "name", F.explode(F.concat(F.regexp_extract_all("x", F.lit('(?:href|src)="((?!#|[A-Za-z][A-Za-z0-9+.-]*:)[^"]*)"'), 1), F.array(F.lit("")))).alias("target"), seen.alias("chars"))
    return items, targets.where("name = 'OEBPS/content.html' or target <> ''").select("book", "name", F.when(F.col("target") != "", F.concat(F.lit("OEBPS/"), "target")).otherwise("").alias("target"), F.when(F.col("name") == "OEBPS/content.html", F.col("chars")).alias("chars"))
