"""HTML of filings as DataFrames: cleaning, links, images, tables.  Documents are handled one by one in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions import balance, markup, tables, urls

#: Bytes below which a cleaned document is refused, and of a text that counts as one in a check.
LEAST_BYTES, LEAST_TEXT = 200, 2048
#: Rows of a batch that goes back to Spark, characters after which it goes earlier, and documents of a batch that comes.
OUT_ROWS, OUT_CHARS, IN_ROWS = 10_000, 1 << 22, 500

COUNTS = ["images", "subtotal_marks", "tables", "split", "subtables", "kept", "collapsed"]


def _per_row(df: DataFrame, key: str, columns: list[str], make: Callable[..., list[tuple]], out: str) -> DataFrame:
    """Rows key, *fields from make(*columns) of each document; out: the fields as name type, ...

    A task holds IN_ROWS documents, and of what is made of them OUT_CHARS characters and one document.
    """
    names = [key, *(x.strip().split(" ")[0] for x in out.split(","))]
    kind = df.schema[key].dataType.simpleString()
    of = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    kinds = [of[x.strip().split(" ")[1]] for x in out.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            chars = 0
            own = [batch.schema.field(0).type, *kinds]

            def some() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), own, strict=True)], names)  # noqa: B023

            for row in zip(*batch.columns, strict=True):
                k, *values = (x.as_py() for x in row)
                made = make(*values)
                rows += [(k, *r) for r in made]
                chars += sum([len(x) for r in made for x in r if isinstance(x, str)])
                if len(rows) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield some()
                    rows, chars = [], 0
            if rows:
                yield some()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(IN_ROWS))
    return df.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, {out}")


def clean(pages: DataFrame, key: str = "page_id", html: str = "html", **options) -> DataFrame:
    """key, clean (the cleaned markup), counts of what was found, n_links, and long_enough; null counts as empty."""

    def make(raw: str | None) -> list[tuple]:
        text, found = markup.clean(raw or "", **options)
        return [(text, *(found[c] for c in COUNTS), len(re.findall(r"<a(?=[\s>])[^>]*\shref=", text)), len(text.encode()) >= LEAST_BYTES)]

    return _per_row(pages, key, [html], make, f"clean string, {', '.join(f'n_{c} long' for c in COUNTS)}, n_links long, long_enough boolean")


def cleaned(df: DataFrame, html: str = "html") -> DataFrame:
    """df with clean, n_images and long_enough behind each row, in one pass; null markup gives nulls."""
    at = df.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(at).to_pylist()):
                text, found = (None, {"images": None}) if raw is None else markup.clean(raw)
                own = ((text, pa.string()), (found["images"], pa.int64()), (None if text is None else len(text.encode()) >= LEAST_BYTES, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *(pa.array([x], t) for x, t in own)], [*batch.schema.names, "clean", "n_images", "long_enough"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(IN_ROWS))
    return df.mapInArrow(run, f"{kinds}, clean string, n_images long, long_enough boolean")


def plain(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and the plain text of its markup, without scripts, styles and head."""

    def make(raw: str | None) -> list[tuple]:
        s = raw or ""
        for name in ("script", "style", "head"):
            s = markup.without(s, name)
        return [(markup.plain_text(re.sub("<!--.*?-->", " ", s, flags=re.S)),)]

    return _per_row(pages, key, [html], make, "text string")


def references(pages: DataFrame, tag: str, attribute: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, pos, ref, target and error of an attribute of all elements of a tag, outside scripts, styles and head."""

    def make(base: str | None, raw: str | None) -> list[tuple]:
        s, out = raw or "", []
        for name in ("script", "style", "head"):
            s = markup.without(s, name)
        for m in markup.TAG.finditer(s):
            if m[2].lower() == tag and not m[1]:
                ref = markup.attributes(m[3]).get(attribute)
                ref = None if ref is None else markup.unescaped(ref)
                out.append((len(out), ref, *urls.resolve(base, ref)))
        return out

    return _per_row(pages, key, [url, html], make, "pos long, ref string, target string, error string")


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and the distinct absolute web targets of its links, in order of their first place."""
    found = references(pages, "a", "href", key).where(F.col("target").rlike("^https?://"))
    first = found.groupBy(key, "target").agg(F.min("pos").alias("_first"))
    return first.withColumn("pos", (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).cast("long")).select(key, "pos", "target")


def image_plan(pages: DataFrame, key: str = "page_id", hosts: tuple[str, ...] = urls.HOSTS) -> tuple[DataFrame, DataFrame]:
    """(references to images with item or error; items: one for each URL, with its place, ending and kind).

    Many references share an item.  Hosts that are not allowed are errors, like what cannot be resolved.
    """
    refs = references(pages, "img", "src", key)
    host = F.lower(F.regexp_replace(F.regexp_extract("target", r"^[A-Za-z][A-Za-z0-9_+.-]*:(?://([^/]+))?", 1), r":[0-9]+$", ""))
    allowed = host.isin(*hosts)
    for h in hosts:
        allowed = allowed | host.endswith(f".{h}")
    refs = refs.withColumn("error", F.when(F.col("error").isNull() & ~allowed, "host").otherwise(F.col("error")))
    good = refs.where("error is null")
    items = good.groupBy("target").agg(F.min(F.struct(F.col(key).alias("k"), "pos")).alias("_first"), F.count("*").alias("n_refs"))
    path = F.lower(F.regexp_replace("target", r"[?#].*$", ""))
    end = F.nullif(F.regexp_extract(path, r"\.([a-z0-9]{2,5})$", 1), F.lit(""))
    kinds = F.create_map(*(F.lit(x) for kv in urls.KINDS.items() for x in kv))
    items = items.select(F.sha2("target", 256).alias("item"), "target", F.col("_first.k").alias("first_key"), F.col("_first.pos").alias("first_pos"), "n_refs", end.alias("ending"), kinds[end].alias("kind"))
    return refs.withColumn("item", F.when(F.col("error").isNull(), F.sha2("target", 256))), items


def image_outcome(items: DataFrame, got: DataFrame, most_bytes: int = 5 << 20) -> DataFrame:
    """items with outcome, kind, width and height from got(item, content, failure): its bytes decide what it is."""

    def make(content: bytes | None) -> list[tuple]:
        return [urls.sniff(content) or (None, None, None)]

    head = got.select("item", F.substring("content", 1, urls.HEAD).alias("content"))
    seen = _per_row(head, "item", ["content"], make, "seen string, width long, height long")
    rows = items.join(got.select("item", F.octet_length("content").alias("bytes"), "failure"), "item", "left").join(seen, "item", "left")
    outcome = F.when(F.col("failure").isNotNull(), "failed").when(F.col("bytes").isNull(), "not fetched").when(F.col("bytes") > most_bytes, "too large").when(F.col("seen").isNull(), "unknown").otherwise("ok")
    return rows.withColumns({"outcome": outcome, "kind": F.coalesce("seen", "kind")}).drop("seen")


def with_images(pages: DataFrame, refs: DataFrame, outcomes: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and its markup with every image taken from the book (images/item.ending), or by its alternative text where there is none.

    refs come from image_plan, outcomes from image_outcome.
    """
    ends = F.create_map(*(F.lit(x) for kv in urls.ENDINGS.items() for x in kv))
    good = outcomes.where("outcome = 'ok'").select("item", F.concat(F.lit("images/"), "item", F.lit("."), ends[F.col("kind")]).alias("href"))
    per = refs.join(good, "item", "left").where("href is not null").groupBy(key).agg(F.collect_list(F.struct("pos", "href")).alias("_images"))
    rows = pages.select(key, html).join(per, key, "left")

    def make(raw: str | None, images: list[dict] | None) -> list[tuple]:
        hrefs, n, out, at = {i["pos"]: i["href"] for i in images or ()}, 0, [], 0
        s = raw or ""
        for name in ("script", "style", "head"):
            s = markup.without(s, name)
        for m in markup.TAG.finditer(s):
            if m[2].lower() == "img" and not m[1]:
                alt = (markup.attributes(m[3]).get("alt") or "").replace('"', "&quot;")
                to = f'<img src="{hrefs[n]}" alt="{alt}"/>' if n in hrefs else f"[{alt}]" if alt else ""
                out += [s[at : m.start()], to]
                at, n = m.end(), n + 1
        return [("".join([*out, s[at:]]),)]

    return _per_row(rows, key, [html, "_images"], make, "html string")


def image_statistics(outcomes: DataFrame) -> DataFrame:
    """For each outcome: images, references, bytes and the most bytes of one."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n_images"), F.sum("n_refs").alias("n_refs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("bytes"), F.lit(0)).cast("long").alias("most_bytes"))


def _found_tables(html: str | None) -> Iterator[tables.Grid]:
    pieces, tags = tables.parts_of(balance.balanced(html or "")[0])
    for k, end in tables.outermost(tags):
        if end is not None:
            yield tables.laid_out(["", *pieces[2 * k + 1 : 2 * end + 2], ""], tags[k : end + 1])


def table_grid(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Cells of the outermost tables: key, table_id, r, c (from 1), cs, rs, tag and text."""

    def make(raw: str | None) -> list[tuple]:
        return [(t, c.row, c.col, c.cs, c.rs, c.tag, c.text) for t, g in enumerate(_found_tables(raw)) for c in g.cells]

    return _per_row(docs, key, [html], make, "table_id long, r long, c long, cs long, rs long, tag string, text string")


def split_tables(docs: DataFrame, key: str = "doc_id", html: str = "html", budget: float = tables.BUDGET, most: int = tables.COLUMNS) -> DataFrame:
    """Cells with text of every table with the part that each column falls into; label columns are in all (-1).  No cell is lost."""

    def make(raw: str | None) -> list[tuple]:
        out = []
        for t, g in enumerate(_found_tables(raw)):
            label = set(g.labels)
            parts = tables.chunks(g, budget, None if tables.width(g, g.live) <= budget else most)
            part = {c: k for k, cols in enumerate(parts) for c in cols if c not in label} | dict.fromkeys(label, -1)
            out += [(t, c.row, c.col, c.cs, part[c.col], c.text) for c in g.cells if c.text]
        return out

    return _per_row(docs, key, [html], make, "table_id long, r long, c long, span long, part long, text string")


def audit(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Counts of elements of each document, and whether it is long enough."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return pages.select(key, count("<p[ >]").alias("n_p"), count("<a ").alias("n_a"), count("<script").alias("n_script"), (F.octet_length(html) >= LEAST_BYTES).alias("long_enough"))
