"""Books made of filings: manifests, publishing in two phases, checks of their structure, and reading progress."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metadata that holds a place in the old text, that holds a reader's notes, and kinds of content documents.
PLACES = ["last_xpointer", "last_percent", "percent_finished", "doc_pages", "pagemap_doc_pages", "cache_file_path", "cre_dom_version", "stats"]
NOTES = ["annotations", "bookmarks", "page_bookmarks"]
CONTENT = ["application/xhtml+xml", "text/html"]
#: Characters below which a content document is reported.
LEAST_CHARS = 2048


def manifest(listed: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items that a book packs, with unique ids; warnings: book, href, why) from listed(book, pos, href, media_type, id) and disk(book, href, size).

    Dropped: names outside images/ or with .. in them, files that are missing or empty, and a name
    listed again.  Files that nothing lists are left out and reported.
    """
    safe = F.col("href").rlike("^images/[^/]") & ~F.col("href").contains("..")
    rows = listed.join(disk.select("book", "href", "size"), ["book", "href"], "left")
    again = F.row_number().over(Window.partitionBy("book", "href").orderBy("pos")) > 1
    rows = rows.withColumn("why", F.when(~F.coalesce(safe, F.lit(False)), "name").when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(again, "listed again"))
    items = rows.where("why is null")
    plain = F.regexp_replace(F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("href")), "[^A-Za-z0-9_.-]", "_")
    wanted = F.when(plain.rlike("^[A-Za-z_]"), plain).otherwise(F.concat(F.lit("i"), plain))
    items = items.withColumn("id", wanted)
    n = F.row_number().over(Window.partitionBy("book", "id").orderBy("pos"))
    items = items.withColumn("id", F.when(n > 1, F.concat("id", F.lit("-"), n.cast("string"))).otherwise(F.col("id"))).drop("why")
    orphans = disk.join(listed.select("book", "href"), ["book", "href"], "left_anti").select("book", "href", F.lit("not listed").alias("why"))
    return items, rows.where("why is not null").select("book", "href", "why").union(orphans)


def chapters(rows: DataFrame, book: str, order: list[Column]) -> DataFrame:
    """Each book's content: chapters in order as one text, a heading where the company differs from the chapter before."""
    before = F.lag("company").over(Window.partitionBy(book).orderBy(*order))
    place = F.row_number().over(Window.partitionBy(book).orderBy(*order))
    head = F.when(before.eqNullSafe(F.col("company")), "").otherwise(F.concat(F.lit("<h1>"), "company", F.lit("</h1>")))
    parts = rows.withColumns({"_at": place, "_text": F.concat(head, F.lit("<h2>"), "heading", F.lit("</h2>"), "html")})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda r: r["_text"])
    return parts.groupBy(book).agg(F.array_join(ordered, "").alias("html"), F.count("*").alias("n_chapters"))


def publication(rows: DataFrame) -> DataFrame:
    """rows(snapshot, expected, target, staged: hashes or null) with step: what a publication does next.

    The snapshot comes before the book, so without one nothing is published.  A book that is there
    is verified, never replaced; else the staged file of the expected hash takes its place.
    """
    return rows.withColumn(
        "step",
        F.when(~F.col("snapshot"), "write snapshot").when(F.col("target") == F.col("expected"), "done").when(F.col("target").isNotNull(), "differs")
        .when(F.col("staged") == F.col("expected"), "publish").when(F.col("staged").isNotNull(), "build again").otherwise("restore"),
    )


def structure(entries: DataFrame, items: DataFrame, content: DataFrame) -> DataFrame:
    """Faults of books: book, fault, name.

    entries(book, pos, name, stored, size) are a package's files in order, items(book, id, name,
    media_type, role: cover, toc or null) its manifest, content(book, name, target, chars) its
    documents' references and visible characters.
    """
    first = entries.where("pos = 0").select("book", "name", ((F.col("name") == "mimetype") & F.col("stored")).alias("ok"))
    out = first.where("not ok").select("book", F.lit("mimetype is not first and stored").alias("fault"), "name")
    have = items.join(entries.select("book", "name", "size"), ["book", "name"], "left")
    out = out.union(have.where("size is null").select("book", F.lit("listed but missing"), "name")).union(have.where("size = 0").select("book", F.lit("empty"), "name"))
    twice = items.groupBy("book", "id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    out = out.union(twice.select("book", F.lit("id is not unique"), "name"))
    books = entries.select("book").distinct()
    for role in ("cover", "toc"):
        out = out.union(books.join(items.where(F.col("role") == role), "book", "left_anti").select("book", F.lit(f"no {role}"), F.lit(None).cast("string")))
    out = out.union(books.join(items.where(F.col("media_type").isin(*CONTENT)), "book", "left_anti").select("book", F.lit("no content"), F.lit(None).cast("string")))
    named = content.withColumn("target", F.regexp_replace("target", "#.*$", "")).where("target <> ''")
    out = out.union(named.join(entries.select("book", F.col("name").alias("target")), ["book", "target"], "left_anti").select("book", F.lit("target is missing"), "target").distinct())
    short = content.groupBy("book", "name").agg(F.max("chars").alias("chars")).where(F.col("chars") < LEAST_CHARS)
    return out.union(short.select("book", F.lit("short"), "name"))


def pair(original: DataFrame, translated: DataFrame) -> DataFrame:
    """Places at which two books differ in tags, numbers or images: kind, pos, original, translated; no rows if they agree.

    Both are rows kind, pos, value.
    """
    a, b = original.select("kind", "pos", F.col("value").alias("original")), translated.select("kind", "pos", F.col("value").alias("translated"))
    return a.join(b, ["kind", "pos"], "full_outer").where(~F.col("original").eqNullSafe(F.col("translated")))


def sequences(books: DataFrame, key: str, html: str) -> DataFrame:
    """key, kind (tag, number, image), pos and value of everything that a translation must leave as it is."""
    part = lambda kind, pattern, group: books.select(key, F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all(html, F.lit(pattern), group)).alias("pos", "value"))
    text = books.withColumn(html, F.regexp_replace(html, "<[^>]*>", " "))
    numbers = text.select(key, F.lit("number").alias("kind"), F.posexplode(F.regexp_extract_all(html, F.lit("[0-9][0-9,.]*"), 0)).alias("pos", "value"))
    return part("tag", "(<[^>]*>)", 1).union(part("image", '<img[^>]*src="([^"]*)"', 1)).union(numbers)


def kept_progress(metadata: Column, notes: bool = False) -> Column:
    """A book's metadata without what points into its old text, and without notes unless they are to stay."""
    gone = PLACES + ([] if notes else NOTES) + ["__orderedIndex"]
    return F.map_filter(metadata, lambda k, v: ~k.isin(*gone))


def old_progress(metadata: Column) -> Column:
    """Where the reader was, as a share; null if that is not known."""
    return F.coalesce(F.try_element_at(metadata, F.lit("percent_finished")), F.try_element_at(metadata, F.lit("last_percent"))).try_cast("double")


def restored_progress(snapshots: DataFrame, policy: str = "reset", notes: bool = False) -> DataFrame:
    """snapshots(metadata, old_chars, old_size, new_chars, new_size) with what a rebuilt book gets: metadata, policy and shifted.

    New filings stand in front of a book, so a place moves back by the share that is new: with shift,
    a share f of the old text is (1 - r) + f r of the new one, r being old by new length, 1 at most.
    Lengths are characters where known, else bytes.  Where the place or a length is unknown or not
    above 0, shift is reset: the book opens at its start.  Null metadata is an empty map.
    """
    if policy not in ("reset", "shift"):
        raise ValueError(f"unknown policy {policy}")
    meta = F.coalesce("metadata", F.create_map().cast("map<string, string>"))
    old, new, at = F.coalesce("old_chars", "old_size"), F.coalesce("new_chars", "new_size"), old_progress(meta)
    ratio = F.least(old / new, F.lit(1.0))
    known = F.coalesce((at > 0) & (old > 0) & (new > 0), F.lit(False)) & F.lit(policy == "shift")
    place = F.greatest(F.least((1 - ratio) + at * ratio, F.lit(1.0)), F.lit(0.0))
    rows = snapshots.withColumns({"shifted": F.when(known, place), "metadata": meta})
    text = F.col("shifted").cast("string")
    moved = F.create_map(F.lit("last_percent"), text, F.lit("percent_finished"), text)
    kept = kept_progress(F.col("metadata"), notes)
    return rows.withColumn("policy", F.when(F.col("shifted").isNull(), "reset").otherwise("shift")).withColumn("metadata", F.when(F.col("shifted").isNull(), kept).otherwise(F.map_concat(kept, moved)))


def wrapped(tag: str, limit: int = 40) -> list[str]:
    """A long name in parts, cut where a capital follows a small letter or digit, each of limit - 12 characters at least but the last."""
    out, now = [], ""
    for part in re.split(r"(?<=[a-z0-9])(?=[A-Z])", tag) if len(tag) > limit else [tag]:
        if now and len(now) >= limit - 12:
            out.append(now)
            now = ""
        now += part
    return [*out, now]


def has_contact(agent: Column) -> Column:
    """Whether an agent's name holds a mail address, as sources ask for."""
    return F.coalesce(agent.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(False))


def repair_offers(records: DataFrame, receipts: DataFrame) -> DataFrame:
    """records with repair: what a receipt(cik, accn, kind, source_hash, path) still allows.

    A receipt counts only for the source that it was given for; of several the last given is used.
    stale: it was for another source.
    """
    last = receipts.groupBy("cik", "accn").agg(F.max_by(F.struct("kind", "source_hash", "path"), "given").alias("r"))
    rows = records.join(last, ["cik", "accn"], "left")
    return rows.withColumn("repair", F.when(F.col("r").isNull(), None).when(F.col("r.source_hash") == F.col("source_hash"), F.col("r.kind")).otherwise("stale")).withColumn("repair_path", F.when(F.col("repair") != "stale", F.col("r.path"))).drop("r")
