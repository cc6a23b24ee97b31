"""The library of saved filings: records, status, asset checks, headings, translation state, cleaning and repair plans.

Files are rows of an inventory (path, mode, size, sha256).  A record is a row: cik, accn, name, form,
date, original_path, output_path, original_hash, output_hash, source_hash, fingerprint, status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.dates import is_date
from sedimenta.functions.text import watch_cik
from sedimenta.operators.lifecycle import digest, numbered

#: States of a translation, what a path's end says about its rank in a deletion, endings of unfinished files, and shapes.
STATES = ["pending", "translating", "paused", "failed", "publishing", "complete"]
RANKS = [(r"/source\.json$", 3), (r"/cleanup\.json$", 2), (r"/(translation|locations|original-recovery)\.json$", 1)]
UNFINISHED = [".building.epub", ".building.epub.tmp", ".tmp"]
CIK, ACCESSION, HASH = r"^[0-9]{10}$", r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$", r"^[0-9a-f]{64}$"
RECORD_DIR = r"^(.*/[0-9]{10}/[0-9]{10}-[0-9]{2}-[0-9]{6})/"
IMAGE_NAME = r"^images/[A-Za-z0-9_./-]+$"
#: Chapters and images of a book, hits of a search for a lost file, records of a list, levels and entries of an inventory.
CHAPTERS, IMAGES, HITS, RECORDS, DEPTH, FILES = 20, 5000, 20, 1000, 16, 10_000
#: Rows of an inventory for each part in which records are compared with it.
PART_ROWS = 500_000


def safe_path(path: Column, *roots: str) -> Column:
    """Whether a path lies under a root, without empty, . or .. parts, and without control characters."""
    under = F.lit(False)
    for r in roots:
        under = under | path.startswith(r.rstrip("/") + "/")
    return F.coalesce(under & ~path.rlike(r"[\x00-\x1F\x7F]") & ~path.rlike(r"//|/\.{1,2}(/|$)|/$"), F.lit(False))


def identified(cik: Column, accn: Column) -> Column:
    return F.coalesce(cik.rlike(CIK) & accn.rlike(ACCESSION), F.lit(False))


def valid_snapshot() -> Column:
    """Whether a snapshot's fields fit: identity, lengths, date, hash, chapters, and image names with a hash each."""
    names = F.transform(F.coalesce("images", F.array()), lambda i: i["href"])
    images = F.forall(names, lambda n: n.rlike(IMAGE_NAME) & ~n.contains("..") & ~n.contains("//")) & (F.size(names) <= IMAGES)
    hashes = F.forall(F.map_values("assets"), lambda h: h.rlike(HASH))
    same = F.array_sort(F.array_distinct(names)) == F.array_sort(F.map_keys("assets"))
    fits = (F.col("schema") == 1) & identified(F.col("cik"), F.col("accn")) & (F.octet_length("name") <= 240) & (F.octet_length("form") <= 80) & is_date(F.col("date")) & F.col("original_hash").rlike(HASH)
    return F.coalesce(fits & F.size("chapters").between(1, CHAPTERS) & F.forall("chapters", lambda c: c["html"].isNotNull()) & images & hashes & same, F.lit(False))


def scan(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, one row with n_records and n_damaged): snapshots with their state, pending where none is saved.

    A state of another source, or an unknown one, damages its record.
    """
    state = F.coalesce("status", F.lit("pending"))
    good = valid_snapshot() & state.isin(*STATES) & F.coalesce(F.col("state_source_hash") == F.col("source_hash"), F.col("status").isNull())
    rows = snapshots.withColumns({"_good": F.coalesce(good, F.lit(False)), "status": state})
    return rows.where("_good").drop("_good"), rows.agg(F.count_if("_good").alias("n_records"), F.count_if(~F.col("_good")).alias("n_damaged"))


def listed(records: DataFrame, n: int = RECORDS) -> DataFrame:
    """The newest n records with their rank: by date, then cik and accession."""
    by = [F.desc("date"), F.concat("cik", "accn")]
    return records.orderBy(*by).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def mismatched(listed: DataFrame, found: DataFrame, name: str, digest: str) -> DataFrame:
    """Names whose digests differ, and names on one side only: name, listed and found digest."""
    a, b = listed.select(name, F.col(digest).alias("listed")), found.select(name, F.col(digest).alias("found"))
    return a.join(b, name, "full_outer").where(~F.col("listed").eqNullSafe(F.col("found")))


def manifest_diff(disk: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """Names on one side only: name, on_disk, listed."""
    side = lambda df, on: df.select(name, F.lit(on).alias("on_disk"), F.lit(not on).alias("listed"))
    both = side(disk, True).union(side(manifest, False)).groupBy(name).agg(F.max("on_disk").alias("on_disk"), F.max("listed").alias("listed"))
    return both.where("not (on_disk and listed)")


def presence(rows: DataFrame, original: Column, output: Column) -> DataFrame:
    """rows with status: present (both files exist), partial (one does) or missing."""
    n = original.cast("int") + output.cast("int")
    return rows.withColumn("status", F.when(n == 2, "present").when(n == 1, "partial").otherwise("missing"))


def library_status(records: DataFrame, inventory: DataFrame) -> DataFrame:
    """records with presence (present, partial, missing, unknown, recoverable) and blocked, why nothing may be done with it.

    Unknown: another book bears the accession, or the path exists in another case.  Recoverable: an
    unfinished file lies beside a path, or the record's state is publishing.
    """
    files = inventory.where("mode = 'file'")
    begun = F.filter(F.array(*(F.when(F.col("path").endswith(e), F.expr(f"substring(path, 1, length(path) - {len(e)})")) for e in UNFINISHED)), lambda p: p.isNotNull())
    # a file speaks for its own path, and an unfinished one for the path that it will have
    said = files.select(F.explode(F.concat(F.array(F.struct(F.col("path"), F.lit(False).alias("begun"))), F.transform(begun, lambda p: F.struct(p.alias("path"), F.lit(True).alias("begun"))))).alias("s")).select("s.*")
    # as many parts as the inventory has rows for, so that a task's share does not grow with it
    n = max(records.sparkSession.sparkContext.defaultParallelism, inventory.count() // PART_ROWS + 1)
    said = said.withColumn("low", F.lower("path")).repartition(n, "low")
    said = said.groupBy("low").agg(F.collect_set(F.when(~F.col("begun"), F.col("path"))).alias("have"), F.collect_set(F.when(F.col("begun"), F.col("path"))).alias("begun"))
    paths = records.select("cik", "accn", F.posexplode(F.array("original_path", "output_path")).alias("which", "path"))
    have = paths.withColumn("low", F.lower("path")).repartition(n, "low").join(said, "low", "left")
    have = have.select("cik", "accn", "which", F.array_contains("have", F.col("path")).alias("have"), F.array_contains("begun", F.col("path")).alias("begun"), (F.size("have") > 0).alias("any_case"))
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    per = have.repartition(n, "cik", "accn").groupBy("cik", "accn").agg(
        flag(F.col("have") & (F.col("which") == 0)).alias("original_present"), flag(F.col("have") & (F.col("which") == 1)).alias("output_present"),
        flag(F.col("begun")).alias("_begun"), flag(~F.coalesce("have", F.lit(False)) & F.col("any_case")).alias("_case"),
    )
    books = files.where(F.col("path").endswith(".epub")).select("path", F.regexp_extract("path", r"([0-9]{10}-[0-9]{2}-[0-9]{6})", 1).alias("accn")).where("accn <> ''")
    own = F.array_compact(F.array("original_path", "output_path"))
    strange = records.select("cik", "accn", own.alias("own")).repartition(n, "accn").join(books.repartition(n, "accn"), "accn").where(~F.exists("own", lambda q: F.startswith(F.col("path"), q)))
    strange = strange.repartition(n, "cik", "accn").groupBy("cik", "accn").agg(F.lit(True).alias("_strange"))
    rows = records.repartition(n, "cik", "accn").join(per, ["cik", "accn"], "left").join(strange, ["cik", "accn"], "left").withColumnRenamed("status", "state")
    out = presence(rows, F.col("original_present"), F.col("output_present")).withColumnRenamed("status", "presence")
    publishing = F.col("state") == "publishing"
    blocked = F.when(publishing, "publishing").when(F.col("_case"), "path in another case").when(F.col("_begun"), "unfinished file").when(F.col("_strange"), "another book of this filing")
    kind = F.when(publishing, "recoverable").when(F.col("_case"), "unknown").when(F.col("_begun"), "recoverable").when(F.col("_strange"), "unknown").otherwise(F.col("presence"))
    return out.withColumns({"blocked": blocked, "presence": kind}).drop("_begun", "_case", "_strange")


def storage(files: DataFrame, kind: Column, size: Column) -> DataFrame:
    """n_files and n_bytes of each kind of file."""
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def storage_kind(path: Column, books: str, work: str) -> Column:
    """books, legacy_cache, cache or work, by where a file lies; null elsewhere."""
    inside = lambda root: path.startswith(root.rstrip("/") + "/")
    cache = work.rstrip("/") + "/translation-cache"
    return F.when(inside(books) & path.endswith(".epub"), "books").when(inside(cache), "legacy_cache").when(inside(work) & path.contains("/translation-cache/"), "cache").when(inside(work), "work")


def bounded(inventory: DataFrame, depth: int = DEPTH, files: int = FILES) -> str | None:
    """Why an inventory is not to be acted on: too deep, too large, or with entries that are neither file nor folder; else None."""
    got = inventory.agg(F.count("*").alias("n"), F.max(F.size(F.split("path", "/"))).alias("deep"), F.min(F.size(F.split("path", "/"))).alias("top"), F.count_if(~F.col("mode").isin("file", "directory")).alias("odd")).first()
    if got["odd"]:
        return "special file"
    return "too many files" if got["n"] > files else "too deep" if got["n"] and got["deep"] - got["top"] > depth else None


def deletion_rank(path: Column) -> Column:
    out = F.lit(0)
    for pattern, rank in RANKS:
        out = F.when(path.rlike(pattern), rank).otherwise(out)
    return out


def deletion_order(files: DataFrame) -> DataFrame:
    """files with place, the order of deletion: others, then state, journals and sources last; by path within."""
    return numbered(files, [deletion_rank(F.col("path")), F.col("path")], "place")


def cleaning_plan(records: DataFrame, inventory: DataFrame, chosen: DataFrame, *, remove_books: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to delete in order, one row with n_files, n_bytes, error and signature) for chosen(cik, accn).

    records come from library_status, with dir.  Refused as a whole: a choice that is gone or blocked,
    or whose books still exist unless these are to go.  The signature covers the plan and the whole
    inventory; execution makes the plan again and goes on only if it is the same.
    """
    rows = chosen.join(records, ["cik", "accn"], "left")
    error = F.when(F.col("presence").isNull(), "gone").when(F.col("blocked").isNotNull(), F.col("blocked")).when((F.col("presence") != "missing") & ~F.lit(remove_books), "books exist")
    why = rows.agg(F.min(error).alias("error"))
    files = inventory.where("mode = 'file'")
    # files outside the folders of records have none, and would all meet in one task
    inside = files.withColumn("dir", F.regexp_extract("path", RECORD_DIR, 1)).where("dir <> ''").join(rows.select("dir").distinct(), "dir", "left_semi").select(*files.columns)
    books = rows.select(F.explode(F.array("original_path", "output_path")).alias("path")).distinct()
    target = inside.union(files.join(books, "path", "left_semi")).distinct() if remove_books else inside
    plan = deletion_order(target)
    one = plan.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), digest("path", "sha256").alias("_a")).join(F.broadcast(why))
    one = one.join(F.broadcast(inventory.agg(digest("path", "mode", "size").alias("_b"))))
    return plan, one.withColumn("signature", F.sha2(F.concat_ws("\n", "_a", "_b", F.lit(str(remove_books))), 256)).drop("_a", "_b")


def relink(files: DataFrame, lost: DataFrame, owned: DataFrame, hits: int = HITS) -> DataFrame:
    """lost(cik, accn, sha256) with the paths of equal content that no record owns, whatever the case; error if there are over hits, or none."""
    held = owned.select(F.lower("path").alias("_low"), F.lit(True).alias("_held")).distinct()
    # contents are met first: only files of a lost content are compared with owned paths
    met = lost.join(files.select("sha256", "path"), "sha256", "left").withColumn("_low", F.lower("path")).join(held, "_low", "left")
    found = met.groupBy("cik", "accn", "sha256").agg(F.array_sort(F.collect_list(F.when(F.col("_held").isNull(), F.col("path")))).alias("paths"))
    return found.withColumn("error", F.when(F.size("paths") == 0, "not found").when(F.size("paths") > hits, "too many"))


def same_content(files: DataFrame, key: str, digest: Column) -> DataFrame:
    """key, sha256, the first key of that content and how many have it."""
    f = files.select(key, digest.alias("sha256"))
    per = f.groupBy("sha256").agg(F.min(key).alias("first_id"), F.count("*").alias("n_paths"))
    return f.join(per, "sha256").select(key, "sha256", "first_id", "n_paths")


def verified(records: DataFrame, found: DataFrame) -> DataFrame:
    """records whose original is on disk with its registered hash; found has path and sha256."""
    return records.join(found.select(F.col("path").alias("original_path"), F.col("sha256").alias("original_hash")), ["original_path", "original_hash"], "left_semi")


def translation_step(records: DataFrame, events: DataFrame) -> DataFrame:
    """records after one event each, events(cik, accn, event, fingerprint, output_hash, found_hash, message), as expressions.

    A record with several events is refused: operators.histories takes them, in order.

    start: reused (complete) where the output of the same fingerprint is there, refused where another
    one is, else translating.  stop: paused for a cancellation or a limit, else failed.  built:
    publishing with the output's hash.  published: complete.  Other events change nothing.
    """
    e = events.select("cik", "accn", "event", F.col("fingerprint").alias("_print"), F.col("output_hash").alias("_out"), F.col("found_hash").alias("_found"), F.lower(F.coalesce("message", F.lit(""))).alias("_why"))
    e = e.groupBy("cik", "accn").agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in e.columns[2:]))
    e = e.withColumn("event", F.when(F.col("_n") > 1, F.raise_error(F.lit("a record has several events")).cast("string")).otherwise(F.col("event"))).drop("_n")
    rows = records.join(e, ["cik", "accn"], "left")
    begin = F.col("event") == "start"
    same = F.col("status").isin("complete", "publishing") & (F.col("fingerprint") == F.col("_print")) & (F.col("output_hash") == F.col("_found"))
    reused, refused = begin & F.coalesce(same, F.lit(False)), begin & F.col("_found").isNotNull() & ~F.coalesce(same, F.lit(False))
    fresh = begin & F.col("_found").isNull()
    stop, built = (F.col("event") == "stop") & (F.col("status") == "translating"), (F.col("event") == "built") & (F.col("status") == "translating")
    status = (
        F.when(reused, "complete").when(fresh, "translating").when(stop & F.col("_why").rlike("cancel|limit|cache only"), "paused").when(stop, "failed")
        .when(built, "publishing").when((F.col("event") == "published") & (F.col("status") == "publishing"), "complete").otherwise(F.col("status"))
    )
    out = rows.withColumns({"outcome": F.when(reused, "reused").when(refused, "refused"), "last_error": F.when(stop, F.col("_why")).when(fresh, None).otherwise(F.col("last_error")) if "last_error" in records.columns else F.when(stop, F.col("_why"))})
    out = out.withColumns({"fingerprint": F.when(fresh, F.col("_print")).otherwise(F.col("fingerprint")), "output_hash": F.when(fresh, None).when(built, F.col("_out")).otherwise(F.col("output_hash"))})
    return out.withColumn("status", status).drop("event", "_print", "_out", "_found", "_why")


def headings(chapters: DataFrame, book: str, company: str, order: list[Column]) -> DataFrame:
    """chapters with heading: whether the company differs from that of the book's chapter before."""
    before = F.lag(F.struct(company)).over(Window.partitionBy(book).orderBy(*order))
    return chapters.withColumn("heading", ~before.eqNullSafe(F.struct(company)))


def closing(rows: DataFrame, key: str, date: str) -> DataFrame:
    """All rows on the newest date of their key."""
    return rows.withColumn("_newest", F.max(date).over(Window.partitionBy(key))).where(F.col(date) == F.col("_newest")).drop("_newest")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Entries of both; a field given (not null) in new replaces the old one."""
    given = new.select(key, *(F.col(f).alias(f"_new_{f}") for f in fields))
    return old.join(given, key, "full_outer").select(key, *(F.coalesce(f"_new_{f}", f).alias(f) for f in fields))


def toggled(entries: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Entries after a toggle of keys: a known one changes enabled, an unknown one is added, enabled."""
    rows = entries.select(key, "enabled").join(keys.select(key, F.lit(True).alias("_hit")).distinct(), key, "full_outer")
    return rows.select(key, F.when(F.col("_hit") & F.col("enabled").isNotNull(), ~F.col("enabled")).otherwise(F.coalesce("enabled", F.lit(True))).alias("enabled"))


def removed(entries: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Entries and keys with outcome: kept, removed, or absent for a key that no entry has, which is no fault.

    keys may repeat; a null key removes nothing and is left out.  The new table is the kept rows.
    """
    asked = keys.where(F.col(key).isNotNull()).select(key, F.lit(True).alias("_asked")).distinct()
    rows = entries.withColumn("_here", F.lit(True)).join(asked, key, "full_outer")
    return rows.withColumn("outcome", F.when(F.col("_here").isNull(), "absent").when(F.col("_asked"), "removed").otherwise("kept")).drop("_asked", "_here")


def found(entries: DataFrame, asked: DataFrame, text: str) -> DataFrame:
    """asked with the entry that its text, any way of writing a cik, names: cik null where the text is none, entry null where nothing is known."""
    known = entries.select(F.col("cik").alias("_cik"), F.struct(*(F.col(c) for c in entries.columns)).alias("entry"))
    rows = asked.withColumn("cik", watch_cik(F.col(text)))
    return rows.join(known, F.col("cik") == F.col("_cik"), "left").drop("_cik")


def tokens_of(df: DataFrame, text: Column, pattern: str = "[0-9][0-9,.]*") -> DataFrame:
    """How often each token (by default, number) occurs in all texts."""
    return df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def multiset_diff(a: DataFrame, b: DataFrame, token: str) -> DataFrame:
    """token, n_a, n_b of tokens whose numbers of occurrences differ; no rows if the multisets are equal."""
    side = lambda df, x, y: df.select(token, F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = side(a, 1, 0).union(side(b, 0, 1)).groupBy(token).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return both.where("n_a <> n_b")


def run_info(outcomes: DataFrame) -> DataFrame:
    """One row for a run of outcomes(cik, outcome, images, bytes): planned, made, reused, no_new, failed, images and bytes."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    return outcomes.agg(F.count("*").alias("planned"), *map(n, ("made", "reused", "no_new", "failed")), F.coalesce(F.sum("images"), F.lit(0)).alias("images"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
