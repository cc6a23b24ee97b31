"""Listing filings: column dictionaries, shards, filters, budgets, histograms, ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.dates import SHAPE
from sedimenta.functions.forms import is_report, matches_form, passes
from sedimenta.functions.text import looks_like_json
from sedimenta.sources.scratch import written

#: Fields of a listing's column dictionary, those of a filing in the same order, and shard names.
COLUMNS = ["form", "filingDate", "reportDate", "accessionNumber", "primaryDocument", "primaryDocDescription", "items"]
FIELDS = ["form", "date", "report_date", "accn", "primary", "description", "items"]
SHARD = r"^CIK[0-9]+-submissions-[0-9]+\.json$"

_COLS = ", ".join([*(f"{c}: array<string>" for c in COLUMNS), "size: array<bigint>"])
_LISTING = f"struct<name: string, tickers: array<string>, filings: struct<recent: struct<{_COLS}>, files: array<struct<name: string, filingFrom: string, filingTo: string>>, {_COLS}>, {_COLS}>"


@dataclass(frozen=True)
class Filter:
    """What a listing returns; a value that cannot be meant raises ValueError."""

    forms: Sequence[str] = ()
    since: str | None = None
    until: str | None = None
    limit: int | None = None
    amendments: bool | str = True
    mode: str = "boundary"
    max_total: int = 5000
    max_extra: int = 8
    wanted: list[str] = field(init=False)

    def __post_init__(self):
        import re

        if not isinstance(self.forms, (str, list, tuple)):
            raise ValueError("forms must be a text or a list of texts")
        forms = [self.forms] if isinstance(self.forms, str) else [f.strip().upper() for f in self.forms if isinstance(f, str) and f.strip()]
        object.__setattr__(self, "wanted", forms)
        for name in ("since", "until"):
            x = getattr(self, name)
            if x is not None and not (isinstance(x, str) and re.match(SHAPE, x)):
                raise ValueError(f"{name} must be like 2024-01-31")
        if self.limit is not None and self.limit < 1 or self.max_total < 1 or self.max_extra < 0:
            raise ValueError("limit and max_total must be 1 at least, max_extra 0")
        if self.amendments not in (True, False, "only") or self.mode not in ("boundary", "exact", "prefix"):
            raise ValueError("amendments must be True, False or 'only', mode boundary, exact or prefix")

    def dates(self, date: Column) -> Column:
        """Inclusive bounds on text dates; an empty date fails any bound."""
        out = F.lit(True)
        if self.since:
            out = out & (date != "") & (date >= self.since)
        return out & (date != "") & (date <= self.until) if self.until else out

    def passing(self, form: Column) -> Column:
        return passes(form, self.wanted, self.amendments, self.mode)


def parsed(sources: DataFrame, body: str = "body") -> DataFrame:
    """sources with name, tickers, files and cols (its column dictionary, null if there is none) from a JSON body.

    A listing holds the dictionary under filings.recent, a rarer one under filings, a shard at its top.
    """
    x = F.when(looks_like_json(F.col(body)), F.from_json(body, _LISTING, {"mode": "PERMISSIVE"}))
    rows = sources.withColumn("_x", x)
    pack = lambda at: F.struct(*(F.col(f"{at}.{c}").alias(c) for c in [*COLUMNS, "size"]))
    cols = F.when(F.col("_x.filings.recent.form").isNotNull(), pack("_x.filings.recent")).when(F.col("_x.filings.form").isNotNull(), pack("_x.filings")).when(F.col("_x.form").isNotNull(), pack("_x"))
    return rows.select(*sources.columns, F.nullif(F.col("_x.name"), F.lit("")).alias("company"), F.col("_x.tickers").alias("tickers"), F.col("_x.filings.files").alias("files"), cols.alias("cols"))


def zip_columns(df: DataFrame, keys: list[str], names: list[str], lead: str) -> DataFrame:
    """Parallel arrays to rows with their position; missing arrays and cells become empty strings, lead gives the length."""
    arrays = F.arrays_zip(*(F.coalesce(F.col(n), F.array().cast("array<string>")).alias(n) for n in names))
    rows = df.withColumn("_n", F.size(F.coalesce(F.col(lead), F.array().cast("array<string>")))).select(*keys, "_n", F.posexplode(arrays).alias("row_pos", "_row"))
    return rows.where("row_pos < _n").select(*keys, "row_pos", *(F.coalesce(F.col(f"_row.{n}"), F.lit("")).alias(n) for n in names))


def filings_of(sources: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of parsed sources: keys, row_pos, FIELDS and size."""
    flat = sources.where("cols is not null").select(*keys, *(F.col(f"cols.{c}").alias(c) for c in COLUMNS), F.transform("cols.size", lambda n: n.cast("string")).alias("size"))
    rows = zip_columns(flat, keys, [*COLUMNS, "size"], "form")
    return rows.select(*keys, "row_pos", *(F.col(c).alias(f) for c, f in zip(COLUMNS, FIELDS, strict=True)), F.coalesce(F.try_to_number("size", F.lit("999999999999")).cast("long"), F.lit(0)).alias("size"))


def scanned(rows: DataFrame, part: str, order: list[Column], hit: Column, budget: int, key: str | None = None) -> DataFrame:
    """Rows that a scan meets, in order: with duplicate, returned, and tripped on the one that ends it.

    A row whose key was met before is a duplicate; an empty key is never one.  The scan stops at the
    first row that is no duplicate after budget rows were returned; that row is met, not returned.
    """
    again = F.lit(False)
    if key:
        again = (F.col(key) != "") & (F.row_number().over(Window.partitionBy(part, key).orderBy(*order)) > 1)
    rows = rows.withColumn("duplicate", again)
    rows = rows.withColumn("_hit", (~F.col("duplicate") & hit).cast("int"))
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_full", F.coalesce(F.sum("_hit").over(before), F.lit(0)) >= budget)
    rows = rows.withColumn("_over", (F.col("_full") & ~F.col("duplicate")).cast("int"))
    rows = rows.withColumn("_past", F.coalesce(F.sum("_over").over(before), F.lit(0)))
    rows = rows.where("_past = 0").withColumns({"tripped": F.col("_over") == 1, "returned": (F.col("_hit") == 1) & ~F.col("_full")})
    return rows.drop("_hit", "_full", "_over", "_past")


def list_filings(sources: DataFrame, flt: Filter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, envelopes, histograms) of companies.

    sources: cik, source_pos (0: the main listing, then its shards, newest first), name, filing_to,
    body (JSON, null if it could not be got), error.  Shards are read in order until the budget is
    full, max_extra good ones were read, or one ends before since; badly named and unreadable ones
    are failures.  Entries are ranked by date and accession, newest first, up to the limit.
    Histograms have a row for each form and scope: all (met), window (dates and amendments only),
    entries.  A main listing without a dictionary has an envelope with an error and no rows.  Two
    tables in the shared folder, of parsed listings and of rows met, are written when this is called.
    """
    keys = ["cik", "source_pos"]
    # bodies are parsed once; a second table holds what the scans met
    src = written(parsed(sources).withColumn("lost", F.col("body").isNull()).drop("body"), "listings")
    named = (F.col("source_pos") == 0) | F.coalesce(F.col("name").rlike(SHARD), F.lit(False))
    src = src.withColumn("_good", named & F.col("cols").isNotNull()).withColumn("_lost", named & F.col("lost"))
    before = Window.partitionBy("cik").orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1)
    shard = F.col("source_pos") > 0
    full = shard & (F.coalesce(F.sum((F.col("_good") & shard).cast("int")).over(before), F.lit(0)) >= flt.max_extra)
    old = shard & F.coalesce(F.col("filing_to") < F.lit(flt.since), F.lit(False)) if flt.since else F.lit(False)
    src = src.withColumn("_stop", F.when(full, "extra").when(old, "since"))
    src = src.withColumn("_ended", F.first("_stop", ignorenulls=True).over(Window.partitionBy("cik").orderBy("source_pos").rowsBetween(Window.unboundedPreceding, 0)))
    main = src.where("source_pos = 0").select("cik", "company", "tickers", F.col("_good").alias("ok"))
    src = src.join(main.where("ok").select("cik"), "cik", "left_semi")
    rest = src.drop("cols", "files", "company", "tickers")

    order = [F.col("source_pos"), F.col("row_pos")]
    rows = filings_of(src.where("_good and _ended is null"), keys)
    hit = flt.passing(F.col("form")) & flt.dates(F.col("date"))
    rows = scanned(rows, "cik", order, hit, flt.max_total, "accn")
    rows = written(rows.withColumn("in_window", ~F.col("duplicate") & flt.dates(F.col("date")) & passes(F.col("form"), [], flt.amendments)), "scanned")

    by = Window.partitionBy("cik").orderBy(F.desc("date"), F.desc("accn"), *order)
    ranked_ = rows.where("returned").withColumn("rank", F.row_number().over(by))
    entries = (ranked_.where(F.col("rank") <= flt.limit) if flt.limit else ranked_).select("cik", "rank", *FIELDS, "size")

    per = rows.groupBy("cik").agg(F.count_if(~F.col("duplicate")).alias("scanned"), F.count_if("returned").alias("matched_before_limit"), F.count_if("duplicate").alias("duplicates"), F.max("tripped").alias("budget_full"), F.max(F.when(F.col("tripped"), F.col("source_pos"))).alias("_trip"))
    used = rest.join(per.select("cik", "_trip"), "cik", "left").withColumn("_met", F.col("_ended").isNull() & (F.col("_trip").isNull() | (F.col("source_pos") <= F.col("_trip"))))
    sums = used.groupBy("cik").agg(
        F.count("*").alias("sources_total"), F.count_if(F.col("_met") & F.col("_good")).alias("sources_used"), F.count_if(F.col("_met") & ~F.col("_good")).alias("sources_failed"), F.count_if(~F.col("_met")).alias("sources_skipped"),
        F.max(F.col("_met") & F.col("_lost")).alias("_lost"), F.max(F.when(F.col("_trip").isNull(), F.col("_ended"))).alias("_why"),
    )
    env = main.join(sums, "cik", "left").join(per, "cik", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False))
    matched = F.coalesce("matched_before_limit", F.lit(0))
    cut = matched > flt.limit if flt.limit else F.lit(False)
    env = env.select(
        "cik", "company", "tickers", F.when(~F.col("ok"), "no listing").alias("error"), zero("scanned"), zero("duplicates"), zero("matched_before_limit"), (F.least(matched, F.lit(flt.limit)) if flt.limit else matched).cast("long").alias("matched"),
        zero("sources_total"), zero("sources_used"), zero("sources_failed"), zero("sources_skipped"), flag(F.col("budget_full")).alias("budget_full"), flag(F.col("_why") == "since").alias("stopped_by_since"),
        (flag(F.col("budget_full")) | flag(F.col("_why") == "extra") | flag(F.col("_lost")) | cut).alias("truncated"),
    )
    scope = F.when(F.col("truncated") | (F.col("sources_failed") > 0), "partial").when(F.col("stopped_by_since"), "since_window").otherwise("full")
    env = env.withColumn("scope", F.when(F.col("error").isNull(), scope))

    shown = entries.groupBy("cik", "form").agg(F.count("*").alias("n_entries"))
    hist = rows.where("not duplicate").groupBy("cik", "form").agg(F.count("*").alias("n_all"), F.count_if("in_window").alias("n_window"))
    hist = hist.join(shown, ["cik", "form"], "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0).cast("long")))
    return entries, env, hist


def recent_filings(sources: DataFrame, n: int) -> DataFrame:
    """The first n reports (8-K, 10-K, 10-Q and forms that begin so) of each main listing, in its order."""
    rows = filings_of(parsed(sources.where("source_pos = 0")), ["cik"]).where(is_report(F.col("form")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("cik").orderBy("row_pos"))).where(F.col("rank") <= n)


def refiltered(entries: DataFrame, envelopes: DataFrame, flt: Filter) -> DataFrame:
    """Entries filtered anew without a new listing: only of companies whose listing is whole (neither truncated nor with failed sources)."""
    whole = envelopes.where("error is null and not truncated and sources_failed = 0").select("cik")
    return entries.join(whole, "cik", "left_semi").where(flt.passing(F.col("form")) & flt.dates(F.col("date")))


def first_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with an empty key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) | (F.col(key).cast("string") == "")).drop("_k")


def histogram(df: DataFrame, form: str, in_window: Column, in_entries: Column) -> DataFrame:
    """Counts by form: all rows, those in the window, those returned."""
    return df.groupBy(F.col(form).alias("form")).agg(F.count("*").alias("n_all"), F.count_if(in_window).alias("n_window"), F.count_if(in_entries).alias("n_entries"))


def menu_counts(counts: DataFrame) -> DataFrame:
    """For each form the sum over all forms that match it; counts(form, n) is a histogram, one row for each form.

    A blank form, or *, matches all.
    """
    a, b = counts.alias("a"), counts.alias("b")
    every = lambda c: F.trim(c).isin("", "*")
    # a form matches by its beginning only, so both sides share the first word up to a boundary
    word = lambda c: F.regexp_extract(F.upper(F.trim(c)), r"^([^/ -]*)", 1)
    some = a.where(~every(F.col("a.form"))).join(b, (word(F.col("a.form")) == word(F.col("b.form"))) & matches_form(F.col("b.form"), F.col("a.form")))
    total = F.broadcast(counts.agg(F.sum("n").alias("n_menu")))  # one row
    whole = counts.where(every(F.col("form"))).select("form").join(total, F.lit(True))
    return some.groupBy(F.col("a.form").alias("form")).agg(F.sum("b.n").alias("n_menu")).unionByName(whole)


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows with their rank; the sort keeps n rows a task."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """One page of rows with their rank; a number below the first or beyond the last page gives that page."""
    n = df.count()
    number = min(max(1, number), max(1, -(-n // size)))
    return ranked(df, order, number * size).where(F.col("rank") > (number - 1) * size)


#: Names of an 8-K's exhibits with results, of pages that a viewer renders, and of documents.
EXHIBIT, RENDERED, DOCUMENT = r"(?i)ex-?99|exhibit.*99|99.*exhibit", r"(?i)^r[0-9]+\.html?$", r"(?i)\.html?$"


def pick_document(files: DataFrame, key: str, name: str, size: str, form: Column, primary: Column) -> DataFrame:
    """One document of each filing with prio: for an 8-K the largest exhibit 99 (0), then the primary (1), then the largest (2); ties by name.

    Only names that end in .htm or .html count, but for a viewer's pages.
    """
    rows = files.where(F.col(name).rlike(DOCUMENT) & ~F.col(name).rlike(RENDERED))
    prio = F.when(F.startswith(form, F.lit("8-K")) & F.col(name).rlike(EXHIBIT), 0).when(F.lower(name) == F.lower(primary), 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(prio, F.desc(size), name)
    return rows.withColumn("prio", prio).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def content_source(filings: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """filings(key, form, primary) with document and via: an 8-K reads its folder first, others their primary; the primary is the last resort."""
    rows = filings.join(picked.select(key, F.col("name").alias("_name")), key, "left")
    own = F.nullif(F.col("primary"), F.lit(""))
    first = F.startswith("form", F.lit("8-K"))
    return rows.withColumns({"document": F.when(first, F.coalesce("_name", own)).otherwise(F.coalesce(own, "_name")), "via": F.when(F.when(first, F.col("_name").isNotNull()).otherwise(own.isNull()), "folder").otherwise("primary")}).drop("_name")
