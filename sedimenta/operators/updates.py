"""Incremental downloads: what is new against a baseline, frozen batches, and committing them.

A subscription is a row: cik, enabled, forms, seen (newest first), seen_upto_date (the baseline, a
date), first_run_done, keep_seen and pending (a frozen batch).  Filings are rows: cik, accn, form,
date, and pos, their place in the listing.  The baseline moves on committed success only, so this is
state that a run reads and the next one replaces, not an event-time watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.dates import is_date
from sedimenta.functions.forms import DEFAULT_FORMS, in_forms, normalize_form
from sedimenta.functions.text import watch_cik
from sedimenta.sources.scratch import written

#: Filings of a company that one run takes, and of its first run; accessions that a subscription remembers.
MAX_NEW, FIRST_RUN, KEEP_SEEN = 8, 10, 200
#: Filings of a frozen batch, at most.
BATCH_ROWS = 512
#: Names under which listings carry a field.
ALIASES = {
    "accn": ["accn", "accession_number", "accessionNumber", "accession"],
    "form": ["form", "form_type", "formType"],
    "date": ["date", "filing_date", "filingDate"],
    "primary": ["primary", "primary_document", "primaryDocument"],
    "items": ["items"],
}


def normalized(filings: DataFrame) -> DataFrame:
    """Filings under their usual names, whatever the listing calls them; rows without an accession or a valid cik go."""
    have = set(filings.columns)

    def pick(name: str) -> Column:
        found = [F.col(f"`{c}`").cast("string") for c in ALIASES[name] if c in have]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    rows = filings.select(watch_cik(F.col("cik").cast("string")).alias("cik"), pick("accn").alias("accn"), normalize_form(pick("form")).alias("form"), *(pick(c).alias(c) for c in ("date", "primary", "items")), *(["pos"] if "pos" in have else []))
    return rows.where((F.col("accn") != "") & F.col("cik").isNotNull())


def subscriptions(rows: DataFrame) -> DataFrame:
    """Subscriptions with all fields and their defaults; of rows with one cik the first by pos stays, rows without a valid one go."""
    have = set(rows.columns)
    field = lambda name, kind: (F.col(name) if name in have else F.lit(None)).cast(kind)
    given = rows.withColumn("cik", watch_cik(F.col("cik").cast("string"))).where("cik is not null")
    first = Window.partitionBy("cik").orderBy("pos") if "pos" in have else Window.partitionBy("cik").orderBy(F.lit(0))
    given = given.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    forms = F.filter(F.transform(F.coalesce(field("forms", "array<string>"), F.array().cast("array<string>")), normalize_form), lambda f: f != "")
    date = field("seen_upto_date", "string")
    return given.select(
        "cik", F.coalesce(field("enabled", "boolean"), F.lit(True)).alias("enabled"),
        F.when(F.size(forms) > 0, F.array_distinct(forms)).otherwise(F.array(*map(F.lit, DEFAULT_FORMS))).alias("forms"),
        F.coalesce(field("seen", "array<string>"), F.array().cast("array<string>")).alias("seen"), F.when(is_date(date), date).alias("seen_upto_date"),
        F.coalesce(field("first_run_done", "boolean"), F.lit(False)).alias("first_run_done"), F.coalesce(field("keep_seen", "int"), F.lit(KEEP_SEEN)).alias("keep_seen"),
        field("last_accession", "string").alias("last_accession"), field("last_filing_date", "string").alias("last_filing_date"),
    )


def considered(filings: DataFrame, subs: DataFrame, *, since: str | None = None, exact: bool = False, only_enabled: bool = True) -> DataFrame:
    """Filings of subscriptions, each accession once (the first of the listing), with dropped: older than since.

    hit marks those of a subscription's forms; all others of a company are one row without an
    accession.  What a subscription remembers is asked before rows are shuffled and stays behind.  A
    since without the shape of a date drops nothing; nor do rows whose date has not.
    """
    wanted = subs.where(F.coalesce("enabled", F.lit(True))) if only_enabled else subs
    untouched = F.col("seen_upto_date").isNull() & (F.size("seen") == 0) & ~F.coalesce("first_run_done", F.lit(False))
    state = wanted.select("cik", "forms", F.col("seen").alias("_seen"), F.col("seen_upto_date").alias("baseline"), untouched.alias("untouched"))
    rows = filings.join(state, "cik").withColumn("hit", F.coalesce(in_forms(F.col("form"), F.col("forms"), exact), F.lit(False)))
    rows = rows.select("cik", "hit", F.when(F.col("hit"), F.col("accn")).alias("accn"), "form", "date", "pos", F.array_contains("_seen", F.col("accn")).alias("seen"), "baseline", "untouched")
    one = rows.groupBy("cik", "hit", "accn").agg(F.min_by(F.struct("form", "date", "seen", "baseline", "untouched"), "pos").alias("f"), F.count("*").alias("times"))
    strict = F.lit(since).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") if since else F.lit(False)
    return one.select("cik", "hit", "accn", "f.*", "times").withColumn("dropped", strict & is_date(F.col("date")) & (F.col("date") < F.lit(since or "")))


def plan(filings: DataFrame, subs: DataFrame, *, max_new: int = MAX_NEW, first_run_new: int = FIRST_RUN, since: str | None = None, exact: bool = False, only_enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(new: cik, accn, form, date, pos from 1, newest first; updates: one row for each subscription).

    New is what is not seen, and not older than the baseline; a date of another shape passes and is
    counted.  On a first run (no baseline, nothing seen, none done) what is above the cap becomes
    history, later it is truncated and comes again.  closing lists the accessions of the newest date,
    if nothing was truncated.  A subscription without any listing has a warning and zeros.

    Filings are read once, when this is called: a narrow table of those considered, written to the
    shared folder, serves both results and all that is made of them.
    """
    rows = considered(filings, subs, since=since, exact=exact, only_enabled=only_enabled)
    date, valid = F.col("date"), is_date(F.col("date"))
    old = F.coalesce(valid & (date < F.col("baseline")), F.lit(False))
    kind = F.when(~F.col("hit"), "other").when(F.col("dropped"), "since").when(F.col("seen"), "seen").when(old, "history").otherwise("new")
    rows = written(rows.select("cik", "hit", "accn", "form", "date", kind.alias("kind"), "untouched", "times"), "considered")
    cap = F.when(F.col("untouched"), min(first_run_new, max_new)).otherwise(max_new)
    by = Window.partitionBy("cik").orderBy(F.desc("date"), F.desc("accn"))
    new = rows.where("kind = 'new'").withColumn("pos", F.row_number().over(by)).where((F.col("pos") <= max_new) & (F.col("pos") <= cap))
    new = new.select("cik", "accn", "form", "date", "pos")

    # a company's dates first: what is collected is one day's, and a company with most of the rows is summed in parts
    kept = F.col("hit") & (F.col("kind") != "since")
    days = rows.groupBy("cik", "date").agg(
        F.count_if(kept).alias("total_known"), *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("new", "n_unseen"), ("history", "n_history"), ("since", "since_skipped"))),
        F.sum(F.when(F.col("hit"), F.col("times") - 1).otherwise(0)).alias("duplicates"), F.count_if(kept & ~F.coalesce(valid, F.lit(False)) & (F.col("kind") != "seen")).alias("bad_dates"),
        F.array_sort(F.collect_list(F.when(kept, F.col("accn")))).alias("accns"), F.max(F.when(kept, F.col("accn"))).alias("accn"), F.max(F.when(F.col("hit"), F.col("untouched"))).alias("untouched"),
    )
    sums = ["total_known", "n_unseen", "n_history", "since_skipped", "duplicates", "bad_dates"]
    some = F.col("total_known") > 0
    per = days.select("*", some.alias("_some")).groupBy("cik").agg(*(F.sum(c).alias(c) for c in sums), F.max(F.when(F.col("_some"), F.struct("date", "accn"))).alias("newest"), F.max_by("accns", F.when(F.col("_some"), F.col("date"))).alias("accns"), F.max("untouched").alias("untouched"), F.lit(True).alias("listed"))
    wanted = subs.where(F.coalesce("enabled", F.lit(True))) if only_enabled else subs
    up = wanted.select("cik", F.col("seen_upto_date").alias("baseline_date")).join(per, "cik", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    n, first = zero("n_unseen"), F.coalesce(F.col("untouched") & (F.col("n_unseen") > 0), F.lit(False))
    most = F.when(first, min(first_run_new, max_new)).otherwise(max_new)
    over = F.greatest(n - most, F.lit(0))
    date_of = F.when(is_date(F.col("newest.date")), F.col("newest.date"))
    none = F.array().cast(rows.select(F.array("accn").alias("a")).schema["a"].dataType)
    up = up.select(
        "cik", F.least(n, most).cast("long").alias("new_count"), first.alias("first_run"), zero("total_known").alias("total_known"), F.when(first, F.lit(0)).otherwise(over).cast("long").alias("truncated"),
        (zero("n_history") + F.when(first, over).otherwise(F.lit(0))).cast("long").alias("history_skipped"), zero("since_skipped").alias("since_skipped"), zero("duplicates").alias("duplicates"), zero("bad_dates").alias("bad_dates"),
        "baseline_date", F.when(first | (over == 0), date_of).alias("baseline_new_date"), F.col("newest.date").alias("latest_filing"), F.col("newest.accn").alias("latest_accession"),
        F.when(F.col("listed").isNull(), "no metadata").alias("warning"), "accns",
    )
    return new, up.withColumn("closing", F.when(F.col("baseline_new_date").isNotNull(), F.col("accns")).otherwise(none)).drop("accns")


def mark_seen(subs: DataFrame, marks: DataFrame) -> DataFrame:
    """Subscriptions after marks(cik, accns, upto_date, newest): unseen accessions in front, largest first, the oldest beyond keep_seen go.

    The baseline moves forward only, and only to a date.  Marks have one row for a cik.
    """
    return _marked(subs, marks.select("cik", "accns", "upto_date", "newest")).select(*subs.columns)


def _marked(subs: DataFrame, marks: DataFrame) -> DataFrame:
    rows = subs.join(marks, "cik", "left")
    none = F.array().cast("array<string>")
    fresh = F.reverse(F.array_sort(F.array_distinct(F.array_except(F.filter(F.coalesce("accns", none), lambda a: a != ""), F.coalesce("seen", none)))))
    merged = F.slice(F.concat(fresh, F.coalesce("seen", none)), F.lit(1), F.coalesce("keep_seen", F.lit(KEEP_SEEN)))
    upto = F.when(is_date(F.col("upto_date")), F.col("upto_date"))
    return rows.withColumns({"seen": merged, "seen_upto_date": F.greatest("seen_upto_date", upto), "last_accession": F.coalesce("newest", "last_accession")})


def commit(subs: DataFrame, new: DataFrame, updates: DataFrame) -> DataFrame:
    """Subscriptions after a run whose filings all succeeded: new and closing accessions are seen, the baseline moves where nothing was truncated."""
    got = new.groupBy("cik").agg(F.collect_list("accn").alias("accns"))
    upto = F.when(F.col("truncated") == 0, F.coalesce("baseline_new_date", "latest_filing"))
    marks = updates.join(got, "cik", "left").select("cik", F.concat(F.coalesce("accns", F.array().cast("array<string>")), "closing").alias("accns"), upto.alias("upto_date"), F.col("latest_accession").alias("newest"), F.col("latest_filing"))
    marks = marks.withColumn("newest", F.when((F.size("accns") > 0) | F.col("upto_date").isNotNull(), F.col("newest")))
    out = _marked(subs, marks.withColumn("_done", F.lit(True)))
    out = out.withColumns({"first_run_done": F.col("first_run_done") | F.coalesce("_done", F.lit(False)), "last_filing_date": F.coalesce("latest_filing", "last_filing_date")})
    return out.select(*subs.columns)


def record_seen(subs: DataFrame, new: DataFrame, updates: DataFrame, done: DataFrame) -> DataFrame:
    """Subscriptions after a run, done(cik, accn) being what succeeded: a commit where all did, else those are seen and the baseline stays."""
    left = new.join(done, ["cik", "accn"], "left_anti").select("cik").distinct()
    whole = updates.join(left, "cik", "left_anti")
    part = new.join(done, ["cik", "accn"], "left_semi").join(left, "cik", "left_semi").groupBy("cik").agg(F.collect_list("accn").alias("accns"))
    marks = part.select("cik", "accns", F.lit(None).cast("string").alias("upto_date"), F.lit(None).cast("string").alias("newest"))
    return mark_seen(commit(subs, new.join(left, "cik", "left_anti"), whole), marks)


def reset(subs: DataFrame, cik: str | None = None) -> DataFrame:
    """Subscriptions without what they have seen, for one cik or for all; what they want stays."""
    hit = F.lit(True) if cik is None else F.col("cik") == watch_cik(F.lit(cik))
    fresh = {"seen": F.array().cast("array<string>"), "first_run_done": F.lit(False)} | {c: F.lit(None).cast("string") for c in ("seen_upto_date", "last_accession")}
    return subs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in fresh.items()})


def resume(batch: DataFrame, completed: DataFrame) -> DataFrame:
    """What is left of frozen batches, in their order."""
    left = batch.join(completed, ["cik", "accn"], "left_anti")
    return left.withColumn("next", F.row_number().over(Window.partitionBy("cik").orderBy("pos")))


def signature(forms: Column, since: str | None = None, reports: bool = False) -> Column:
    """A digest of what a subscription selects; counts are not part of it, so changing them does not break a batch."""
    return F.sha2(F.concat_ws("\n", F.array_join(forms, ","), F.lit(since or ""), F.lit(str(reports))), 256)


def _seal(batch: Column | None = None) -> Column:
    """A digest over a frozen batch's fields."""
    ids = F.transform("filings", lambda f: F.concat_ws("|", f["accn"], f["form"], f["date"]))
    return F.sha2(F.concat_ws("\n", "cik", F.array_join(ids, ","), F.array_join("completed", ","), "signature", F.coalesce("baseline_date", F.lit("")), F.coalesce("baseline_new_date", F.lit("")), F.col("truncated").cast("string"), F.col("first_run").cast("string"), F.array_join("closing", ",")), 256)


def freeze(subs: DataFrame, new: DataFrame, updates: DataFrame, held: DataFrame | None = None, *, since: str | None = None, reports: bool = False) -> DataFrame:
    """Batches of the subscriptions that have new filings: the plan as it is, nothing completed, signed and sealed.

    held are batches that exist; their subscriptions get no other.  Batches are of BATCH_ROWS filings at most.
    """
    files = new.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("pos", "accn", "form", "date"))).alias("filings")).where(F.size("filings") <= BATCH_ROWS)
    wanted = updates if held is None else updates.join(held.select("cik"), "cik", "left_anti")
    out = wanted.join(files, "cik").join(subs.select("cik", "forms"), "cik")
    out = out.withColumns({"completed": F.array().cast("array<string>"), "signature": signature(F.col("forms"), since, reports)}).drop("forms")
    return out.withColumn("seal", _seal())


def checked(batches: DataFrame, subs: DataFrame, *, since: str | None = None, reports: bool = False) -> DataFrame:
    """batches with error: why a batch may not go on (null if it may); the first that holds.

    broken: the seal, the dates' bounds or the filings do not fit; baseline: the subscription has moved
    on; selection: it now selects something else.
    """
    now = subs.select("cik", F.col("seen_upto_date").alias("_baseline"), signature(F.col("forms"), since, reports).alias("_signature"))
    accns = F.transform("filings", lambda f: f["accn"])
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    bounds = F.when(F.col("truncated") == 0, same("baseline_new_date", "latest_filing")).otherwise(F.col("baseline_new_date").isNull())
    files = (F.size("filings") > 0) & (F.size(F.array_distinct(accns)) == F.size("filings")) & F.forall("filings", lambda f: (f["form"] != "") & is_date(f["date"])) & (F.size(F.array_except("completed", accns)) == 0)
    whole = F.coalesce((F.col("seal") == _seal()) & bounds & files & (F.size(F.array_distinct("completed")) == F.size("completed")), F.lit(False))
    error = F.when(~whole, "broken").when(~same("baseline_date", "_baseline"), "baseline").when(F.col("signature") != F.col("_signature"), "selection")
    return batches.join(now, "cik", "left").withColumn("error", error).drop("_baseline", "_signature")


def complete(batches: DataFrame, subs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, subscriptions) after done(cik, accn): its filings are seen, and a batch whose filings are all completed is committed and goes.

    Rows that belong to no batch are ignored.
    """
    ids = done.groupBy("cik").agg(F.collect_set("accn").alias("_done"))
    accns = F.transform("filings", lambda f: f["accn"])
    after = batches.join(ids, "cik", "left")
    hit = F.array_sort(F.array_intersect(accns, F.coalesce("_done", F.array().cast("array<string>"))))
    after = after.withColumn("_hit", hit).withColumn("completed", F.concat("completed", F.array_except("_hit", "completed")))
    over = F.size("completed") == F.size("filings")
    marks = after.select("cik", F.col("_hit").alias("accns"), F.lit(None).cast("string").alias("upto_date"), F.lit(None).cast("string").alias("newest"))
    ended = after.where(over)
    new = ended.select("cik", F.explode(F.transform("filings", lambda f: f["accn"])).alias("accn"))
    return after.where(~over).drop("_done", "_hit").withColumn("seal", _seal()), commit(mark_seen(subs, marks), new, ended)


def plan_run(companies: DataFrame, updates: DataFrame, errors: DataFrame, batches: DataFrame, picked: DataFrame) -> DataFrame:
    """companies(cik, enabled, legacy_progress) with source: where a run takes each one's filings from.

    An explicitly picked filing comes first, then a frozen batch, then a refusal where an older
    format's progress is left, then a metadata error, then the plan, then nothing (disabled or no news).
    """
    flag = lambda df, name: df.select("cik", F.lit(True).alias(name)).distinct()
    out = companies
    for df, name in ((picked, "_picked"), (batches, "_batch"), (errors, "_error"), (updates.where("new_count > 0"), "_new"), (updates, "_update")):
        out = out.join(flag(df, name), "cik", "left")
    out = out.withColumn("source", F.when(F.col("_picked"), "picked").when(F.col("_batch"), "queue").when(F.col("legacy_progress"), "refused").when(F.col("_error"), "error").when(F.col("_new"), "plan").when(F.col("_update"), "no_new").when(~F.col("enabled"), "disabled").otherwise("unknown"))
    return out.drop("_picked", "_batch", "_error", "_new", "_update")


def summary_line() -> Column:
    """One readable line for a row of updates."""
    part = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(f" {what}")))
    return F.concat_ws(", ", F.concat(F.lit("CIK "), "cik"), F.concat(F.col("new_count").cast("string"), F.lit(" new")), F.when(F.col("first_run"), "first run"), part("truncated", "left for later"), part("history_skipped", "history"), part("since_skipped", "too old"), F.col("warning"))


def shifted_progress(old: Column, old_size: Column, new_size: Column) -> Column:
    """Reading progress after text was put in front: null where a size or the progress is missing."""
    ratio = F.least(F.lit(1.0), old_size / new_size)
    return F.when((old > 0) & (old_size > 0) & (new_size > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - ratio) + old * ratio)))
