"""Reported facts: units, restatements, tag fallback, windows of recent periods, reports.

A fact is a row: cik, tag, unit, start, end, val, accn, form, filed (dates are text), and pos, its
place in the answer it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.dates import day, is_date
from sedimenta.functions.periods import caliber, money, per_share, period_label, range_label, scale, text_days
from sedimenta.functions.text import archive_url, looks_like_json
from sedimenta.sources.scratch import written

#: Metrics in order, with their kind, the unit wanted, and the tags to try in order.
METRICS = [
    ("revenue", "duration", "USD", ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"]),
    ("operating_income", "duration", "USD", ["OperatingIncomeLoss"]),
    ("net_income", "duration", "USD", ["NetIncomeLoss", "ProfitLoss"]),
    ("eps_diluted", "duration", "USD/shares", ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"]),
    ("operating_cash_flow", "duration", "USD", ["NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]),
    ("assets", "instant", "USD", ["Assets"]),
    ("liabilities", "instant", "USD", ["Liabilities"]),
    ("cash", "instant", "USD", ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"]),
]
#: Days before a metric's newest period that are shown, and rows shown of each group.
RECENT_DAYS, SHOWN = 1100, {"Q": 8, "I": 8, "CUM": 6, "OTHER": 4}

_FACT = "struct<start: string, end: string, val: decimal(38,6), accn: string, fy: int, fp: string, form: string, filed: string, frame: string>"


def definitions(spark: SparkSession, metrics=METRICS) -> DataFrame:
    """metric_pos, metric, kind, want (unit), tag, tag_rank: one row for each tag of each metric; facts meet them where they lie, as by tag they would meet in few tasks."""
    rows = [(k, m, kind, unit, tag, r + 1) for k, (m, kind, unit, tags) in enumerate(metrics) for r, tag in enumerate(tags)]
    return F.broadcast(spark.createDataFrame(rows, "metric_pos int, metric string, kind string, want string, tag string, tag_rank int"))


def all_tags(defs: DataFrame) -> DataFrame:
    """Each tag once, in the order of its first use."""
    return defs.groupBy("tag").agg(F.min(F.struct("metric_pos", "tag_rank")).alias("_first")).orderBy("_first").select("tag")


def facts(bodies: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """The facts of concept answers (JSON with units): keys, unit, n_unit (facts of that unit) and the fact's fields."""
    x = F.when(looks_like_json(F.col(body)), F.from_json(body, f"struct<units: map<string, array<{_FACT}>>>"))
    rows = bodies.select(*keys, F.explode(x["units"]).alias("unit", "_facts"))
    return rows.select(*keys, "unit", F.posexplode("_facts").alias("pos", "_f")).select(*keys, "unit", "pos", "_f.*")


def pick_unit(rows: DataFrame, keys: list[str], want: str = "want") -> DataFrame:
    """Facts of one unit of each key: the wanted one, else the first by name."""
    units = rows.groupBy(*keys).agg(F.min(F.when(F.col("unit") == F.col(want), F.col("unit"))).alias("_own"), F.min("unit").alias("_first"))
    return rows.join(units.select(*keys, F.coalesce("_own", "_first").alias("unit")), [*keys, "unit"])


def valid(kind: Column) -> Column:
    """Whether a fact counts: it has an end and a value, and a start if it is of a duration."""
    return F.col("end").isNotNull() & F.col("val").isNotNull() & ((kind != "duration") | F.col("start").isNotNull())


def choose(facts: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The latest fact of each period, how many were folded, and the last differing earlier value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = facts.withColumn("_k", F.row_number().over(w)).withColumn("_chosen", F.first(value).over(whole)).withColumn("folded", F.count("*").over(Window.partitionBy(*keys)) - 1)
    df = df.withColumn("prev", F.first(F.when(F.col(value) != F.col("_chosen"), F.col(value)), ignorenulls=True).over(whole))
    return df.where("_k = 1").withColumn("revised", F.col("prev").isNotNull()).drop("_k", "_chosen")


def periods(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(periods, info) of facts with keys, kind and want: one row for each period, and one for each key.

    Of a period's facts the last filed counts, then the larger accession, then the first in the
    answer.  caliber is I for points in time, else by the days, null for none.  info counts facts,
    those skipped, periods, those with several facts and with differing ones, and has their bounds;
    error is set where no fact has a unit's period.  Facts are read and dealt once, by keys; the periods,
    with a row for the skipped facts of each key, are a table, written once when this is called, as
    info and reports are made of them.
    """
    rows = rows.where(" and ".join(f"{k} is not null" for k in [*keys, "unit"])).withColumn("_ok", valid(F.col("kind")))
    span = F.when(F.col("kind") == "duration", F.concat_ws("|", "start", "end")).otherwise(F.col("end"))
    rows = rows.withColumn("_span", F.when(F.col("_ok"), span)).repartition(*keys)
    key = [*keys, "unit", "_span"]
    w = Window.partitionBy(*key).orderBy(F.desc(F.coalesce("filed", F.lit(""))), F.desc(F.coalesce("accn", F.lit(""))), F.col("pos"))
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_val", F.first("val").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in rows.columns if c not in (*key, "_k", "_val", "_ok")]
    per = rows.groupBy(*key).agg(
        F.first(F.when(F.col("_k") == 1, F.struct(*rest)), ignorenulls=True).alias("_row"), F.min_by("val", F.when(F.col("val") != F.col("_val"), F.col("_k"))).alias("prev"),
        F.count("*").alias("_n"), F.count_if(~F.col("_ok")).alias("_skipped"), F.min(F.when(F.col("unit") == F.col("want"), F.col("unit"))).alias("_own"),
    )
    of = Window.partitionBy(*keys)
    per = per.withColumn("_unit", F.coalesce(F.min("_own").over(of), F.min("unit").over(of))).where("unit = _unit")
    good = F.col("_span").isNotNull()
    per = per.select(*key, *(F.when(good, F.col("_row")[c]).alias(c) for c in rest), F.when(good, F.col("prev")).alias("prev"), (F.col("_n") - 1).alias("folded"), "_n", "_skipped")
    days = F.when(F.col("kind") == "duration", text_days(F.col("start"), F.col("end")))
    per = per.withColumn("revised", F.col("prev").isNotNull()).withColumn("days", days).withColumn("caliber", F.when(F.col("kind") == "duration", caliber(F.col("days"))).otherwise("I"))
    by = of.orderBy(F.desc("end"), F.desc(F.coalesce("start", F.lit(""))))  # facts that are skipped have no end here and come last
    per = written(per.withColumn("period_pos", F.row_number().over(by)), "periods")
    info = per.groupBy(*keys, "unit").agg(
        F.sum("_n").alias("entries"), F.sum("_skipped").alias("skipped"), F.count_if(good).alias("periods"), F.count_if(good & (F.col("folded") > 0)).alias("dup_groups"), F.count_if(good & F.col("revised")).alias("revised"),
        F.max("end").alias("newest"), F.min("end").alias("oldest"),
    )
    return per.where(good).drop("_span", "_n", "_skipped"), info.withColumn("error", F.when(F.col("periods") == 0, "no period"))


def candidates(defs: DataFrame, companies: DataFrame, info: DataFrame, errors: DataFrame) -> DataFrame:
    """Every tag of every metric for each company with its status, the chosen one marked.

    info has a row for each cik and tag that was got; errors(cik, tag, code, message) for those that
    were not.  The tag with the newest period is chosen, of equal ones the first in the list.
    """
    every = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in r.asDict().items())) for r in defs.collect()))  # a few dozen definitions
    # all meet by company, which the choice needs, too: of each as many rows as tags are defined
    asked = lambda df: df.join(defs.select("tag").distinct().hint("broadcast"), "tag", "left_semi")
    of_company = lambda df, *more: asked(df).groupBy("cik").agg(F.collect_list(F.struct(F.col("tag").alias("_tag"), *more)).alias("_of"))
    found = of_company(info, *(c for c in info.columns if c not in ("cik", "tag"))).withColumnRenamed("_of", "_info")
    failed = of_company(errors, "code", "message").withColumnRenamed("_of", "_failed")
    rows = companies.select("cik").join(found, "cik", "left").join(failed, "cik", "left").select("cik", "_info", "_failed", F.inline(every))
    for c in ("_info", "_failed"):
        rows = rows.select("*", F.inline_outer(F.filter(c, lambda x: x["_tag"] == F.col("tag")))).drop(c, "_tag")
    status = (
        F.when(F.col("periods") > 0, "ok").when(F.col("entries").isNotNull(), "no period").when(F.col("code") == 404, "never reported")
        .when(F.col("code").isNotNull(), F.concat(F.lit("http "), F.col("code").cast("string"))).otherwise(F.concat(F.lit("not got: "), F.coalesce("message", F.lit("not asked"))))
    )
    rows = rows.withColumn("status", status)
    best = Window.partitionBy("cik", "metric").orderBy(F.when(F.col("status") == "ok", 0).otherwise(1), F.desc(F.coalesce("newest", F.lit(""))), "tag_rank")
    return rows.withColumn("chosen", (F.col("status") == "ok") & (F.row_number().over(best) == 1)).drop("code", "message")


def best_tag(df: DataFrame, key: str, newest: str, rank: str) -> DataFrame:
    """The candidate with the newest period; ties go to the lower declared rank."""
    w = Window.partitionBy(key).orderBy(F.desc(newest), rank)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def in_window(end: Column, newest: Column, days: int) -> Column:
    """Whether a text date is days before the newest at most; all are if the newest is no date, none that is no date itself."""
    return day(newest).isNull() | F.coalesce(F.datediff(day(newest), day(end)) <= days, F.lit(False))


def group_of(caliber: Column) -> Column:
    """The table that a period is shown in; one without a length counts as cumulative."""
    return F.when(caliber == "Q", "Q").when(caliber == "I", "I").when(caliber == "X", "OTHER").otherwise("CUM")


def recent(df: DataFrame, keys: list[str], group: str, end: str, days: int, n: dict[str, int] | int, more: list[Column], newest: Column | None = None) -> DataFrame:
    """Rows within days of the keys' newest end (newest, where that is known), then the first n of each group (a number, or one for each group)."""
    df = df.withColumn("_newest", F.max(end).over(Window.partitionBy(*keys)) if newest is None else newest).where(in_window(F.col(end), F.col("_newest"), days))
    w = Window.partitionBy(*keys, group).orderBy(F.desc(end), *more)
    most = F.lit(n) if isinstance(n, int) else F.create_map(*(F.lit(x) for kv in n.items() for x in kv))[F.col(group)]
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("_newest")


def series_quality(rows: DataFrame, keys: list[str], end: str, quarter: Column, year: Column, start: Column) -> DataFrame:
    """For each key: n_quarters and quarters_ok (two rows and two calendar quarters at least) of rows where quarter, mixed_yearly (full years that begin in several months)."""
    month = lambda c: F.coalesce(F.when(is_date(c), F.substring(c, 6, 2)), F.lit("?"))
    q = F.when(is_date(F.col(end)), F.floor((F.substring(end, 6, 2).cast("int") - 1) / 3)).otherwise(-1)
    n = F.count_if(quarter)
    return rows.groupBy(*keys).agg(
        n.alias("n_quarters"), ((n >= 2) & (F.count_distinct(F.when(quarter, q)) >= 2)).alias("quarters_ok"), (F.count_distinct(F.when(year & start.isNotNull(), month(start))) > 1).alias("mixed_yearly")
    )


def report(got: DataFrame, chosen: DataFrame, days: int = RECENT_DAYS, shown: dict[str, int] = SHOWN) -> tuple[DataFrame, DataFrame]:
    """(rows that a chapter shows, one row for each company and metric) of periods with cik and tag.

    chosen are candidates; of the chosen tag's periods the recent ones are shown, up to a number for
    each group.  Quarters are shown only if they make a series.  The scale is that of the largest
    value shown.  as_of is the last filing of any chosen period; a metric without a tag lists why.
    """
    keys = ["cik", "metric"]
    picked = chosen.where("chosen")
    mine = picked.groupBy("cik").agg(F.collect_list(F.struct(F.col("tag").alias("_tag"), "metric", "metric_pos", F.col("want").alias("_want"), F.col("newest").alias("_top"))).alias("_mine"))  # as many as metrics
    own = got.drop("metric", "metric_pos", "want", "tag_rank").join(mine, "cik").select("*", F.inline(F.filter("_mine", lambda x: x["_tag"] == F.col("tag")))).drop("_mine", "_tag").withColumn("group", group_of(F.col("caliber")))
    rows = written(recent(own, keys, "group", "end", days, shown, [F.desc(F.coalesce("start", F.lit("")))], F.col("_top")).drop("_top"), "shown")  # a few rows of each metric
    quality = series_quality(rows, keys, "end", F.col("group") == "Q", F.col("caliber") == "FY", F.col("start"))
    rows = rows.join(quality, keys).where((F.col("group") != "Q") | F.col("quarters_ok"))
    rows = rows.withColumn("scale", scale(F.max(F.abs("val")).over(Window.partitionBy(*keys))))
    value = lambda c: F.when(F.col("_want") == "USD/shares", per_share(F.col(c).cast("double"))).otherwise(money(F.col(c), F.col("scale")))
    out = rows.select(
        *keys, "metric_pos", "tag", "unit", "group", "rank", "caliber", "start", "end", "val", "scale", value("val").alias("text"), period_label(F.col("caliber"), F.col("start"), F.col("end"), F.col("days")).alias("label"),
        range_label(F.col("caliber"), F.col("start"), F.col("end")).alias("range"), "filed", "form", "accn", "folded", F.col("revised"), F.when(F.col("revised"), value("prev")).alias("prev_text"), archive_url(F.col("cik"), F.col("accn")).alias("filing"),
    )
    as_of = got.groupBy("cik", "tag").agg(F.max("filed").alias("filed")).join(picked.select("cik", "tag"), ["cik", "tag"]).groupBy("cik").agg(F.max("filed").alias("as_of"))
    why = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag_rank", "tag", "status"))), lambda c: F.concat(c["tag"], F.lit(" ("), c["status"], F.lit(")"))), "; ")
    per = chosen.groupBy("cik", "metric", "metric_pos").agg(F.max("chosen").alias("available"), F.max(F.when(F.col("chosen"), F.col("tag"))).alias("tag"), why.alias("tried"))
    per = per.join(quality, keys, "left").join(as_of, "cik", "left")
    n = out.groupBy(*keys).agg(F.count("*").alias("n_shown"))
    per = per.join(n, keys, "left").withColumns({"n_shown": F.coalesce("n_shown", F.lit(0).cast("long")), "why": F.when(~F.col("available"), F.col("tried"))}).drop("tried")
    return out, per


def has_chapter(per: DataFrame, least: int = 1) -> DataFrame:
    """cik and whether least metrics of it at least have a row to show."""
    return per.groupBy("cik").agg((F.count_if(F.col("n_shown") > 0) >= least).alias("has_chapter"))


def totals(answers: DataFrame) -> DataFrame:
    """For each cik: requests, bytes, ok_count and the tags that are missing, from answers(cik, tag, body, code, bytes)."""
    return answers.groupBy("cik").agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.count_if(F.col("body").isNotNull()).alias("ok_count"),
        F.array_sort(F.collect_list(F.when(F.col("body").isNull(), F.col("tag")))).alias("missing"),
    )
