"""Companies: the directory of names and tickers, and finding one by a query."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import company_score, looks_like_json, one_line
from sedimenta.operators.filings import ranked

#: Candidates of a query, and rows below which a directory is refused.
CANDIDATES, LEAST_ROWS = 20, 1000


def directory(bodies: DataFrame, body: str = "body") -> DataFrame:
    """cik, ticker, title from JSON objects of {cik_str, ticker, title}, sorted by cik and ticker; entries whose number is none are dropped."""
    entry = F.from_json(F.when(looks_like_json(F.col(body)), F.col(body)), "map<string, struct<cik_str: string, ticker: string, title: string>>")
    rows = bodies.select(F.explode(F.map_values(entry)).alias("e"))
    cik = F.try_to_number("e.cik_str", F.lit("99999999999")).cast("long")
    rows = rows.select(cik.alias("cik"), F.coalesce("e.ticker", F.lit("")).alias("ticker"), F.coalesce("e.title", F.lit("")).alias("title"))
    return rows.where("cik is not null").orderBy("cik", "ticker")


def index_lines(companies: DataFrame) -> DataFrame:
    """The directory as lines of three fields; tabs and line ends in a field become blanks."""
    return companies.select("cik", "ticker", F.concat_ws("\t", F.col("cik").cast("string"), one_line(F.col("ticker")), one_line(F.col("title"))).alias("line"))


def index_is_sane(lines: DataFrame, rows: int) -> bool:
    """Whether an index has as many lines as its metadata says, LEAST_ROWS at least, and each one has its three fields."""
    got = lines.agg(F.count("*").alias("n"), F.count_if(~F.col("line").rlike("^[0-9]+\t[^\t]*\t")).alias("bad")).first()
    return got["n"] == rows >= LEAST_ROWS and got["bad"] == 0


def candidates(companies: DataFrame, query: str) -> DataFrame:
    """companies with score and matched_by, those that the query fits."""
    rows = companies.withColumn("score", company_score(F.col("cik"), F.col("ticker"), F.col("title"), query)).where("score > 0")
    how = F.lit("cik") if query.isascii() and query.isdigit() else F.when(F.col("score") == 1000, "ticker").otherwise("name")
    return rows.withColumn("matched_by", how)


def order() -> list[Column]:
    """Best first: score, then the shorter title in bytes, ticker, cik."""
    return [F.desc("score"), F.octet_length("title"), F.col("ticker"), F.col("cik")]


def tickers_of(companies: DataFrame) -> DataFrame:
    """All tickers of each cik, sorted; empty ones don't count."""
    return companies.where("ticker <> ''").groupBy("cik").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))


def asked(query: str) -> str:
    """A query without blanks at its ends and without CIK before it, even where a name begins with these letters."""
    return re.sub(r"^[Cc][Ii][Kk]\s*", "", query.strip())


def resolve(companies: DataFrame, query: str, n: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(candidates with their rank, answer of one row) for a query: a number, a ticker or a part of a name.

    The answer is the first candidate with all its tickers, how many fitted, whether there were more
    than n, several, or two equally good.  A number that is not in the directory is an answer without
    a name; else, or with an empty query, there is an error.
    """
    spark: SparkSession = companies.sparkSession
    q = asked(query)
    if not q:
        fits = companies.withColumns({"score": F.lit(0), "matched_by": F.lit("")}).where("false")
    else:
        fits = candidates(companies, q)
    top = ranked(fits, order(), n)
    total = fits.agg(F.count("*").alias("candidates_total"))
    first = top.where("rank = 1").select(F.col("cik").alias("cik_num"), F.col("title").alias("name"), F.nullif(F.col("ticker"), F.lit("")).alias("ticker"), "matched_by", F.col("score").alias("_one"))
    second = top.where("rank = 2").select(F.col("score").alias("_two"))
    one = spark.range(1).select(F.lit(q).alias("query"))
    out = one.join(F.broadcast(total), how="left").join(F.broadcast(first), F.lit(True), "left").join(F.broadcast(second), F.lit(True), "left")
    out = out.join(tickers_of(companies).withColumnRenamed("cik", "_cik"), F.col("cik_num") == F.col("_cik"), "left")
    digits = q.isascii() and q.isdigit() and 0 < int(q) < 10**10
    number = F.coalesce("cik_num", F.lit(int(q) if digits else None).cast("long"))
    error = F.lit("empty") if not q else F.when(number.isNull(), "no_match")
    return top, out.select(
        "query", error.alias("error"), number.alias("cik_num"), F.lpad(number.cast("string"), 10, "0").alias("cik"), "name", "ticker", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"),
        F.coalesce("matched_by", F.lit("cik" if digits else None)).alias("matched_by"), F.when(F.col("name").isNotNull(), "index").otherwise("unknown").alias("name_source"),
        "candidates_total", (F.col("candidates_total") > n).alias("truncated"), (F.col("candidates_total") > 1).alias("ambiguous"), F.coalesce(F.col("_one") == F.col("_two"), F.lit(False)).alias("tie"),
    )
