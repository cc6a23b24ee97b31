"""Finding companies for a table of queries at once, over an index of the directory's names.

A name's keys are the beginnings, the ends and the wholes of its words, and the runs of three
characters inside.  A query of several words occurs in a name only where its first word ends one, its
last word begins one and those between are whole; a query of one word, only where all its runs of
three are (a shorter one is itself a key).  The rarest of these keys is looked up, and what it leads
to is compared by the rules for one query, so that results are those of companies.resolve().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import normalize_text, normalize_ticker
from sedimenta.operators.companies import CANDIDATES, order, tickers_of
from sedimenta.sources.scratch import written

#: Characters of a run.
RUN = 3

_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"


def asked(query: Column) -> Column:
    """A query without blanks at its ends and without CIK before it; null is empty."""
    bare = F.regexp_replace(F.coalesce(query, F.lit("")), f"^{_SPACE}+|{_SPACE}+$", "")
    return F.regexp_replace(bare, rf"^[Cc][Ii][Kk]{_SPACE}*", "")


def _runs(x: Column, n: int) -> Column:
    """The runs of n characters of a text; none where it is shorter."""
    return F.when(F.char_length(x) >= n, F.transform(F.sequence(F.lit(1), F.char_length(x) - n + 1), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, xs: Column) -> Column:
    return F.transform(xs, lambda x: F.concat(F.lit(tag), x))


def name_keys(name: Column) -> Column:
    """The distinct keys of a normalised name."""
    words = F.array_distinct(F.split(name, " "))
    starts = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda n: F.left(w, n))))
    ends = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w)), lambda n: F.right(w, n))))
    inside = F.flatten(F.array(*(_runs(name, n) for n in range(1, RUN + 1))))
    return F.array_distinct(F.concat(_tagged("^", starts), _tagged("$", ends), _tagged("=", words), _tagged("~", inside)))


def query_keys(query: Column) -> Column:
    """The keys that any name with this normalised query inside has."""
    words = F.split(query, " ")
    n = F.size(words)
    several = F.concat(F.array(F.concat(F.lit("$"), F.element_at(words, 1)), F.concat(F.lit("^"), F.element_at(words, -1))), _tagged("=", F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))))
    one = F.when(F.char_length(query) < RUN, F.array(F.concat(F.lit("~"), query))).otherwise(_tagged("~", _runs(query, RUN)))
    return F.array_distinct(F.when(n > 1, several).otherwise(one))


def tier(name: Column, query: Column) -> Column:
    """900 equal, 800 first words, 600 whole words inside, 400 inside, else 0, of normalised texts."""
    edged = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.when(name == query, 900).when(F.startswith(name, F.concat(query, F.lit(" "))), 800).when(F.contains(edged(name), edged(query)), 600).when(F.contains(name, query), 400).otherwise(0)


def matches(companies: DataFrame, queries: DataFrame) -> DataFrame:
    """q, cik, ticker, title, score and matched_by of all companies that each distinct query(q, asked already) fits."""
    q = queries.select("q").where("q <> ''").distinct().withColumns({"digits": F.col("q").rlike("^[0-9]+$"), "code": normalize_ticker(F.col("q")), "words": normalize_text(F.col("q"))})
    rows = companies.select("cik", "ticker", "title", normalize_ticker(F.coalesce("ticker", F.lit(""))).alias("of_code"), normalize_text(F.col("title")).alias("name"))
    out = ["q", "cik", "ticker", "title", "score", "matched_by"]

    number = F.regexp_replace("q", "^0+(?=.)", "")
    by_number = q.where("digits").select("q", F.when(F.char_length(number).between(1, 18), number.cast("long")).alias("n")).join(rows, F.col("n") == F.col("cik")).select("q", "cik", "ticker", "title", F.lit(1000).alias("score"), F.lit("cik").alias("matched_by"))

    texts = q.where("not digits")
    by_code = texts.where("code <> ''").join(rows, F.col("code") == F.col("of_code")).select("q", "cik", "ticker", "title", F.lit(1000).alias("score"), F.lit("ticker").alias("matched_by"))

    wanted = texts.where("words <> ''").select("words").distinct().select("words", F.explode(query_keys(F.col("words"))).alias("key"))
    names = rows.where("name <> ''").select("name").distinct()
    index = names.select("name", F.explode(name_keys(F.col("name"))).alias("key")).join(wanted.select("key").distinct(), "key", "left_semi")
    index = written(index, "names")
    counts = index.groupBy("key").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "key", "left").groupBy("words").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0").drop("unknown")
    fit = rarest.join(index, "key").withColumn("score", tier(F.col("name"), F.col("words"))).where("score > 0").select("words", "name", "score")
    by_name = texts.join(fit, "words").join(rows, "name").where("code = '' or of_code <> code").select("q", "cik", "ticker", "title", "score", F.lit("name").alias("matched_by"))
    return by_number.select(out).union(by_code.select(out)).union(by_name.select(out))


def resolve_all(companies: DataFrame, queries: DataFrame, n: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(the first n candidates of each query with their rank, an answer for each row of queries(query_id, query)).

    Both are as companies.resolve() gives them for one query.  An empty or null query has the error
    empty.  Equal queries are looked up once.  The matches are a table that is written when this is
    called; nothing of the directory is broadcast or goes to the driver.
    """
    given = queries.select("query_id", asked(F.col("query")).alias("q"))
    found = written(matches(companies, given), "matches")
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order()))).where(F.col("rank") <= max(n, 2))
    top = given.join(first.where(F.col("rank") <= n), "q").drop("q")
    total = found.groupBy("q").agg(F.count("*").alias("candidates_total"))
    heads = first.where("rank <= 2").groupBy("q").agg(*(F.max(F.when(F.col("rank") == 1, F.col(c))).alias(a) for c, a in (("cik", "cik_num"), ("title", "name"), ("ticker", "_ticker"), ("matched_by", "matched_by"), ("score", "_one"))), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_two"))
    heads = heads.join(tickers_of(companies).withColumnRenamed("cik", "cik_num"), "cik_num", "left")
    out = given.join(total, "q", "left").join(heads, "q", "left")
    bare = F.regexp_replace("q", "^0+", "")
    digits = F.col("q").rlike("^[0-9]+$") & F.char_length(bare).between(1, 10)
    out = out.withColumn("cik_num", F.coalesce("cik_num", F.when(digits, bare.cast("long"))))
    many = F.coalesce("candidates_total", F.lit(0).cast("long"))
    return top, out.select(
        "query_id", F.col("q").alias("query"), F.when(F.col("q") == "", "empty").when(F.col("cik_num").isNull(), "no_match").alias("error"), "cik_num", F.lpad(F.col("cik_num").cast("string"), 10, "0").alias("cik"), "name", F.nullif(F.col("_ticker"), F.lit("")).alias("ticker"),
        F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"), F.coalesce("matched_by", F.when(digits, "cik")).alias("matched_by"), F.when(F.col("name").isNotNull(), "index").otherwise("unknown").alias("name_source"),
        many.alias("candidates_total"), (many > n).alias("truncated"), (many > 1).alias("ambiguous"), F.coalesce(F.col("_one") == F.col("_two"), F.lit(False)).alias("tie"),
    )
