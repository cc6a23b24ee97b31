"""Names, tickers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize_text(x: Column) -> Column:
    """ASCII lower case, ASCII punctuation to single blanks, other characters kept, trimmed."""
    x = F.regexp_replace(F.translate(x, _UPPER, _LOWER), r"[^0-9a-z\x{80}-\x{10FFFF}]+", " ")
    return F.trim(x)


def normalize_ticker(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _UPPER, _LOWER), r"[\s.\-_]", "")


def pad_cik(x: Column) -> Column:
    """A search's number as ten digits; null unless it is 1 to 9,999,999,999 after an optional CIK."""
    digits = F.regexp_extract(F.trim(x), r"^(?i:cik)?\s*0*([1-9][0-9]{0,9})$", 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def watch_cik(x: Column) -> Column:
    """A watch list's number as ten digits: blanks inside go, 0 is allowed; null if there are other characters or over ten digits."""
    digits = F.regexp_extract(F.regexp_replace(x, r"\s", ""), r"^(?i:cik)?([0-9]{1,10})$", 1)
    return F.when(digits != "", F.lpad(digits, 10, "0"))


def name_tier(title: Column, query: str) -> Column:
    """900 equal, 800 first words, 600 whole words inside, 400 substring, else 0; an empty query fits nothing."""
    name, q = normalize_text(title), normalize_text(F.lit(query))
    return (
        F.when(q == "", 0).when(name == q, 900).when(F.startswith(name, F.concat(q, F.lit(" "))), 800)
        .when(F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" "))), 600)
        .when(F.contains(name, q), 400).otherwise(0)
    )


def company_score(cik: Column, ticker: Column, title: Column, query: str) -> Column:
    """A query of digits fits the equal cik only (1000); else an equal ticker 1000, else the name's tier."""
    if query.isascii() and query.isdigit():
        return F.when(cik.cast("decimal(20,0)") == F.lit(int(query)).cast("decimal(20,0)"), 1000).otherwise(0)
    code = normalize_ticker(F.lit(query))
    return F.when((code != "") & (normalize_ticker(F.coalesce(ticker, F.lit(""))) == code), 1000).otherwise(name_tier(title, query))


def one_line(x: Column) -> Column:
    """Control characters to blanks, as in a table of one line a row."""
    return F.regexp_replace(x, r"[\x00-\x1F\x7F]", " ")


def key_values(x: Column) -> Column:
    """Lines k=v to a map; of lines with one key the last counts, other lines are ignored."""
    lines = F.filter(F.split(x, r"[\r\n]+"), lambda s: s.rlike("^[A-Za-z0-9_]+="))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, "^([A-Za-z0-9_]+)=", 1).alias("k"), F.regexp_extract(s, r"(?s)^[A-Za-z0-9_]+=(.*)$", 1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def file_part(x: Column, fallback: str) -> Column:
    """A name that a path may hold: no control characters, separators or blanks in a row, no final dots."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x1F\x7F]", " "), r'[/\\:*?"<>|]', "-")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"^ +| +$", ""), r"\.+$", "")
    return F.when(s.isin("", ".", ".."), F.lit(fallback)).otherwise(s)


def filing_key(cik: Column, accn: Column) -> Column:
    return F.concat(F.coalesce(watch_cik(cik.cast("string")), file_part(cik.cast("string"), "unknown")), F.lit(":"), file_part(accn, "unknown-accession"))


def archive_url(cik: Column, accn: Column, document: Column | None = None) -> Column:
    """The folder of a filing, or a document in it; null without accession or document."""
    folder = F.when(F.coalesce(accn, F.lit("")) != "", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(accn, F.lit("-"), F.lit("")), F.lit("/")))
    return folder if document is None else F.concat(folder, document)


def concept_url(cik: Column, tag: Column) -> Column:
    return F.concat(F.lit("https://data.sec.gov/api/xbrl/companyconcept/CIK"), F.lpad(cik.cast("long").cast("string"), 10, "0"), F.lit("/us-gaap/"), tag, F.lit(".json"))


def escaped(x: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def utf8_trimmed(x: Column, size: int) -> Column:
    """At most size bytes, cut between characters, with an ellipsis where something was cut; null counts as empty."""
    lengths = F.transform(F.split(x, ""), F.octet_length)
    fit = F.aggregate(lengths, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(True).alias("go")), lambda s, n: F.struct(
        F.when(s["go"] & (s["bytes"] + n <= size), s["bytes"] + n).otherwise(s["bytes"]).alias("bytes"),
        F.when(s["go"] & (s["bytes"] + n <= size), s["chars"] + 1).otherwise(s["chars"]).alias("chars"), (s["go"] & (s["bytes"] + n <= size)).alias("go")))["chars"]
    return F.when(x.isNull(), "").when(F.octet_length(x) <= size, x).otherwise(F.concat(F.substring(x, F.lit(1), fit), F.lit("\u2026")))


def prefixed_digest(*fields: Column) -> Column:
    """SHA-256 over fields, each after its length in bytes, so that no two lists of fields are alike."""
    return F.sha2(F.concat(*(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f) for f in fields)), 256)


#: Parts of a transport's message in order, and the kind of failure.
FAILURES = [
    ("timeout", "timeout"), ("connection refused", "connect"), ("socket connect", "connect"), ("connect failed", "connect"), ("connection reset", "reset"), ("broken pipe", "reset"),
    ("host not found", "dns"), ("name or service not known", "dns"), ("resolver", "dns"), ("dns", "dns"), ("closed", "closed"), ("ssl", "tls"), ("certificate", "tls"), ("handshake", "tls"),
]


def failure_kind(message: Column) -> Column:
    """The kind of the first part that the message holds; other, or unknown if there is no message."""
    out = F.when(F.coalesce(message, F.lit("")) == "", "unknown")
    for part, kind in FAILURES:
        out = out.when(F.contains(F.lower(message), F.lit(part)), kind)
    return out.otherwise("other")


def looks_like_json(x: Column) -> Column:
    """Whether a body begins as JSON and not, say, as an error page."""
    return F.coalesce(x.rlike(r"^\s*[{\[]"), F.lit(False))
