"""Form predicates.  Four rules coexist on purpose: boundary match, amendment, watch list, report prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches_form(form: Column, want: Column, mode: str = "boundary") -> Column:
    """Equal after trimming and upper-casing; else by mode: exact, prefix, or a prefix that ends at / space or -."""
    f, w = F.upper(F.trim(form)), F.upper(F.trim(want))
    every = w.isin("", "*")
    if mode == "exact":
        return every | (f == w)
    if mode == "prefix":
        return every | F.startswith(f, w)
    return every | (f == w) | (F.startswith(f, w) & F.substr(f, F.length(w) + 1, F.lit(1)).isin("/", " ", "-"))


def is_amendment(form: Column) -> Column:
    return form.rlike("/A[0-9]*$")


def passes(form: Column, wanted: list[str], amendments: bool | str = True, mode: str = "boundary") -> Column:
    """Any wanted form, and the amendment policy: True, False or "only"."""
    wanted = [w for w in wanted if w.strip()]
    hit = reduce(lambda a, b: a | b, (matches_form(form, F.lit(w), mode) for w in wanted)) if wanted else F.lit(True)
    return hit if amendments is True else hit & (is_amendment(form) if amendments == "only" else ~is_amendment(form))


#: The forms of a subscription that names none.
DEFAULT_FORMS = ["10-K", "10-Q", "8-K"]


def normalize_form(form: Column) -> Column:
    """Trimmed and in upper case; null counts as empty."""
    return F.upper(F.regexp_replace(F.coalesce(form, F.lit("")), r"^\s+|\s+$", ""))


def in_forms(form: Column, forms: Column, exact: bool = False) -> Column:
    """The form, or unless exact its part before the first slash, is in an array of normalized forms."""
    f = normalize_form(form)
    hit = F.array_contains(forms, f)
    return hit if exact else hit | F.array_contains(forms, F.split_part(f, F.lit("/"), F.lit(1)))


def legacy_view(form: Column, reports: bool = False, only_8k: bool = False) -> Column:
    """The older picker: reports (forms that begin with 10-) only where asked for, or 8-K alone."""
    if only_8k:
        return form == "8-K"
    return F.lit(True) if reports else ~form.startswith("10-")


def on_watch_list(form: Column, forms: list[str] = ("10-K", "10-Q", "8-K")) -> Column:
    """The form itself, or its part before the first slash, is on the list."""
    return form.isin(*forms) | F.split_part(form, F.lit("/"), F.lit(1)).isin(*forms)


def is_report(form: Column) -> Column:
    return form.rlike("^(8-K|10-K|10-Q)")


def in_dates(date: Column, since: str = "", until: str = "") -> Column:
    """Inclusive bounds on text dates; an empty date fails only if a bound is set."""
    out = F.lit(True)
    if since:
        out = out & (date >= since)
    if until:
        out = out & (date <= until) & (date != "")
    return out
