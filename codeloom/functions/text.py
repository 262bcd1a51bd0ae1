"""Text and path functions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Lower-case parts of identifiers: cut at all that is no letter or digit and before every capital; of two bytes at least."""
    plain = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[^\p{L}\p{Nd}]+", " ")
    parts = F.split(F.regexp_replace(plain, r"(\p{Lu})", " $1"), " ")
    return F.transform(F.filter(parts, lambda p: F.octet_length(p) >= 2), F.lower)


#: Fixed value: what a query's words are stripped of.
QUERY_MARKS = ".,;:!?\"'()"


def query_terms(text: Column | str) -> Column:
    """Words of a search string: lower case, without marks at their ends, of two bytes at least; no cut at capitals."""
    parts = F.split(F.lower(F.trim(_c(text))), r"\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(QUERY_MARKS))), lambda p: F.octet_length(p) >= 2)


def plain_terms(text: Column | str) -> Column:
    """Lower-case words at white space, as they are."""
    return F.filter(F.split(F.lower(F.trim(_c(text))), r"\s+"), lambda p: p != "")


def tf_idf(n: Column, total: Column, documents: Column, frequency: Column) -> Column:
    return n / total * (F.log((documents + 1) / (frequency + 1)) + 1)


def dirname(path: Column | str) -> Column:
    """'.' where there is no slash."""
    p = _c(path)
    cut = F.regexp_replace(p, r"/[^/]*$", "")
    return F.when(~p.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"\.[^.]*$", 0)


def area_label(path: Column | str) -> Column:
    """The last two parts of a path's directory, or the directory."""
    where = dirname(path)
    parts = F.split(where, "/")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, -2, 2), "/")).otherwise(where)


def unqualified(name: Column | str) -> Column:
    """What follows the first dot; the name itself without one."""
    return F.regexp_replace(_c(name), r"^[^.]*\.", "")


def file_name(label: Column | str) -> Column:
    """A label as a file name: lower case, other characters than letters, digits, '-' and '_' as '-'."""
    return F.lower(F.regexp_replace(_c(label), r"[^A-Za-z0-9_-]", "-"))


def line_range(text: Column | str, first: Column, last: Column) -> Column:
    """Lines first to last of a text, counted from 1, both included; empty where the range is."""
    lines = F.split(_c(text), "\n", -1)
    begin, end = F.greatest(first, F.lit(1)), F.least(last, F.size(lines))
    return F.when(end < begin, F.lit("")).otherwise(F.array_join(F.slice(lines, begin, F.greatest(end - begin + 1, F.lit(0))), "\n"))


def alpha_hex(share: Column) -> Column:
    """A share, held to [0, 1], as two hexadecimal digits of opacity."""
    held = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return F.lower(F.lpad(F.hex(F.round(held * 255).cast("int")), 2, "0"))


def percentage(part: Column, whole: Column) -> Column:
    return F.format_string("%.1f%%", F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)))
