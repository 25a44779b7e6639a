"""String predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_blank(c: Column) -> Column:
    """Empty string or null; the readers keep the empty string as a value."""
    return F.coalesce(c, F.lit("")) == ""


def is_digits_or_empty(c: Column) -> Column:
    return (c == "") | c.rlike("^[0-9]+$")


def has_parent_part(path: Column) -> Column:
    """True when one path component is exactly ``..``."""
    return F.array_contains(F.split(path, "/"), "..")


def is_unsafe_member(name: Column) -> Column:
    """Backslash, absolute path, parent component or drive letter."""
    return (name.contains("\\") | name.startswith("/") | has_parent_part(name)
            | name.rlike("^[A-Za-z]:"))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters turned into one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def strip_dashes(c: Column) -> Column:
    """Optional evidence: ``-`` removed, absent becomes empty."""
    return F.coalesce(F.replace(c, F.lit("-"), F.lit("")), F.lit(""))


def spoof_label_of(names: Column) -> Column:
    """Index of the positive class from an ordered array of class names."""
    def positive(name: Column) -> Column:
        low = F.lower(name)
        return low.contains("spoof") | low.contains("fake") | low.contains("deepfake")

    indexed = F.transform(names, lambda n, i: F.when(positive(n), i))
    return F.coalesce(F.array_min(F.filter(indexed, lambda i: i.isNotNull())), F.lit(1))


def hertz_label(hz: Column) -> Column:
    """Hz below one kilohertz, kHz with two digits above."""
    return F.when(hz < 1000, F.concat(F.format_string("%.0f", hz), F.lit(" Hz"))).otherwise(
        F.concat(F.format_string("%.2f", hz / 1000), F.lit(" kHz")))


def stars(q: Column) -> Column:
    """Significance stars of an adjusted p-value."""
    return (F.when(q.isNull() | F.isnan(q), "n/a").when(q < 0.001, "***").when(q < 0.01, "**")
            .when(q < 0.05, "*").otherwise("ns"))
