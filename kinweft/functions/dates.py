"""Dates of partial precision. They are texts and stay texts: a year is never made a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def date_label(d: Column) -> Column:
    """exact: the value; approximate: ``~value``; range: ``start–end`` where both are given; else null."""
    return (
        F.when(d["precision"] == "exact", _given(d["value"]))
        .when(d["precision"] == "approximate", F.concat(F.lit("~"), _given(d["value"])))
        .when(d["precision"] == "range", F.concat(_given(d["start"]), F.lit("–"), _given(d["end"])))
    )


def date_label_locale(d: Column, locale: str) -> Column:
    """As ``date_label`` in a language: an open range ends in ``?``, an unknown date is said to be so."""
    about = {"en": "c. ", "ja": "約", "ru": "ок. "}.get(locale, "c. ")
    unknown = {"en": "Unknown", "ja": "不明", "ru": "Неизвестно"}.get(locale, "Unknown")
    return (
        F.when(d["precision"] == "exact", F.coalesce(d["value"], F.lit(unknown)))
        .when(d["precision"] == "approximate", F.concat(F.lit(about), F.coalesce(d["value"], F.lit("?"))))
        .when(d["precision"] == "range", F.concat(F.coalesce(d["start"], F.lit("?")), F.lit("–"), F.coalesce(d["end"], F.lit("?"))))
        .otherwise(F.lit(unknown))
    )


def is_full_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def is_partial_date(c: Column) -> Column:
    """A year, a year and month from 01 to 12, or a day of the calendar."""
    return F.coalesce(c.rlike(r"^\d{4}$") | c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$") | is_full_date(c), F.lit(False))


def parse_foreign_date(c: Column) -> Column:
    """A date written with dots, slashes or hyphens as struct<precision,value>; null where it is none, or where hyphens come with others.

    One part is an approximate year, two an approximate month, three a day that must exist.
    """
    slashed = F.replace(F.trim(c), F.lit("."), F.lit("/"))
    parts = F.when(F.contains(slashed, F.lit("/")), F.split(slashed, "/")).otherwise(F.split(slashed, "-"))
    n, y = F.size(parts), F.try_element_at(parts, F.lit(1))
    m, d = (F.lpad(F.try_element_at(parts, F.lit(k)), 2, "0") for k in (2, 3))
    sane = y.rlike(r"^\d{4}$")
    month = sane & m.rlike("^(0[1-9]|1[0-2])$") & F.try_element_at(parts, F.lit(2)).rlike(r"^\d{1,2}$")
    day = F.concat_ws("-", y, m, d)
    out = lambda p, v: F.struct(F.lit(p).alias("precision"), v.alias("value"))
    return (
        F.when((n == 1) & sane, out("approximate", y))
        .when((n == 2) & month, out("approximate", F.concat_ws("-", y, m)))
        .when((n == 3) & month & F.try_element_at(parts, F.lit(3)).rlike(r"^\d{1,2}$") & is_full_date(day), out("exact", day))
    )


def legacy_date(c: Column) -> Column:
    """As written, by shape alone: ten characters are a day, four or seven are approximate."""
    out = lambda p: F.struct(F.lit(p).alias("precision"), c.alias("value"))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), out("exact")).when(c.rlike(r"^\d{4}(-\d{2})?$"), out("approximate"))


def lower_bound(c: Column) -> Column:
    """The least day a partial date can mean, as text."""
    return F.when(F.length(c) == 4, F.concat(c, F.lit("-01-01"))).when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c)


def upper_bound(c: Column) -> Column:
    """A text not below any day a partial date can mean."""
    return F.when(F.length(c) == 4, F.concat(c, F.lit("-99-99"))).when(F.length(c) == 7, F.concat(c, F.lit("-99"))).otherwise(c)


def is_reversed_range(d: Column) -> Column:
    """A range whose start cannot be before its end."""
    return F.coalesce((d["precision"] == "range") & (lower_bound(d["start"]) > upper_bound(d["end"])), F.lit(False))


def sort_key(d: Column) -> Column:
    """What events are ordered by: value, else end, else start, else ''."""
    return F.coalesce(_given(d["value"]), _given(d["end"]), _given(d["start"]), F.lit(""))
