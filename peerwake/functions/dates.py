"""Dates in mixed notations, read from their fields with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month and weekday names as vendors write them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Years of two digits from here on lie in the 1900s.
PIVOT = 69


def _month(name: Column) -> Column:
    """Number of a month that is written out, cut to three letters or more, or ``sept``; null otherwise."""
    found = F.lit(None).cast("int")
    for k, month in enumerate(MONTHS, 1):
        found = F.when((F.length(name) >= 3) & F.lit(month).startswith(name), F.lit(k)).otherwise(found)
    return found


def _year(digits: Column) -> Column:
    number = digits.try_cast("int")
    return F.when(F.length(digits) == 4, number).when(F.length(digits) <= 2, number + F.when(number >= PIVOT, 1900).otherwise(2000))


def parse_mixed_date(raw: Column) -> Column:
    """The date of a value, or null.

    A time of day behind the date is cut off, and a zone with it (the local label stays). A leading weekday, ordinal endings
    and commas don't matter. What is left are one field of eight digits (year, month, day) or three fields:

    * a month name and two numbers: the year is the one of four digits, else the last;
    * three numbers that begin with a year of four digits: year, month, day;
    * three other numbers: month, day, year, or day, month, year where the first is above 12.

    Fields are separated by blanks, points, commas, slashes, hyphens or the change from digits to letters. Everything
    else, and dates that no calendar has, is null.
    """
    text = F.lower(F.trim(raw.cast("string")))
    text = F.regexp_replace(text, r"(?<=\d)[t ]+\d{1,2}:\d{2}.*$", "")
    text = F.regexp_replace(text, rf"^({'|'.join(f'{d[:3]}({d[3:]})?' for d in WEEKDAYS)})[., ]+", "")
    text = F.regexp_replace(text, r"(?<=\d)(st|nd|rd|th)\b", "")
    plain = text.rlike(r"^[0-9a-z]+([ .,/-]+[0-9a-z]+)*\.?$")
    fields = F.regexp_extract_all(text, F.lit(r"(\d+|[a-z]+)"), F.lit(1))
    a, b, c = (F.get(fields, k) for k in range(3))
    named = F.coalesce(_month(a), _month(b), _month(c))
    digits = F.filter(fields, lambda x: x.rlike(r"^\d+$"))
    p, q = F.get(digits, 0), F.get(digits, 1)
    first_year = F.length(p) == 4
    late = a.try_cast("int") > 12
    eight = (F.size(fields) == 1) & a.rlike(r"^\d{8}$")
    year = (F.when(eight, F.substring(a, 1, 4).try_cast("int")).when(named.isNotNull(), _year(F.when(first_year, p).otherwise(q)))
            .when(F.length(a) == 4, a.try_cast("int")).otherwise(_year(c)))
    month = (F.when(eight, F.substring(a, 5, 2).try_cast("int")).when(named.isNotNull(), named)
             .when((F.length(a) == 4) | late, b.try_cast("int")).otherwise(a.try_cast("int")))
    day = (F.when(eight, F.substring(a, 7, 2).try_cast("int")).when(named.isNotNull(), F.when(first_year, q).otherwise(p).try_cast("int"))
           .when(F.length(a) == 4, c.try_cast("int")).when(late, a.try_cast("int")).otherwise(b.try_cast("int")))
    whole = eight | ((F.size(fields) == 3) & (F.size(digits) == F.when(named.isNotNull(), 2).otherwise(3)))
    return F.when(plain & whole, F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d"))
