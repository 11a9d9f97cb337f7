"""Dates written in text.

A text is read as its numbers and month names, each with what stands after it. Three neighbours in a row that read as day,
month and year in one of the usual orders are a date, and so are a month and a year by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, let

# Month names and their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8,
    "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
MARK = r"(?i)\b(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\b|[0-9]+"
EARLIEST, PASSAGE_DATES = 1900, 6


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, or null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def _marks(text: Column) -> Column:
    """Array of a text's marks in order: month (null for a number), short and year (a number of up to two, and of four,
    digits) and gap, what stands before the next mark."""
    number = F.create_map([x for name, n in MONTHS.items() for x in (F.lit(name), F.lit(n))])
    found, between = F.regexp_extract_all(text, F.lit(MARK), F.lit(0)), F.split(text, MARK, -1)

    def mark(z: Column) -> Column:
        month, size = F.try_element_at(number, F.lower(z["m"])), F.length(z["m"])
        value = F.when(month.isNull() & (size <= 4), z["m"].cast("int"))
        return F.struct(month.alias("month"), F.when(size <= 2, value).alias("short"), F.when(size == 4, value).alias("year"), z["g"].alias("gap"))

    return F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))).alias("g")), mark)


def _named(a: Column, b: Column) -> Column:
    """Whether a is the day of the month b."""
    return a["short"].isNotNull() & b["month"].isNotNull() & a["gap"].rlike(r"^(?i:st|nd|rd|th)?[\s-]+$") & b["gap"].rlike(r"^\.?[\s,-]+$")


def _full(a: Column, b: Column, c: Column) -> Column:
    """The date of three marks in a row, or null."""
    plain = a["gap"].rlike("^[/.-]$") & b["gap"].rlike("^[/.-]$") & b["short"].isNotNull()
    swapped = (b["short"] > 12) & (a["short"] <= 12)
    after = a["month"].isNotNull() & b["short"].isNotNull() & a["gap"].rlike(r"^\.?\s+$") & b["gap"].rlike(r"^(?i:st|nd|rd|th)?,?\s+$")
    return (
        F.when(plain & a["year"].isNotNull() & c["short"].isNotNull(), _date(a["year"], b["short"], c["short"]))
        .when(c["year"].isNull(), None)
        .when(plain & a["short"].isNotNull(), _date(c["year"], F.when(swapped, a["short"]).otherwise(b["short"]), F.when(swapped, b["short"]).otherwise(a["short"])))
        .when(_named(a, b), _date(c["year"], b["month"], a["short"]))
        .when(after, _date(c["year"], a["month"], b["short"]))
    )


def dates_in(text: Column, today: Column) -> Column:
    """Every date written in the text from 1900 up to `today`, sorted, each once. Day first unless only the other way can
    be right; a month with a year counts as its first day where it is no part of a full date."""

    def all_of(marks: Column) -> Column:
        def here(mark: Column, i: Column) -> Column:
            following, before = F.get(marks, i + 1), F.get(marks, i - 1)
            whole = _full(mark, following, F.get(marks, i + 2))
            month_only = mark["month"].isNotNull() & following["year"].isNotNull() & mark["gap"].rlike(r"^\.?[\s,'-]+$") & ~F.coalesce(_named(before, mark), F.lit(False))
            return F.coalesce(whole, F.when(month_only, _date(following["year"], mark["month"], F.lit(1))))

        return F.transform(marks, here)

    found = let(_marks(ascii_digits(text)), all_of)
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull() & (F.year(d) >= EARLIEST) & (d <= today))))


def passage_dates(dates: Column, most: int = PASSAGE_DATES) -> Column:
    """The last few of sorted dates."""
    return F.slice(dates, F.greatest(F.lit(1), F.size(dates) - most + 1), most)
