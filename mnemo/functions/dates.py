"""Time ranges named in text, relative to an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = r"(day|week|month|year)s?"
# Names and number words that results depend on.
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NUMBERS = {
    "one": 1, "a": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20, "thirty": 30,
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def temporal_range(text: Column, now: Column) -> Column:
    """struct(start, end) of the first expression that applies, in a fixed order; null if none does."""
    t = F.lower(text)
    day = F.date_trunc("day", now)
    days = lambda n: F.make_dt_interval(n.cast("int"))
    size = lambda u: F.when(u == "day", 1).when(u == "week", 7).when(u == "month", 30).otherwise(365)
    part = lambda p, i: F.regexp_extract(t, p, i)
    span = lambda a, b: F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end"))
    one = F.lit(1)
    last_n = rf"(?:last|past) ([0-9]+) {_UNIT}"
    ago = rf"([0-9]+) {_UNIT} ago"
    named = r"(?:last|this) (week|month|year)"
    iso = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    month_year = rf"({'|'.join(MONTHS)}) ([0-9]{{4}})"
    in_year = r"in ([0-9]{4})(?:[^0-9]|$)"
    back = F.coalesce(F.nullif(part(ago, 1), F.lit("")).cast("int") * size(part(ago, 2)), F.lit(0))
    start_of = F.when(part(named, 1) == "week", F.date_trunc("week", now)).when(part(named, 1) == "month", F.date_trunc("month", now)).otherwise(F.date_trunc("year", now))
    before = F.when(part(named, 1) == "week", start_of - F.expr("INTERVAL 7 DAYS")).when(part(named, 1) == "month", F.add_months(start_of, -1).cast("timestamp")).otherwise(F.add_months(start_of, -12).cast("timestamp"))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(month_year, 1)).cast("int")
    first = F.to_timestamp(F.concat_ws("-", part(month_year, 2), F.lpad(month.cast("string"), 2, "0"), F.lit("01")))
    on = F.try_to_timestamp(part(iso, 1))
    year = F.try_to_timestamp(F.concat(part(in_year, 1), F.lit("-01-01")))
    return (
        F.when(t.rlike(last_n), span(now - days(F.coalesce(F.nullif(part(last_n, 1), F.lit("")).cast("int"), F.lit(0)) * size(part(last_n, 2))), now))
        .when(t.rlike(ago), span(day - days(back), day - days(back) + days(one)))
        .when(t.contains("yesterday"), span(day - days(one), day))
        .when(t.contains("today"), span(day, now))
        .when(t.rlike(r"last (week|month|year)"), span(before, start_of))
        .when(t.rlike(r"this (week|month|year)"), span(start_of, now))
        .when(t.rlike(month_year), span(first, F.add_months(first, 1)))
        .when(on.isNotNull(), span(on, on + days(one)))
        .when(t.rlike(in_year), span(year, F.add_months(year, 12)))
    )


def date_keywords(text: Column, now: Column) -> Column:
    """The dates that a text means by relative expressions, as words to search by: an array of strings, one for each kind
    of expression (its first occurrence), in a fixed order; empty for a null text. Numbers above 100,000 mean nothing."""
    t = F.lower(F.coalesce(text, F.lit("")))
    day = F.to_date(now)
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    name = lambda d: F.date_format(d, "MMMM")
    number = lambda d: F.date_format(d, "dd")
    said = lambda when, *parts: F.when(when, F.concat_ws(" ", *parts))
    part = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    table = F.create_map(*(F.lit(y) for x in NUMBERS.items() for y in x))

    def back(pattern: str) -> Column:
        """Days that a number and a unit of time span."""
        n = F.coalesce(F.try_element_at(table, part(pattern, 1)), part(pattern, 1).try_cast("int"))
        unit = part(pattern, 2)
        return F.when(n <= 100_000, n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365))

    weekday = part(rf"last\s+({'|'.join(DAYS)})", 1)
    since = F.pmod(F.weekday(day) - F.array_position(F.array(*map(F.lit, DAYS)), weekday) + 1, F.lit(7)).cast("int")
    then = F.date_sub(day, F.when(since == 0, 7).otherwise(since))
    sat = F.date_sub(day, F.when(F.weekday(day) == 5, 7).otherwise((F.weekday(day) + 2) % 7))
    yesterday = F.date_sub(day, 1)
    monday = F.date_sub(day, F.weekday(day) + 7)
    ago = back(rf"([0-9]+|[a-z]+)\s+{_UNIT}\s+ago")
    center = F.date_sub(day, ago)
    past = back(rf"(?:last|past|previous)\s+([0-9]+|[a-z]+)\s+{_UNIT}")
    start = F.date_sub(day, past)
    place = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), m).cast("int")
    in_month = lambda m, y: F.concat_ws(" ", F.initcap(m), y, F.concat(y, F.lit("-"), F.lpad(place(m).cast("string"), 2, "0")))
    bare = part(rf"in\s+({'|'.join(MONTHS)})\b", 1)
    dated = rf"in\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})"
    its_year = F.regexp_like(t, F.concat(F.lit(r"in\s+"), F.coalesce(bare, F.lit("-")), F.lit(r"\s+[0-9]{4}")))
    latest = (F.year(day) - F.when(place(bare) <= F.month(day), 0).otherwise(1)).cast("string")
    return F.array_compact(F.array(
        said(weekday.isNotNull(), F.initcap(weekday), iso(then), name(then), number(then)),
        said(t.contains("last weekend"), F.lit("Saturday Sunday"), iso(sat), iso(F.date_add(sat, 1))),
        said(t.contains("yesterday"), iso(yesterday), name(yesterday), number(yesterday)),
        said(t.contains("last week") & ~t.contains("weekend"), iso(monday), iso(F.date_add(monday, 6))),
        said(ago.isNotNull(), iso(center), name(center), number(center)),
        said(past.isNotNull(), iso(start), iso(day), name(start), name(day)),
        F.when(bare.isNotNull() & ~its_year, in_month(bare, latest)),
        F.when(part(dated, 1).isNotNull(), in_month(part(dated, 1), part(dated, 2))),
    ))


def anchored_range(text: Column, anchor: Column) -> Column:
    """struct(start, end): the range of time that a question asked at `anchor` means, each row by its own; null if none.

    In this order: the last weekday or weekend (two days either side), some units ago (a quarter of them either side, three
    days at least), between two dates (a day more on both sides), the last units (a day more), a month of a year (a day
    more on both sides). Months are 30 days and years 365; numbers are digits or words. An impossible date or an unknown
    number lets the next form try, but for "last <word> weeks", which ends it. Numbers above 100,000 mean nothing.
    """
    t = F.coalesce(text, F.lit(""))
    part = lambda p, i: F.regexp_extract(t, p, i)
    span = lambda a, b: F.struct(a.cast("timestamp").alias("start"), b.cast("timestamp").alias("end"))
    micros = lambda days: F.make_dt_interval(days.cast("int"))
    table = F.create_map(*(F.lit(y) for x in NUMBERS.items() if x[0] != "a" for y in x))

    def number(word: Column) -> Column:
        digits = word.rlike("^[0-9]+$") & (F.length(word) <= 6)
        n = F.when(digits, word.try_cast("int")).otherwise(F.try_element_at(table, F.lower(word)))
        return F.when(n <= 100_000, n)

    def length(pattern: str) -> Column:
        unit = F.lower(part(pattern, 2))
        return number(part(pattern, 1)) * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(365)

    weekday = rf"(?i)last\s+({'|'.join(DAYS)}|weekend)"
    ago = r"(?i)([0-9]+|[a-z]+)\s+(day|week|month|year)s?\s+ago"
    dates = r"(?i)(?:between|from)\s+([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})\s+(?:and|to)\s+([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})"
    last = r"(?i)(?:last|past|previous)\s+([0-9]+|[a-z]+)\s+(day|week|month|year)s?"
    month = rf"(?i)in\s+({'|'.join(MONTHS)})\s+([0-9]{{4}})"
    name = F.lower(part(weekday, 1))
    target = F.when(name == "weekend", 5).otherwise(F.array_position(F.array(*map(F.lit, DAYS)), name) - 1)
    back = F.pmod(F.weekday(anchor) - target, F.lit(7))
    day = anchor - micros(F.when(back == 0, 7).otherwise(back))
    size = length(ago)
    buffer = F.greatest(F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (size * 21600).cast("decimal(18,6)")), F.expr("INTERVAL 3 DAYS"))
    centre = anchor - micros(size)
    at = lambda i: F.try_to_date(F.regexp_replace(part(dates, i), "/", "-"), "yyyy-M-d")
    one = F.expr("INTERVAL 1 DAY")
    first = F.make_date(part(month, 2).try_cast("int"), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(month, 1))).cast("int"), F.lit(1)).cast("timestamp")
    two = F.expr("INTERVAL 2 DAYS")
    return (
        F.when(anchor.isNull(), None).when(t.rlike(weekday), span(day - two, day + two))
        .when(t.rlike(ago) & size.isNotNull(), span(centre - buffer, centre + buffer))
        .when(t.rlike(dates) & at(1).isNotNull() & at(2).isNotNull(), span(F.least(at(1), at(2)).cast("timestamp") - one, F.greatest(at(1), at(2)).cast("timestamp") + one))
        .when(t.rlike(last), F.when(length(last).isNotNull(), span(anchor - micros(length(last)) - one, anchor)))
        .when(t.rlike(month) & (part(month, 2) != "0000"), span(first - one, F.add_months(first, 1).cast("timestamp") + one))
    )
