"""Timestamps: parts, sets of parts and keys, arithmetic in seconds, and how lengths of time are said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASONS = ("winter", "spring", "summer", "autumn")
PARTS_OF_DAY = ("nighttime", "morning", "afternoon", "evening")


def _those(**tests: Column) -> Column:
    """The sorted set of the names whose test holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items()))))


def season(ts: Column) -> Column:
    """The seasons of a month, as a set: months on an edge are in two."""
    m = F.month(ts)
    return _those(winter=(m >= 12) | (m < 4), spring=(m >= 3) & (m < 6), summer=(m > 5) & (m < 10), autumn=(m > 8) & (m < 12))


def time_of_day(ts: Column) -> Column:
    """The parts of the day of an hour, as a set: they overlap in the evening."""
    h = F.hour(ts)
    return _those(nighttime=(h < 5) | (h > 20), morning=(h >= 5) & (h < 12), afternoon=(h >= 12) & (h < 19), evening=(h > 16) & (h < 22))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def iso_basic(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss")


def rfc822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def iso_keys(ts: Column) -> Column:
    """Index keys: year, month and day as prefixes of the ISO form, behind a plus."""
    return F.array(F.date_format(ts, "'+'yyyy"), F.date_format(ts, "'+'yyyy-MM"), F.date_format(ts, "'+'yyyy-MM-dd"))


def time_keys(ts: Column) -> Column:
    """iso_keys() with the names of the month and the day of the week."""
    return F.array_sort(F.concat(iso_keys(ts), F.array(F.lower(F.date_format(ts, "MMM")), F.lower(F.date_format(ts, "EEE")))))


def truncate(ts: Column, precision: str) -> Column:
    """A timestamp cut to a precision: year, month, day, hour, minute, second, millisecond."""
    return F.date_trunc(precision, ts)


def plus(ts: Column, seconds: Column | float) -> Column:
    return ts + F.make_dt_interval(secs=seconds if isinstance(seconds, Column) else F.lit(seconds))


def difference(a: Column, b: Column) -> Column:
    """Seconds from b to a, with fractions."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6


def is_future(ts: Column, margin: float = 0.0) -> Column:
    return difference(ts, F.current_timestamp()) > margin


def is_past(ts: Column, margin: float = 0.0) -> Column:
    return difference(F.current_timestamp(), ts) > margin


def make(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    return F.make_timestamp(year, month, day, hour, minute, second)


def replace_parts(ts: Column, **parts: int) -> Column:
    """A timestamp with some parts changed: year, month, day, hour, minute, second."""
    own = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts), "minute": F.minute(ts), "second": F.second(ts)}
    own |= {k: F.lit(v) for k, v in parts.items()}
    return F.make_timestamp(*own.values())


#: Units of a length of time, in seconds (fixed values).
UNITS = (("year", 365 * 86400), ("month", 30 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1))


def spoken(seconds: Column) -> Column:
    """A whole number of seconds in words: "one day, 2 hours"."""
    left, parts = F.abs(seconds).cast("bigint"), []
    for name, size in UNITS:
        n = F.floor(left / size)
        one = F.lit("one " + name) if name != "second" else F.lit("1 seconds")
        parts.append(F.when(n == 1, one).when(n > 1, F.concat(n.cast("string"), F.lit(f" {name}s"))))
        left = left % size
    said = F.array_join(F.array_compact(F.array(*parts)), ", ")
    return F.when(seconds == 0, "0 seconds").otherwise(F.concat(F.when(seconds < 0, "negative ").otherwise(""), said))


def short(seconds: Column) -> Column:
    """A whole number of seconds as days and a clock: "2d-03:04:05"."""
    s = F.abs(seconds).cast("bigint")
    clock = F.concat_ws(":", *(F.lpad(F.floor(x).cast("string"), 2, "0") for x in ((s % 86400) / 3600, (s % 3600) / 60, s % 60)))
    return F.concat(F.when(seconds < 0, "negative ").otherwise(""), F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d-"))).otherwise(""), clock)


def uuid_time(uuid: Column) -> Column:
    """The timestamp in a time-based UUID (100 ns since 1582-10-15)."""
    parts = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    ticks = F.conv(parts, 16, 10).cast("decimal(20,0)")
    return F.timestamp_micros(((ticks - F.lit(122192928000000000).cast("decimal(20,0)")) / 10).cast("bigint"))


def uuid_node(uuid: Column) -> Column:
    return F.conv(F.substring(uuid, 25, 12), 16, 10).cast("bigint")

#: Parts of a timestamp by name.
_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofweek": lambda t: F.dayofweek(t) - 1, "dayofyear": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter,
}


def part(ts: Column, name: str) -> Column:
    """A part of a timestamp: year, month, day, hour, minute, second, dayofweek (Sunday is 0), dayofyear, week, quarter; tick (whole
    seconds since 1970) and its finer forms milli and micro; and names: monthname, weekday."""
    if name in _PARTS:
        return _PARTS[name](ts)
    whole = ts.cast("timestamp")
    ticks = {"tick": F.unix_seconds, "milli": F.unix_millis, "micro": F.unix_micros}
    if name in ticks:
        return ticks[name](whole)
    names = {"monthname": "MMM", "weekday": "EEE"}
    return F.lower(F.date_format(ts, names[name]))


def precise(ts: Column, precision: str) -> Column:
    """The ISO form of a timestamp as far as its precision: year, month, day, hour, minute, second, millisecond."""
    forms = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH", "minute": "yyyy-MM-dd'T'HH:mm", "second": "yyyy-MM-dd'T'HH:mm:ss", "millisecond": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return F.date_format(ts, forms[precision])


def is_later(a: Column, b: Column) -> Column:
    return difference(a, b) > 0


def is_earlier(a: Column, b: Column) -> Column:
    return difference(a, b) < 0


def from_tick(seconds: Column) -> Column:
    """The timestamp of a number of seconds since 1970."""
    return F.timestamp_seconds(seconds)
