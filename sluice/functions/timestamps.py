"""Timestamps found in lines, as Column expressions (session time zone: UTC)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_literal, trim_space

#: The shapes of timestamps that are looked for.
UNIX = r"(?<![0-9A-Za-z_])(\d{10,13})(?:\.\d+)?(?![0-9A-Za-z_])"
ISO_DATETIME = r"\d{4}-\d{1,2}-\d{1,2}[T\s]\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?"
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
RFC = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+[+-]\d{4}"
CUSTOM = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[T\s]\d{1,2}:\d{1,2}(?::\d{1,2})?(?:\.\d+)?)?"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def made(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, ms: Column) -> Column:
    """A timestamp of whole numbers; parts beyond their range carry over."""
    month = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)
    days = F.datediff(month, F.lit("1970-01-01").cast("date")).cast("long") + d - 1
    return F.timestamp_millis(((days * 24 + h) * 60 + mi) * 60_000 + s * 1000 + ms)


def _number(parts: Column, k: int) -> Column:
    """A part as a whole number; 0 where it is missing."""
    return F.coalesce(F.get(parts, F.lit(k)).cast("int"), F.lit(0))


def _millis(fraction: Column, least: int = 1) -> Column:
    """Milliseconds of the digits after the point; 0 if fewer than least."""
    digits = F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("int")
    return F.when(F.length(fraction) >= least, digits).otherwise(F.lit(0))


def unix_time(c: Column, epoch_ms: bool = True) -> Column:
    """The first number of 10 to 13 digits. With epoch_ms, digits after the tenth
    are a fraction of the second; else they are dropped."""
    digits = F.regexp_extract(trim_space(c), UNIX, 1)
    number, extra = digits.cast("long"), F.length(digits) - 10
    scale = F.when(extra == 0, 1).when(extra == 1, 10).when(extra == 2, 100).otherwise(1000)
    seconds = F.floor(number / scale)
    value = F.timestamp_millis((number * F.lit(1000) / scale).cast("long")) if epoch_ms else F.timestamp_seconds(seconds)
    return F.when(digits != "", value)


def iso_time(c: Column) -> Column:
    """The first date and time, or else the first date. A zone is not read. The
    text is searched once, and what is found is split into its numbers."""
    full, date = F.regexp_extract(c, ISO_DATETIME, 0), F.regexp_extract(c, ISO_DATE, 0)
    parts = F.split(F.coalesce(F.nullif(full, F.lit("")), date), r"[-T\s:.]")
    n = lambda k: _number(parts, k)
    return F.when(F.size(parts) >= 3, made(n(0), n(1), n(2), n(3), n(4), n(5), _millis(F.coalesce(F.get(parts, F.lit(6)), F.lit("")))))


def rfc_time(c: Column, honor_tz: bool = False) -> Column:
    parts = F.split(F.regexp_extract(c, RFC, 0), r"[\s,:]+")  # day's name, day, month, year, hour, minute, second, zone
    n = lambda k: _number(parts, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.get(parts, F.lit(2))).cast("int")
    value = made(n(3), month, n(1), n(4), n(5), n(6), F.lit(0))
    if honor_tz:
        zone = F.get(parts, F.lit(7))
        minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
        value = F.timestamp_seconds(F.unix_seconds(value) - F.when(zone.startswith("-"), -minutes).otherwise(minutes) * 60)
    return F.when(F.size(parts) >= 8, value)


def custom_time(c: Column, pattern: str) -> Column:
    """Two usual patterns read as ISO; others need %Y, %m and %d and read a date
    in that order, with an optional time (a fraction of three digits or more)."""
    if pattern in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S"):
        return iso_time(c)
    if not all(x in pattern for x in ("%Y", "%m", "%d")):
        return F.lit(None).cast("timestamp")
    found = F.regexp_extract(c, CUSTOM, 0)
    day, time = F.split(F.regexp_extract(found, r"^[^T\s]+", 0), r"[-/.]"), F.regexp_extract(found, r"[T\s](.*)", 1)
    clock, fraction = F.split(F.regexp_extract(time, r"^[\d:]+", 0), ":"), F.regexp_extract(time, r"\.(\d+)", 1)
    n, t = (lambda k: _number(day, k)), (lambda k: F.coalesce(F.nullif(F.get(clock, F.lit(k)), F.lit("")).cast("int"), F.lit(0)))
    return F.when(found != "", made(n(0), n(1), n(2), t(0), t(1), t(2), _millis(fraction, 3)))


def timestamp_of(line: Column, kind: str = "auto", column: int = -1, delimiter: str = ",", pattern: str = "", epoch_ms: bool = True, honor_tz: bool = False) -> Column:
    """The timestamp of a line, or of one of its fields; null if there is none."""
    text = line if column < 0 else trim_space(F.get(split_literal(line, delimiter), F.lit(column)))
    if kind == "auto":
        return F.coalesce(unix_time(text, epoch_ms), iso_time(text), rfc_time(text, honor_tz))
    return {"unix": lambda: unix_time(text, epoch_ms), "iso8601": lambda: iso_time(text), "rfc2822": lambda: rfc_time(text, honor_tz), "custom": lambda: custom_time(text, pattern)}[kind]()


#: Parts of strftime patterns as parts of Spark's.
PARTS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def formatted(ts: Column, pattern: str) -> Column:
    """ts by a strftime pattern, in the session's time zone."""
    out = []
    for part in re.findall(r"%.|[^%]+|%", pattern, re.S):
        if part[0] != "%" or part in ("%%", "%"):
            out.append(F.lit("%" if part == "%%" else part))
        elif part[1] in PARTS:
            out.append(F.date_format(ts, PARTS[part[1]]))
        else:
            raise ValueError(f"unknown part {part!r} of a time pattern")
    return F.concat(*out) if out else F.when(ts.isNotNull(), F.lit(""))


def iso_text(ts: Column) -> Column:
    """UTC text with milliseconds only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    ms = F.pmod(F.unix_millis(ts), F.lit(1000))
    return F.concat(whole, F.when(ms > 0, F.concat(F.lit("."), F.lpad(ms.cast("string"), 3, "0"))).otherwise(""), F.lit("Z"))
