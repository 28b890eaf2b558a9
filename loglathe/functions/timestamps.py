"""Leading timestamps: strftime formats compiled to Spark column expressions.

A format becomes one anchored regular expression plus a rule that turns the captured fields into
a ``TIMESTAMP_NTZ``. Nothing here depends on the session time zone: values are built by casting
text to ``TIMESTAMP_NTZ`` and differenced with NTZ interval arithmetic. ``timestampdiff``,
``unix_micros`` and ``date_format`` are avoided because they go through a zoned timestamp and
move values that fall into a daylight-saving gap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_FORMAT = "%Y-%m-%d %H:%M:%S%.3f"

# Date given to records whose timestamp has no date, year given to yearless ones.
DEFAULT_DATE = "2025-01-01"
DEFAULT_YEAR = "2025"

# Specifiers that make a format a date format; without any it is a time of day.
DATE_SPECIFIERS = (
    "%Y %C %y %q %m %b %B %h %d %e %a %A %w %u %U %W %G %g %V %j %D %x %F %v %s".split()
)

MONTHS = (
    "january february march april may june july august september october november december"
).split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
_SHORT_MONTHS = "".join(m[:3] for m in MONTHS)
_SHORT_WEEKDAYS = "".join(d[:3] for d in WEEKDAYS)

# Shorthands that stand for several specifiers.
_COMPOSITE = {
    "F": "%Y-%m-%d",
    "T": "%H:%M:%S",
    "X": "%H:%M:%S",
    "D": "%m/%d/%y",
    "x": "%m/%d/%y",
    "R": "%H:%M",
    "r": "%I:%M:%S %p",
    "v": "%e-%b-%Y",
    "c": "%a %b %e %H:%M:%S %Y",
    "+": "%Y-%m-%dT%H:%M:%S%.f%:z",
}

_TO_END = (1 << 31) - 1
_SEPARATOR = "\x1f"
_FRACTION = r"(?:\.(\d{1,6}+)\d*+|(?!\.))"
_OFFSET = r"\s*+(?:[zZ]|[+-]\d{2}:?+\d{2})"


def _names(names: list[str], long: bool) -> str:
    forms = [f"{n}|{n[:3]}" if long else n[:3] for n in names]
    return r"((?i:" + "|".join(forms) + "))"


# specifier -> (field, regex); possessive quantifiers keep the match greedy, left to right.
_SPECIFIERS = {
    "Y": ("year", r"\s*+(\d{1,4}+)"),
    "y": ("year2", r"\s*+(\d{1,2}+)"),
    "m": ("month", r"\s*+(\d{1,2}+)"),
    "b": ("month_name", _names(MONTHS, long=False)),
    "h": ("month_name", _names(MONTHS, long=False)),
    "B": ("month_name", _names(MONTHS, long=True)),
    "d": ("day", r"\s*+(\d{1,2}+)"),
    "e": ("day", r"\s*+(\d{1,2}+)"),
    "j": ("doy", r"\s*+(\d{1,3}+)"),
    "a": ("weekday_name", _names(WEEKDAYS, long=False)),
    "A": ("weekday_name", _names(WEEKDAYS, long=True)),
    "u": ("weekday_iso", r"\s*+(\d)"),
    "w": ("weekday_sun", r"\s*+(\d)"),
    "H": ("hour", r"\s*+(\d{1,2}+)"),
    "k": ("hour", r"\s*+(\d{1,2}+)"),
    "I": ("hour12", r"\s*+(\d{1,2}+)"),
    "l": ("hour12", r"\s*+(\d{1,2}+)"),
    "p": ("ampm", r"((?i:am|pm))"),
    "P": ("ampm", r"((?i:am|pm))"),
    "M": ("minute", r"\s*+(\d{1,2}+)"),
    "S": ("second", r"\s*+(\d{1,2}+)"),
    "s": ("epoch", r"\s*+(\d++)"),
    "f": ("nanos", r"\s*+(\d{1,9}+)"),
    ".f": ("fraction", _FRACTION),
    ".3f": ("fraction", _FRACTION),
    ".6f": ("fraction", _FRACTION),
    ".9f": ("fraction", _FRACTION),
    "3f": ("fraction", r"(\d{3})"),
    "6f": ("fraction", r"(\d{6})"),
    "9f": ("fraction", r"(\d{6})\d{3}"),
    "z": (None, _OFFSET),
    ":z": (None, _OFFSET),
    "Z": (None, r"\S*+"),
    "n": (None, r"\s*+"),
    "t": (None, r"\s*+"),
    "%": (None, "%"),
}

# Formats whose text the cast to TIMESTAMP_NTZ reads directly.
_ISO_FORMAT = re.compile(r"(?:%Y-%m-%d|%F)[ T](?:%H:%M:%S|%T)(?:%\.\d?f)?")

_TOKEN = re.compile(r"%[-_0]?([.:]?\d?[A-Za-z+%])|(\s+)|([^%\s]+)")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a ``TIMESTAMP_NTZ``, free of the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return _int_div(ts - epoch, F.expr("INTERVAL '0.000001' SECOND"))


def micros_to_ts(us: Column) -> Column:
    """Inverse of :func:`epoch_micros`."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", us, epoch)


def floor_millis(us: Column) -> Column:
    """Cut microseconds to whole milliseconds, the precision that records keep."""
    return us - F.pmod(us, F.lit(1000))


def _int_div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def whole_millis(us_difference: Column) -> Column:
    """A microsecond difference in whole milliseconds, truncated toward zero."""
    return _int_div(us_difference, F.lit(1000))


def date_text(ts: Column) -> Column:
    return F.substring(ts.cast("string"), 1, 10)


def time_text(ts: Column) -> Column:
    """``HH:mm:ss.SSS`` cut from the text of a ``TIMESTAMP_NTZ``."""
    text = ts.cast("string")
    dotted = F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
    return F.substring(F.rpad(dotted, 23, "0"), 12, 12)


def millis_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS``."""
    return F.concat_ws(" ", date_text(ts), time_text(ts))


def parse_date_time(date: Column, time: Column) -> Column:
    """The timestamp of a record row whose date and time are text columns."""
    return F.concat_ws(" ", F.trim(date), F.trim(time)).try_cast("timestamp_ntz")


@dataclass(frozen=True)
class TimeFormat:
    """A strftime-like timestamp format, compiled on the driver."""

    text: str = DEFAULT_FORMAT

    @property
    def has_date(self) -> bool:
        return any(spec in self.text for spec in DATE_SPECIFIERS)

    @cached_property
    def _compiled(self) -> tuple[str, dict[str, int]]:
        regex, fields = ["^"], {}
        pending = [self.text]
        while pending:
            text, pos = pending.pop(0), 0
            while pos < len(text):
                token = _TOKEN.match(text, pos)
                if token is None:
                    raise ValueError(f"bad timestamp format {self.text!r} at {text[pos:]!r}")
                pos = token.end()
                spec, blank, literal = token.groups()
                if blank:
                    regex.append(r"\s*+")
                elif literal:
                    regex.append(re.escape(literal))
                elif spec in _COMPOSITE:
                    pending.insert(0, text[pos:])
                    pending.insert(0, _COMPOSITE[spec])
                    break
                elif spec in _SPECIFIERS:
                    field, piece = _SPECIFIERS[spec]
                    if field in fields:
                        raise ValueError(f"timestamp format {self.text!r} repeats the {field}")
                    if field:
                        fields[field] = len(fields) + 1
                    regex.append(piece)
                else:
                    raise ValueError(f"unsupported specifier %{spec} in format {self.text!r}")
        self._check(fields)
        return "".join(regex), fields

    def _check(self, fields: dict[str, int]) -> None:
        """Refuse formats under which no line could ever have a timestamp."""
        have = fields.keys()
        if "epoch" in have:
            return
        hour = "hour" in have or {"hour12", "ampm"} <= have
        second = "second" in have or not {"fraction", "nanos"} & have
        if not (hour and "minute" in have and second):
            raise ValueError(f"timestamp format {self.text!r} does not give a time of day")
        month = "month" in have or "month_name" in have
        if self.has_date and not ("doy" in have or (month and "day" in have)):
            raise ValueError(f"timestamp format {self.text!r} does not give a date")

    @property
    def regex(self) -> str:
        return self._compiled[0]

    def prefix(self, line: Column) -> Column:
        """The text the format matches at the start of the line, ``''`` if it does not."""
        return F.regexp_extract(line, self.regex, 0)

    def fields(self, prefix: Column) -> Column:
        """The captured texts as an array, in one regex pass; none for an empty prefix."""
        regex, fields = self._compiled
        joined = _SEPARATOR.join(f"${i}" for i in sorted(fields.values()))
        found = F.regexp_replace(prefix, F.lit(regex), F.lit(joined))
        return F.when(prefix != "", F.split(found, _SEPARATOR, -1))

    def timestamp(self, prefix: Column, fields: Column) -> Column:
        """``TIMESTAMP_NTZ`` of a prefix and its ``fields``; NULL for an impossible one.

        ``fields`` should be a column of its own, so that it is computed once.
        """
        names = self._compiled[1].keys()
        if "epoch" in names:
            seconds = self._text(fields, "epoch").try_cast("bigint")
            fraction = {"fraction", "nanos"} & names
            micros = self._micros(fields) if fraction else F.lit(0).cast("bigint")
            return micros_to_ts(F.try_add(F.try_multiply(seconds, F.lit(1_000_000)), micros))
        if names <= {"year", "month", "day", "hour", "minute", "second", "fraction"}:
            return self._numeric_timestamp(prefix)
        return self._general_timestamp(fields)

    def _text(self, fields: Column, name: str) -> Column:
        return F.get(fields, self._compiled[1][name] - 1)

    def _micros(self, fields: Column) -> Column:
        if "nanos" in self._compiled[1]:
            nanos = self._text(fields, "nanos").try_cast("bigint")
            return _int_div(nanos, F.lit(1000))
        return F.rpad(self._text(fields, "fraction"), 6, "0").try_cast("bigint")

    def _numeric_timestamp(self, prefix: Column) -> Column:
        """All fields are plain numbers: one regex rewrite to ISO text, one cast.

        An absent fraction leaves a trailing dot, which the cast accepts.
        """
        regex, fields = self._compiled

        def ref(field: str, default: str) -> str:
            return f"${fields[field]}" if field in fields else default

        if self.has_date:
            # The cast wants four to six year digits; two zeros in front change no value.
            year = f"00${fields['year']}" if "year" in fields else DEFAULT_YEAR
            date = f"{year}-{ref('month', '01')}-{ref('day', '01')}"
        else:
            date = DEFAULT_DATE
        iso = (
            f"{date} {ref('hour', '00')}:{ref('minute', '00')}:{ref('second', '00')}"
            f".{ref('fraction', '0')}"
        )
        ts = F.regexp_replace(prefix, F.lit(regex), F.lit(iso)).try_cast("timestamp_ntz")
        if _ISO_FORMAT.fullmatch(self.text):
            # Nearly all prefixes of such a format can be cast as they are.
            ts = F.coalesce(prefix.try_cast("timestamp_ntz"), ts)
        return ts

    def _general_timestamp(self, fields: Column) -> Column:
        """Names, 12-hour clocks, days of the year: combine the captured fields."""
        names = self._compiled[1].keys()

        def number(name: str) -> Column:
            return self._text(fields, name).try_cast("int")

        def position(short_names: str, name: str) -> Column:
            short = F.lower(F.left(self._text(fields, name), F.lit(3)))
            return _int_div(F.instr(F.lit(short_names), short) + 2, F.lit(3))

        if "year" in names:
            year = number("year")
        elif "year2" in names:
            year = number("year2") + F.when(number("year2") < 70, 2000).otherwise(1900)
        else:
            year = F.lit(int(DEFAULT_YEAR))
        year_text = F.lpad(year.cast("string"), 4, "0")

        if not self.has_date:
            date = F.lit(DEFAULT_DATE).try_cast("date")
        elif "doy" in names:
            first = F.concat(year_text, F.lit("-01-01")).try_cast("date")
            days = number("doy")
            leap = F.dayofyear(F.concat(year_text, F.lit("-12-31")).try_cast("date"))
            date = F.when(days.between(1, leap), F.date_add(first, days - 1))
        else:
            month = number("month") if "month" in names else position(_SHORT_MONTHS, "month_name")
            date = F.concat_ws("-", year_text, month, number("day")).try_cast("date")
        date = self._with_weekday(date, number, position, names)

        minute, second = number("minute"), number("second") if "second" in names else F.lit(0)
        micros = self._micros(fields) if {"fraction", "nanos"} & names else F.lit(0)
        of_hour = (minute * 60 + second).cast("bigint") * 1_000_000 + micros
        of_hour = F.when((minute < 60) & (second < 60), of_hour)
        afternoon = F.lower(self._text(fields, "ampm")) == "pm" if "ampm" in names else None
        if "hour" in names:
            hour = number("hour")
            fits = hour < 24 if afternoon is None else (hour < 24) & ((hour >= 12) == afternoon)
        else:
            hour = number("hour12") % 12 + F.when(afternoon, 12).otherwise(0)
            fits = number("hour12").between(1, 12)
        of_day = F.when(fits, hour.cast("bigint") * 3_600_000_000 + of_hour)
        return F.timestamp_add("MICROSECOND", of_day, date.cast("timestamp_ntz"))

    @staticmethod
    def _with_weekday(date: Column, number, position, names) -> Column:
        """A stated weekday must agree with the date."""
        if "weekday_name" in names:
            date = F.when(F.weekday(date) + 1 == position(_SHORT_WEEKDAYS, "weekday_name"), date)
        if "weekday_iso" in names:
            date = F.when(F.weekday(date) + 1 == number("weekday_iso"), date)
        if "weekday_sun" in names:
            date = F.when((F.weekday(date) + 1) % 7 == number("weekday_sun"), date)
        return date

    @staticmethod
    def remainder(line: Column, prefix: Column) -> Column:
        """What follows the timestamp."""
        return F.substring(line, F.length(prefix) + 1, F.lit(_TO_END))

    def parse_literal(self, spark, text: str):
        """A timestamp given by the user in this format, as a Python datetime (driver only)."""
        line, prefix = F.lit(text), self.prefix(F.lit(text))
        row = spark.sql("SELECT 1").select(
            self.timestamp(prefix, self.fields(prefix)).alias("ts"),
            (prefix == line).alias("whole"),
        ).first()
        if row.ts is None or not row.whole:
            raise ValueError(f"{text!r} does not match the timestamp format {self.text!r}")
        return row.ts
