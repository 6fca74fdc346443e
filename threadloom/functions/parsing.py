"""Typed values from raw CSV strings, as Spark columns.

Each parser gives NULL for a string that does not parse. Row rejection looks
at the results: NULL is bad in a required field, and in an optional one only
where the raw string was not empty.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import stripped

_INTEGER = r"(?U)^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"
_INTEGER_OR_ZERO_FRACTION = r"(?U)^\s*[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?\s*\z"

# The usual form, with every part at a fixed place.
_PLAIN_DATE = (
    r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) "
    r"[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-](?:0[0-9]|1[0-7])[0-5][0-9] [0-9]{4}\z"
)
# Day name, month name, day, time, offset and year. The day name is only
# checked to be one, since it need not agree with the date.
_TWEET_DATE = (
    r"^(?i:mon|tue|wed|thu|fri|sat|sun)\s+"
    r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+"
    r"[0-9]{1,2}\s+[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\s+"
    r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?:[0-5][0-9](?:[0-5][0-9])?|:[0-5][0-9](?::[0-5][0-9])?))\s+"
    r"[0-9]{4}\z"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _digits(raw: Column) -> Column:
    """Drop blanks, digit separators and a zero fraction, then read a long."""
    return F.regexp_replace(raw, r"(?U)[\s_]|\..*", "").try_cast("bigint")


def tweet_id(raw: Column) -> Column:
    """Lenient id: blanks, sign, ``1_000`` and ``1.0`` pass; ``1.5`` does not."""
    return F.when(raw.rlike(_INTEGER_OR_ZERO_FRACTION), _digits(raw))


def strict_integer(raw: Column) -> Column:
    """Id without any fraction part."""
    return F.when(raw.rlike(_INTEGER), _digits(raw))


def inbound(raw: Column) -> Column:
    """True only for the word true; every other string is False."""
    return F.lower(stripped(raw)) == "true"


def _month(name: Column) -> Column:
    number = ((F.instr(F.lit(_MONTHS), F.lower(name)) + 2) / 3).cast("int")
    return F.lpad(number.cast("string"), 2, "0")


def _plain_date(raw: Column) -> Column:
    """Parts taken by place, put together in the form the cast reads fastest."""

    def part(start: int, length: int) -> Column:
        return F.substring(raw, start, length)

    return F.concat(
        part(27, 4), F.lit("-"), _month(part(5, 3)), F.lit("-"), part(9, 2), F.lit(" "), part(12, 8),
        part(21, 3), F.lit(":"), part(24, 2),
    ).try_cast("timestamp")


def _any_date(raw: Column) -> Column:
    """Runs of blanks, single digits, seconds or colons in the offset, Z."""
    parts = F.split(raw, r"\s+")
    clock = F.split(parts[3], ":")
    local = F.concat_ws(
        " ",
        F.concat_ws("-", parts[5], _month(parts[1]), F.lpad(parts[2], 2, "0")),
        F.concat_ws(":", F.lpad(clock[0], 2, "0"), F.lpad(clock[1], 2, "0"), F.lpad(clock[2], 2, "0")),
    )
    # The zone suffix keeps the reading free of the session time zone.
    as_utc = F.concat(local, F.lit("Z")).try_cast("timestamp")
    zone = F.rpad(F.regexp_replace(parts[4], ":", ""), 7, "0")
    offset = F.when(parts[4] == "Z", F.lit(0)).otherwise(
        F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
        * (
            F.substring(zone, 2, 2).try_cast("int") * 3600
            + F.substring(zone, 4, 2).try_cast("int") * 60
            + F.substring(zone, 6, 2).try_cast("int")
        )
    )
    return F.timestamp_seconds(F.unix_seconds(as_utc) - offset)


def created_at(raw: Column) -> Column:
    """``Fri Mar 11 06:25:03 +0000 2016`` with any offset, as a UTC instant."""
    return F.when(raw.rlike(_PLAIN_DATE), _plain_date(raw)).when(raw.rlike(_TWEET_DATE), _any_date(raw))


def id_list(raw: Column) -> Column:
    """Comma-separated ids; NULL for "", a NULL element for an unreadable part."""
    return F.when(raw != "", F.transform(F.split(raw, ","), strict_integer))


def optional_id(raw: Column) -> Column:
    return F.when(raw != "", strict_integer(raw))
