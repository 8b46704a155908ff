"""Dates in properties, and the ranges that date filters offer."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = timedelta(days=1)


def unquote(value: str) -> str:
    """The value without one pair of quotes or square brackets around it."""
    if len(value) > 1 and value[0] + value[-1] in ('""', "''", "[]"):
        return value[1:-1].strip()
    return value


def _digits(text: str, least: int, most: int) -> bool:
    return least <= len(text) <= most and text.isascii() and text.isdigit()


def _day(text: str) -> date | None:
    """``YYYY-MM-DD`` or ``D.M.YYYY``."""
    for mark, turn in (("-", 1), (".", -1)):
        parts = text.split(mark)[::turn]
        if len(parts) == 3:
            rest = (2, 2) if mark == "-" else (1, 2)
            if _digits(parts[0], 4, 4) and all(_digits(x, *rest) for x in parts[1:]):
                return date(*map(int, parts))
    return None


def _clock(text: str) -> timedelta | None:
    """``HH:MM``, ``HH:MM:SS`` or with a fraction, of which milliseconds count."""
    whole, dot, fraction = text.partition(".")
    parts = whole.split(":")
    if len(parts) not in (2, 3) or not all(_digits(x, 2, 2) for x in parts):
        return None
    if dot and (len(parts) == 2 or not _digits(fraction, 1, len(text))):
        return None
    hours, minutes, seconds = (*map(int, parts), 0)[:3]
    if hours > 23 or minutes > 59 or seconds > 59:
        return None
    return timedelta(hours=hours, minutes=minutes, seconds=seconds, milliseconds=int(fraction[:3].ljust(3, "0")))


def _offset(text: str) -> timedelta | None:
    """``Z``, ``+HH:MM`` or ``+HHMM``."""
    if text in ("z", "Z"):
        return timedelta()
    hours, minutes = text[1:3], text[3:].removeprefix(":")
    if text[:1] not in ("+", "-") or not (_digits(hours, 2, 2) and _digits(minutes, 2, 2)):
        return None
    return timedelta(hours=int(hours), minutes=int(minutes)) * (-1 if text[0] == "-" else 1)


def parse_date(value: str, zone: str = "UTC") -> int | None:
    """Epoch milliseconds: 13 digits, 10 digits, ``D.M.YYYY`` or ISO 8601; None if it is none
    of these or no such day exists.  Times without an offset are local to ``zone``."""
    text = unquote(value.strip())
    if _digits(text, 13, 13) or _digits(text, 10, 10):
        return int(text.ljust(13, "0"))
    try:
        if "." in text[:3]:
            day, rest = _day(text), ""
        else:
            day, rest = _day(text[:10]), text[10:]
        if day is None:
            return None
        where, clock = ZoneInfo(zone), timedelta()
        if rest:
            time = rest[1:]
            at = max(time.find("+"), time.find("-"), time.lower().find("z"))
            if at >= 0:
                offset = _offset(time[at:])
                if offset is None or abs(offset) >= DAY:
                    return None
                where, time = timezone(offset), time[:at].removesuffix(" ")
            clock = _clock(time)
            if rest[0] not in "tT " or clock is None:
                return None
        # the clock is set, not run on from midnight: days may have 23 or 25 hours
        return round((datetime.combine(day, datetime.min.time()) + clock).replace(tzinfo=where).timestamp() * 1000)
    except (ValueError, OverflowError):
        return None


def parse_date_column(c: Column) -> Column:
    """:func:`parse_date` in the session's zone, without an UDF."""
    trimmed = F.trim(c)
    bare = trimmed.rlike(r"""^(?:".*"|'.*'|\[.*\])$""")
    text = F.when(bare, F.trim(F.substring(trimmed, F.lit(2), F.length(trimmed) - 2))).otherwise(trimmed)

    def digits(c: Column, count: str) -> Column:
        return c.rlike(f"^[0-9]{{{count}}}$")

    dots = F.split(text, "[.]", -1)
    dotted = (F.size(dots) == 3) & digits(F.get(dots, F.lit(0)), "1,2") & digits(F.get(dots, F.lit(1)), "1,2") & digits(F.get(dots, F.lit(2)), "4")
    turned = F.concat_ws("-", F.get(dots, F.lit(2)), F.lpad(F.get(dots, F.lit(1)), 2, "0"), F.lpad(F.get(dots, F.lit(0)), 2, "0"))

    day, rest = F.substring(text, 1, 10), F.substring(text, F.lit(11), F.length(text))
    zone = F.regexp_extract(rest, "([zZ]|[+-][0-9]{2}:?[0-9]{2})$", 1)
    time = F.substring(rest, F.lit(2), F.length(rest) - 1 - F.length(zone))
    time = F.when(zone != "", F.regexp_replace(time, " $", "")).otherwise(time)
    whole = F.split(F.substring_index(time, ".", 1), ":", -1)
    fraction = F.when(F.instr(time, ".") > 0, F.substring_index(time, ".", -1))
    second = F.coalesce(F.get(whole, F.lit(2)), F.lit("00"))
    timed = (
        F.substring(rest, 1, 1).isin("t", "T", " ")
        & F.size(whole).isin(2, 3)
        & F.forall(whole, lambda x: x.rlike("^[0-9]{2}$"))
        & (fraction.isNull() | ((F.size(whole) == 3) & fraction.rlike("^[0-9]+$") & (F.length(time) == 9 + F.length(fraction))))
    )
    offset = F.when(zone.isin("", "z", "Z"), F.when(zone == "", "").otherwise("+00:00")).otherwise(
        F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2)))
    )
    clock = F.concat(F.get(whole, F.lit(0)), F.lit(":"), F.get(whole, F.lit(1)), F.lit(":"), second)
    stamp = F.concat(day, F.lit(" "), clock, F.lit("."), F.rpad(F.left(F.coalesce(fraction, F.lit("0")), F.lit(3)), 3, "0"), offset)
    dated = day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.try_cast("date").isNotNull()
    return (
        F.when(digits(text, "13") | digits(text, "10"), F.rpad(text, 13, "0").try_cast("long"))
        .when(dotted, F.unix_millis(turned.try_cast("timestamp")))
        .when(dated & (rest == ""), F.unix_millis(day.try_cast("timestamp")))
        .when(dated & timed, F.unix_millis(stamp.try_cast("timestamp")))
    )


def millis_of(day: date, zone: str = "UTC") -> int:
    return round(datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone)).timestamp() * 1000)


def day_of(millis: int, zone: str = "UTC") -> date:
    return datetime.fromtimestamp(millis / 1000, ZoneInfo(zone)).date()


def start_of_day(millis: int, zone: str = "UTC") -> int:
    return millis_of(day_of(millis, zone), zone)


def end_of_day(millis: int, zone: str = "UTC") -> int:
    return millis_of(day_of(millis, zone) + DAY, zone) - 1


def add_days(millis: int, days: int, zone: str = "UTC") -> int:
    """Midnight so many days on, right over changes of daylight saving."""
    return millis_of(day_of(millis, zone) + days * DAY, zone)


def start_of_month(millis: int, zone: str = "UTC") -> int:
    return millis_of(day_of(millis, zone).replace(day=1), zone)


def days_in_month(year: int, month: int) -> int:
    return (date(year + month // 12, month % 12 + 1, 1) - DAY).day


def add_months(millis: int, months: int, zone: str = "UTC") -> int:
    """The same day so many months on, or the month's last."""
    day = day_of(millis, zone)
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    return millis_of(date(year, month + 1, min(day.day, days_in_month(year, month + 1))), zone)


def iso_weekday(millis: int, zone: str = "UTC") -> int:
    return day_of(millis, zone).isoweekday()


def normalize_range(a: int | None, b: int | None) -> tuple[int | None, int | None]:
    """Bounds in order."""
    return (b, a) if a is not None and b is not None and a > b else (a, b)


#: Days that the offered ranges reach back from today.
QUICK = {"today": 0, "week": 7, "month": 30, "year": 365}


def quick_range(kind: str, now: int, zone: str = "UTC") -> tuple[int | None, int | None]:
    """Bounds of an offered range, up to the end of today; ``any`` has none."""
    if kind not in QUICK:
        return None, None
    return add_days(now, -QUICK[kind], zone), end_of_day(now, zone)
