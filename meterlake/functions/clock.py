"""Instants, local days and trailing windows.

Sessions run with ``spark.sql.session.timeZone=UTC``; a day interval is then exactly 24
hours. :func:`local_day` is right under any session zone.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = dt.datetime | str | Column | None


def check_zone(tz: str) -> str:
    """Return ``tz`` if it is a known IANA zone, else raise ValueError."""
    try:
        zoneinfo.ZoneInfo(tz)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError) as exc:
        raise ValueError(f"unknown time zone {tz!r}, expected an IANA name") from exc
    return tz


def instant(as_of: AsOf = None) -> Column:
    """The reference moment of a report: now, or a fixed one (naive values are UTC)."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return F.lit(as_of.astimezone(dt.timezone.utc).isoformat()).cast("timestamp")


def before(moment: Column, *, days: int = 0, hours: int = 0) -> Column:
    """``moment`` moved back."""
    return moment - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def local_timestamp(ts: Column, tz: str) -> Column:
    """Wall-clock time of an instant in ``tz`` (TIMESTAMP_NTZ)."""
    wall = ts.cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit(check_zone(tz)), wall)


def local_day(ts: Column, tz: str) -> Column:
    """Calendar day of an instant in ``tz``.

    ``from_utc_timestamp`` measured four times faster than ``convert_timezone`` but is
    right only in a UTC session; the condition is constant, so one branch is planned.
    """
    fast = F.to_date(F.from_utc_timestamp(ts, check_zone(tz)))
    exact = F.to_date(local_timestamp(ts, tz))
    return F.when(F.current_timezone().isin("UTC", "Etc/UTC", "Z"), fast).otherwise(exact)


def trailing(events: DataFrame, start: Column) -> DataFrame:
    """Rows at or after ``start``; later than now counts too.

    Where the table is partitioned by ``event_date`` the implied date bound prunes it. The
    day of slack keeps that bound right whatever zone the session runs in.
    """
    rows = events.filter(F.col("ts") >= start)
    if "event_date" in events.columns:
        rows = rows.filter(F.col("event_date") >= F.date_sub(F.to_date(start), 1))
    return rows


def utc_ntz(ts: Column) -> Column:
    """An instant as a UTC wall-clock value, for results that must not shift."""
    return local_timestamp(ts, "UTC")
