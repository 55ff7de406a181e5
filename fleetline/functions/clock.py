"""Service dates and clock times.

Timestamps are UTC wall clock (timestamp_ntz); a service date has its own zone, and its
clock may run past 24:00.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TZ = "America/New_York"


def seconds(n: Column) -> Column:
    """n seconds as an interval, to the microsecond."""
    return F.expr("INTERVAL '1' SECOND") * n


def gtfs_seconds(text: Column) -> Column:
    """'HH:MM:SS' (HH may pass 23) as seconds of the service day; null if malformed."""
    part = F.split(F.trim(text), ":")
    hms = [F.get(part, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when(F.size(part) == 3, hms[0] * 3600 + hms[1] * 60 + hms[2])


def to_utc(local: Column, tz: str = TZ) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def to_local(utc: Column, tz: str = TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def gtfs_time_to_utc(date: Column, secs: Column, tz: str = TZ) -> Column:
    """The UTC instant at which a wall clock of the zone shows date + secs."""
    return to_utc(date.cast("timestamp_ntz") + seconds(secs), tz)


def gtfs_seconds_to_local(date: Column, secs: Column, tz: str = TZ) -> Column:
    """Local wall time secs after local midnight; differs from the wall clock on days when clocks change."""
    return to_local(to_utc(date.cast("timestamp_ntz"), tz) + seconds(secs), tz)


def gtfs_time_on_reference_day(ts: Column, secs: Column, *, most_days: int | None = None) -> Column:
    """The schedule's clock put on the ping's own date; ``most_days`` limits days added past 24 h."""
    days = F.floor(secs / 86400)
    days = F.least(days, F.lit(most_days)) if most_days is not None else days
    return F.date_trunc("day", ts).cast("timestamp_ntz") + seconds(F.pmod(secs, F.lit(86400)) + days * 86400)


def parse_service_date(text: Column) -> Column:
    """yyyyMMdd as a date, else null."""
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))


def local_hour(utc: Column, tz: str = TZ) -> Column:
    return F.hour(to_local(utc, tz))


def local_date(utc: Column, tz: str = TZ) -> Column:
    return F.to_date(to_local(utc, tz))


def local_day_bounds(date: Column, tz: str = TZ) -> tuple[Column, Column, Column]:
    """UTC midnight of the date, of the next and of the one after (end of the position window)."""
    return tuple(to_utc(F.date_add(date, k).cast("timestamp_ntz"), tz) for k in range(3))


def day_type(date: Column) -> Column:
    """weekday, saturday or sunday."""
    day = F.weekday(date)
    return F.when(day == 5, "saturday").when(day == 6, "sunday").otherwise("weekday")


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """service_date: every date from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("service_date"))


def last_days(spark: SparkSession, as_of: str, days: int, *, complete: bool = False) -> DataFrame:
    """The last ``days`` dates, ending on ``as_of``, or the day before for complete days."""
    end = F.date_sub(F.lit(as_of).cast("date"), 1 if complete else 0)
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("service_date"))
