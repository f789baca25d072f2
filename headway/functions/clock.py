"""Schedule times: strings of a service day that may pass 24:00:00, wrap-around, and local clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_DAY, DAY = 43_200, 86_400


def service_seconds(text: Column) -> Column:
    """Seconds of the service day of ``H:MM:SS``; null unless there are three whole numbers."""
    parts = F.split(F.trim(text), ":")
    h, m, s = (F.try_element_at(parts, F.lit(i + 1)).try_cast("int") for i in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def service_text(seconds: Column) -> Column:
    """``HH:MM:SS`` of seconds of the service day, 24 hours and more included."""
    return F.format_string("%02d:%02d:%02d", F.expr("0") + (seconds / 3600).cast("int"), (seconds % 3600 / 60).cast("int"), (seconds % 60).cast("int"))


def service_instant(day: Column, seconds: Column, timezone: str) -> Column:
    """The instant of so many seconds after local midnight."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + seconds), timezone)


def local_seconds_of_day(instant: Column, timezone: str) -> Column:
    local = F.from_utc_timestamp(instant, timezone)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def wrapped(seconds: Column) -> Column:
    """A difference of times of day, brought to within half a day."""
    return F.pmod(seconds + HALF_DAY, F.lit(DAY)) - HALF_DAY


def until_departure(departure: Column, now: Column, route_type: Column) -> Column:
    """Seconds until a terminus departure, for trams and trolleybuses from 2 minutes ago to 30 minutes ahead; not below 0."""
    ahead = wrapped(departure - now)
    return F.when(route_type.isin(0, 11) & ahead.between(-120, 1800), F.greatest(ahead, F.lit(0)))


def instance(departure: Column, now: Column, today: Column) -> Column:
    """The service date of a trip seen now: the day before for one that left before midnight."""
    return F.when(departure - now > HALF_DAY, F.date_sub(today, 1)).otherwise(today)


def day_after(text: Column) -> Column:
    """The date after one given as text; null for a bad one."""
    return F.date_add(text.try_cast("date"), 1)
