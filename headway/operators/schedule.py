"""Calendars, schedule profiles, and schedules laid against the road."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions import clock
from headway.functions.clock import service_seconds
from headway.operators.asof import as_of

#: Services by day that are sent to every task.
MOST_SERVICES = 100_000
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def active_services(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """``day, service_id``: by weekday within the dates, with exceptions of type 1 added and then of type 2 removed.

    ``calendar(service_id, start_date, end_date, monday ... sunday)``, ``exceptions(service_id, day, exception_type)``.
    The calendar meets the days by range; both are dimension tables.
    """
    flags = F.array(*(F.col(d) for d in WEEKDAYS))
    regular = days.join(calendar.withColumn("flags", flags), F.col("day").between(F.col("start_date"), F.col("end_date"))).where(F.element_at("flags", F.weekday("day") + 1) == 1).select("day", "service_id")
    kind = exceptions.join(days, "day")
    added = kind.where("exception_type = 1").select("day", "service_id")
    removed = kind.where("exception_type = 2").select("day", "service_id")
    return regular.unionByName(added).distinct().join(removed, ["day", "service_id"], "left_anti")


def profiles(stop_times: DataFrame) -> DataFrame:
    """``trip_id, stop_id, stop_sequence, dist_m, cum_sec`` of ``stop_times`` with ``arrival_time`` or ``departure_time``.

    Seconds since the trip's first time that parses, never falling; stops without a time go.
    """
    w = Window.partitionBy("trip_id").orderBy("stop_sequence")
    timed = stop_times.withColumn("sec", F.coalesce(service_seconds(F.col("arrival_time")), service_seconds(F.col("departure_time")))).where("sec IS NOT NULL AND dist_m IS NOT NULL")
    since = F.col("sec") - F.first("sec").over(w)
    return timed.withColumn("since", since).select("trip_id", "stop_id", "stop_sequence", "dist_m", F.max("since").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_sec"))


def profile_arrays(profile: DataFrame, x: str, y: str) -> DataFrame:
    """``trip_id, p``: each trip's profile as an array of ``x, y``, of trips with two points at least."""
    return profile.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p")).where(F.size("p") >= 2)


def value_at(at: str) -> str:
    """SQL for the y of the array ``p`` at x = ``at``: linear between its points, the end values beyond."""
    k = f"size(filter(p, q -> q.x <= {at}))"
    return f"""CASE WHEN {k} = 0 THEN p[0].y WHEN {k} = size(p) THEN p[size(p) - 1].y
        ELSE p[{k} - 1].y + ({at} - p[{k} - 1].x) / (p[{k}].x - p[{k} - 1].x) * (p[{k}].y - p[{k} - 1].y) END"""


def _interpolated(rows: DataFrame, profile: DataFrame, at: str, x: str, y: str, out: str) -> DataFrame:
    """Adds ``out``: the profile's y at x = ``at`` of each row's trip, linear between, the end values beyond; null without two points.

    Profiles are arrays by trip, so that rows meet them once and look the place up without an explosion.
    """
    return rows.join(profile_arrays(profile, x, y), "trip_id", "left").withColumn(out, F.expr(value_at(at))).drop("p")


def seconds_at(rows: DataFrame, profile: DataFrame, dist: str = "dist_m") -> DataFrame:
    """Adds ``sched_sec``: the schedule's seconds at a distance along."""
    return _interpolated(rows, profile, dist, "dist_m", "cum_sec", "sched_sec")


def distance_at(rows: DataFrame, profile: DataFrame, seconds: str = "elapsed_sec") -> DataFrame:
    """Adds ``expected_m``: the distance along at the schedule's seconds."""
    return _interpolated(rows, profile, seconds, "cum_sec", "dist_m", "expected_m")


def elapsed(now_sec: Column, first_sec: Column, last_sec: Column) -> Column:
    """Seconds since a trip's first time. A trip that ends after midnight is under way in the small hours: there ``now_sec``
    (of the local day) counts on from 24:00 where it is over half a day before the trip's start."""
    now = F.when((last_sec >= 86_400) & (now_sec < first_sec - 43_200), now_sec + 86_400).otherwise(now_sec)
    return (now - first_sec).cast("double")


def bounds(stop_times: DataFrame) -> DataFrame:
    """``trip_id, first_sec, last_sec`` of the service day; null where the end stops' times don't parse."""
    sec = lambda a, b: F.coalesce(service_seconds(F.col(a)), service_seconds(F.col(b)))
    ends = stop_times.groupBy("trip_id").agg(F.min(F.struct("stop_sequence", sec("departure_time", "arrival_time").alias("s"))).alias("a"), F.max(F.struct("stop_sequence", sec("arrival_time", "departure_time").alias("s"))).alias("b"))
    return ends.select("trip_id", F.col("a.s").alias("first_sec"), F.col("b.s").alias("last_sec"))


def running(trips: DataFrame, now_sec, before: int = 600, after: int = 1800):
    """Whether a trip runs: from 10 minutes before its first departure to 30 after its last arrival; unparseable ones do."""
    return trips.withColumn("running", F.coalesce(F.lit(now_sec).between(F.col("first_sec") - before, F.col("last_sec") + after), F.lit(True)))


def active_trips(services: DataFrame, trips: DataFrame, times: DataFrame, now_sec) -> DataFrame:
    """``day, route_id, trip_id`` of the trips of active ``services(day, service_id)`` that run at that second of the day.

    ``trips(trip_id, route_id, service_id)``, ``times(trip_id, first_sec, last_sec)`` as of :func:`bounds`.
    """
    return services.join(trips, "service_id").join(running(times, now_sec).where("running"), "trip_id").select("day", "route_id", "trip_id")


def trips_at(fixes: DataFrame, trips: DataFrame, services: DataFrame, times: DataFrame, before: int = 600, after: int = 1800, bucket: int = 1800, on: tuple[str, ...] = ("route_id",)) -> DataFrame:
    """Each of ``fixes(route_id, day, now_sec, ..)`` with the trips of its route (of equal columns ``on``) in service that day that run at its second of the day.

    ``trips(trip_id, route_id, service_id, ..)``, ``services(day, service_id)``, ``times(trip_id, first_sec, last_sec)``;
    trips run as of :func:`running`. A trip's running window is dealt into buckets of the day, so that a fix meets those
    of its bucket by equal keys, a few of a route's trips instead of a day's, and the window is checked after. Trips
    without a known window are always candidates and meet a fix by route. The day's services are asked last: a trip a
    row for each of its days would be more than all fixes.
    """
    serving = trips.join(times, "trip_id", "left")
    known = F.col("first_sec").isNotNull() & F.col("last_sec").isNotNull()
    low, high = F.col("first_sec") - before, F.col("last_sec") + after
    dealt = serving.where(known & (low <= high)).withColumn("bucket", F.explode(F.sequence(F.floor(low / bucket), F.floor(high / bucket))))
    timed = fixes.withColumn("bucket", F.floor(F.col("now_sec") / bucket)).join(dealt, [*on, "bucket"]).where(F.col("now_sec").between(low, high)).drop("bucket")
    always = running(fixes.join(serving.where(~known), list(on)), F.col("now_sec"), before, after).where("running").drop("running")
    return in_service(timed.unionByName(always), services)


def in_service(rows: DataFrame, services: DataFrame) -> DataFrame:
    """``rows(day, service_id, ..)`` whose service runs that day, without ``service_id``; services by day go to the rows where they are few."""
    services = services.select("day", "service_id").distinct()
    few = services.limit(MOST_SERVICES + 1).count() <= MOST_SERVICES
    return rows.join(F.broadcast(services) if few else services, ["day", "service_id"], "left_semi").drop("service_id")


def route_index(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """``route_id, trip_id, n_stops, first_stop_id, last_stop_id``: the trips of each route that have stop times.

    Rows, not an array a route, so that a route with a third of all trips stays spread; stops of equal sequence are in the order of their ids.
    """
    at = F.struct("stop_sequence", "stop_id")
    ends = stop_times.where("trip_id IS NOT NULL").groupBy("trip_id").agg(F.count("*").alias("n_stops"), F.min(at)["stop_id"].alias("first_stop_id"), F.max(at)["stop_id"].alias("last_stop_id"))
    return trips.select("route_id", "trip_id").join(ends, "trip_id").select("route_id", "trip_id", "n_stops", "first_stop_id", "last_stop_id")


def stop_times_of(stop_times: DataFrame, trip_ids: list[str]) -> DataFrame:
    """Stops of the trips in their order; a filter on the trip reaches the scan."""
    return stop_times.where(F.col("trip_id").isin(*trip_ids)).orderBy("trip_id", "stop_sequence")


def vehicle_kind(routes: DataFrame) -> DataFrame:
    """``route_id, route_type``: trolleybuses are told by their short name, whatever type is given; types that aren't numbers go."""
    kind = F.when(F.trim("route_short_name").startswith("\u0422\u0440"), F.lit(11)).otherwise(F.trim("route_type").try_cast("int"))
    return routes.select("route_id", kind.alias("route_type")).where("route_type IS NOT NULL")


def instances(stop_times: DataFrame, trips: DataFrame, timezone: str) -> DataFrame:
    """``trip_id, stop_sequence, start_date, start_time, scheduled``: when the trips seen now are due at each stop.

    ``stop_times(trip_id, stop_sequence, sec)`` in seconds of the service day, ``trips(trip_id, now_sec, today)``.
    """
    first = stop_times.groupBy("trip_id").agg(F.min_by("sec", "stop_sequence").alias("departs"))
    seen = trips.join(first, "trip_id").select("trip_id", clock.instance(F.col("departs"), F.col("now_sec"), F.col("today")).alias("start_date"), clock.service_text(F.col("departs")).alias("start_time"))
    return stop_times.join(seen, "trip_id").select("trip_id", "stop_sequence", "start_date", "start_time", clock.service_instant(F.col("start_date"), F.col("sec"), timezone).alias("scheduled"))


def latest_version(versions: DataFrame, days: DataFrame, current: str | None = None) -> DataFrame:
    """``day, version``: the latest version of a schedule on or before each day; before the first ``current``, the schedule
    in force, which is null if not given. Two versions of one day: the greater."""
    found = as_of(days.select("day"), versions.select("day", "version"), F.unix_date("day"), F.unix_date("day"), ["version"], block=64)
    return found.select("day", F.coalesce("version", F.lit(current)).alias("version"))


def baseline_eta(vehicles: DataFrame, stops: DataFrame, now: str = "t") -> DataFrame:
    """The schedule with the delay at the last stop passed: ``..., stop_sequence, scheduled, estimated, delay_sec``.

    ``vehicles(vehicle_id, trip_id, dist_m, t)``, ``stops(trip_id, stop_sequence, stop_dist_m, scheduled)``. The last
    passed stop is that of the highest sequence at or behind the vehicle; without one, or without its time, the delay is 0.
    """
    nested = stops.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct(F.col("stop_sequence").alias("seq"), F.col("stop_dist_m").alias("d"), "scheduled"))).alias("s"))
    met = vehicles.join(nested, "trip_id").withColumn("passed", F.expr("filter(s, x -> x.d <= dist_m)"))
    delay = F.coalesce(F.col(now) - F.try_element_at("passed", F.lit(-1)).getField("scheduled"), F.lit(0.0))
    ahead = met.withColumn("delay_sec", delay).select(*vehicles.columns, "delay_sec", F.explode(F.expr("filter(s, x -> x.d > dist_m)")).alias("x"))
    return ahead.select(*vehicles.columns, F.col("x.seq").alias("stop_sequence"), F.col("x.scheduled").alias("scheduled"), (F.col("x.scheduled") + F.col("delay_sec")).alias("estimated"), "delay_sec")
