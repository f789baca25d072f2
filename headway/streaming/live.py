"""The live pass as Structured Streaming: each vehicle's state, and what a whole feed decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from headway import constants as K
from headway.streaming.state import MAX_STILL_AGE_SEC

STATE = "trip_id string, t double, dist_m double, speed double, still_t double, still_dist_m double"
OUTPUT = "vehicle_id string, trip_id string, seq long, t double, dist_m double, progress_speed_mps double, stationary_sec double"


def advance(state: tuple | None, trip_id: str, t: float, dist: float) -> tuple[tuple, float, float]:
    """The next state, the speed, and the seconds at rest of a vehicle. A new trip starts anew; a fix under three
    seconds after the last keeps its place and speed. State that was carried over may lack its place or its rest."""
    if state is None or state[0] != trip_id:
        return (trip_id, t, dist, K.SPEED_UNKNOWN, t, dist), K.SPEED_UNKNOWN, 0.0
    _, t0, d0, speed, still_t, still_d = state
    if still_t is None or dist - still_d > K.MOVE_EPS_M:
        still_t, still_d = t, dist
    if t0 is None:
        return (trip_id, t, dist, K.SPEED_UNKNOWN, still_t, still_d), K.SPEED_UNKNOWN, t - still_t
    dt = t - t0
    if dt < K.SPEED_MIN_GAP_SEC:
        return (trip_id, t0, d0, speed, still_t, still_d), speed, t - still_t
    speed = max(0.0, dist - d0) / dt if dt <= K.SPEED_MAX_GAP_SEC and dist - d0 >= -K.SPEED_MAX_BACKWARD_M else K.SPEED_UNKNOWN
    return (trip_id, t, dist, speed, still_t, still_d), speed, t - still_t


def tracked(fixes: DataFrame, forget_after_ms: int = 6 * 3600 * 1000, initial: DataFrame | None = None) -> DataFrame:
    """Speed and time at rest for a stream of ``vehicle_id, trip_id, seq, t, dist_m``, by state for each vehicle.

    State goes when a vehicle hasn't been seen for ``forget_after_ms``; a micro-batch holds a few fixes of each. A
    vehicle without state starts from its row of ``initial(vehicle_id, trip_id, t, dist_m, speed, still_t,
    still_dist_m)``, such as :func:`state.saved_state` of another stream; its rest counts unless it is older than
    MAX_STILL_AGE_SEC by the fix that asks for it. Each micro-batch is joined to that table, one row a vehicle.
    """
    names = [c.split()[0] for c in STATE.split(", ")]
    carries = initial is not None
    if carries:
        fixes = fixes.join(initial.select("vehicle_id", *(F.col(c).alias(f"was_{c}") for c in names)), "vehicle_id", "left")

    def step(key: tuple, pdfs: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["t", "seq"])
        if now is None and carries:
            was = [None if pd.isna(x) else x for x in rows.iloc[0][[f"was_{c}" for c in names]]]
            if was[4] is not None and rows.iloc[0]["t"] - was[4] > MAX_STILL_AGE_SEC:
                was[4:] = None, None
            now = tuple(was) if was[0] is not None else None
        out = []
        for r in rows.itertuples():
            now, speed, still = advance(now, r.trip_id, r.t, r.dist_m)
            out.append((key[0], r.trip_id, r.seq, r.t, r.dist_m, speed, still))
        state.update(now)
        state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return fixes.groupBy("vehicle_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


OFF_STATE = "trip_id string, off boolean, n int, d1 double, d2 double"
OFF_OUTPUT = "vehicle_id string, trip_id string, seq long, t double, off_route boolean"


def advance_status(state: tuple | None, trip_id: str, off_m: float, bearing_diff: float | None) -> tuple:
    """The next off-route state of a vehicle; a new trip starts on route."""
    _, off, n, d1, d2 = state if state is not None and state[0] == trip_id else (trip_id, False, 0, None, None)
    away = d1 is not None and d2 is not None and off_m > d1 > d2 and off_m > K.ON_ROUTE_DIST_M
    heading = bearing_diff is not None and bearing_diff > K.BEARING_WRONG_DEG and off_m > K.BEARING_MIN_DIST_M
    signal = off_m <= K.ON_ROUTE_DIST_M if off else off_m > K.OFF_ROUTE_DIST_M or heading or away
    n = n + 1 if signal else 0
    if n >= (K.ON_ROUTE_CONSEC if off else K.OFF_ROUTE_CONSEC):
        off, n = not off, 0
    return trip_id, off, n, off_m, d1


def off_route(fixes: DataFrame, forget_after_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """The off-route status for a stream of ``vehicle_id, trip_id, seq, t, off_m, bearing_diff``, by state for each vehicle."""

    def step(key: tuple, pdfs: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["t", "seq"])
        out = []
        for r in rows.itertuples():
            now = advance_status(now, r.trip_id, r.off_m, None if pd.isna(r.bearing_diff) else r.bearing_diff)
            out.append((key[0], r.trip_id, r.seq, r.t, now[1]))
        state.update(now)
        state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OFF_OUTPUT.split(", ")])

    return fixes.groupBy("vehicle_id").applyInPandasWithState(step, OFF_OUTPUT, OFF_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def once_each(fixes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drops fixes that a feed serves again, within the watermark on ``ts``."""
    return fixes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["vehicle_id", "ts"])


def serve(fixes: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Starts a query that hands every micro-batch to ``publish``; what a whole feed decides (staleness, collapse) is
    computed there, as state by vehicle can't see it. A batch that is repeated after a failure has the same number."""
    return fixes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def archive(feeds: DataFrame, every_sec: int = 300) -> DataFrame:
    """One feed for each five minutes, the first, keyed by its time."""
    slot = F.floor(F.col("feed_ts") / every_sec)
    return feeds.groupBy(slot.alias("slot")).agg(F.min(F.struct("feed_ts", "content")).alias("f")).select("f.*")
