"""Thresholds of the domain; every operator takes them as keyword arguments with these defaults."""

# Results depend on them.
SPEED_UNKNOWN = -1.0
SPEED_MIN_GAP_SEC, SPEED_MAX_GAP_SEC, SPEED_MAX_BACKWARD_M = 3.0, 120.0, 30.0
MOVE_EPS_M = 25.0
MAX_HORIZON_SEC, MAX_STOPS_AHEAD = 3600.0, 10
MAX_VEHICLE_SPEED_MPS = 40.0
OFF_ROUTE_DIST_M, ON_ROUTE_DIST_M, OFF_ROUTE_CONSEC, ON_ROUTE_CONSEC = 150.0, 100.0, 3, 3
BEARING_WRONG_DEG, BEARING_MIN_DIST_M = 90.0, 50.0
MAX_DIST_M, HYSTERESIS_DIST_M = 100.0, 150.0
SPATIAL_WEIGHT, BEARING_WEIGHT, PROGRESS_WEIGHT = 0.4, 0.3, 0.3
FAST_PATH_DIST_M, TRUST_DIST_M, TRUST_BEARING_DEG = 50.0, 75.0, 90.0
DWELL_MOVE_M, DWELL_MAX_SEC, DWELL_STOP_RADIUS_M, DWELL_MIN_EVENTS = 8.0, 180.0, 40.0, 500
FALLBACK_SPEED_MPS, FALLBACK_SEC_PER_STOP = 5.0, 40.0
MAX_ABS_ERROR_SEC, SCHEDULE_WINDOW_SEC = 3600, 7200
LEAD_EDGES_SEC = (120, 300, 600, 1200)
LEAD_LABELS = ("0-2m", "2-5m", "5-10m", "10-20m", "20m+")
ARRIVING_NOW_SEC = 60
STALE_FIX_SEC, STALE_SLIDE_SEC = 180, 1800
HOLIDAYS_MMDD = (101, 107, 308, 501, 509, 628, 824, 1014, 1225)
EXCLUDED_ROUTES = ("2299", "138")
TRAM, BUS, TROLLEYBUS = 0, 3, 11
DEFAULT_DWELL_SEC = 15
