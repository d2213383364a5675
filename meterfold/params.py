"""Default parameters. Fixed values that decide the results; each is also a keyword argument."""

HISTORY_SIZE = 100          # accepted readings kept per sensor
MIN_SAMPLES = 5             # below this every reading is accepted
SIGMA_FACTOR = 3.0

MINUTE = 60
ZONE_INTERVAL = 15 * 60     # seconds
ZONE_DELAY = 10 * 60
REGION_INTERVAL = 30 * 60
REGION_DELAY = 20 * 60
FIRST_LOOK_BACK = 24 * 3600

UNHEALTHY_AFTER = 5 * 60
DEREGISTER_AFTER = 6 * 3600
CARD_ALIVE_WITHIN = 5 * 60
TABLE_ALIVE_WITHIN = 10 * 60

OUTBOX_PAGE = 50
OUTBOX_ATTEMPTS = 3
OUTBOX_PURGE_AFTER = 12 * 3600
RAW_RETENTION = 24 * 3600
STATS_RETENTION = 48 * 3600

FRESHNESS = 2 * 3600
RESULT_MIN_AGE = 48 * 3600   # days younger than this have no final variation
TREND_DAYS = 60
TREND_WIDTH = 3
ROW_LIMIT = 50

EARTH_RADIUS_KM = 6371.0
ZERO_DISTANCE_KM = 0.001

SLOPE_EPSILON = 1e-6
DIVERGENCE_LIMIT = 0.2

MISS_PROBABILITY = 0.15

MSG_NEW_PROXIMITY = "new_proximity"
MSG_NEW_EDGE = "new_edge"
MSG_NEW_SENSOR = "new_sensor"
PENDING = "pending"
SENT = "sent"
