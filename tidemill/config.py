"""Constants that are part of the semantics."""

# The defaults of the forecasting task.
HORIZON = 24
MAX_GAP_HOURS = 12
MIN_VALID_LEVEL = 0.0
TEST_FRACTION = 0.20
MIN_RANGE_OVERLAP = 0.90
FOLDS = 5
INITIAL_FRACTION = 0.50
EMBARGO = 24
ALARM_LEVEL = 545.0
LAGS = (1, 3, 6, 12, 24, 48, 72)
WINDOWS = (6, 24, 72)
CHANGES = (1, 3, 6, 12, 24)
LOOKBACK = 72
TARGET = "click"  # the station that forecasts are for, in the test tables
CHUNK_HOURS = 192
