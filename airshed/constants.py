"""Fixed domain values.

Everything in this module is a FIXED VALUE that has to equal the published
domain tables for results to match (sentinels, plausibility ranges, unit
factors, EPA breakpoints, AQI categories, advice texts, sensor parameter
ids).  They are stated plainly, in natural order, and consumed by the column
builders in ``airshed.functions`` and the operators.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: canonical column names
# --------------------------------------------------------------------------
POLLUTANTS = ["pm25", "pm10", "o3", "no2", "so2", "co"]

WEATHER_COLS = [
    "temp_avg_c",
    "temp_max_c",
    "temp_min_c",
    "dewpoint_c",
    "precip_mm",
    "wind_speed_kmh",
    "visibility_km",
    "station_pressure_hpa",
]

CALENDAR_COLS = ["day_sin", "day_cos", "month_sin", "month_cos", "day_of_week", "is_weekend", "season"]

TARGET_LAGS = [1, 2, 3, 7]
WEATHER_LAG_COLS = ["temp_avg_c", "wind_speed_kmh", "visibility_km"]
ROLL_MEAN_WINDOWS = [7, 14, 30]
ROLL_STD_WINDOWS = [7, 14]

# --------------------------------------------------------------------------
# FIXED VALUES: GSOD missing-value sentinels (exact per-column values)
# --------------------------------------------------------------------------
GSOD_SENTINELS = {
    "TEMP": 9999.9,
    "DEWP": 9999.9,
    "SLP": 9999.9,
    "STP": 999.9,
    "VISIB": 999.9,
    "WDSP": 999.9,
    "MXSPD": 999.9,
    "GUST": 999.9,
    "MAX": 9999.9,
    "MIN": 9999.9,
    "PRCP": 99.99,
    "SNDP": 999.9,
}

# --------------------------------------------------------------------------
# FIXED VALUES: plausibility ranges (closed bounds; outside -> flag + NULL)
# --------------------------------------------------------------------------
WEATHER_RANGES = {
    "temp_avg_c": (-60.0, 60.0),
    "temp_max_c": (-60.0, 60.0),
    "temp_min_c": (-60.0, 60.0),
    "precip_mm": (0.0, 2000.0),
    "wind_speed_kmh": (0.0, 300.0),
    "visibility_km": (0.0, 100.0),
    "station_pressure_hpa": (870.0, 1085.0),
}

POLLUTANT_RANGES = {
    "pm25": (0.0, 1000.0),
    "pm10": (0.0, 2000.0),
    "o3": (0.0, 0.5),
    "no2": (0.0, 2.0),
    "so2": (0.0, 1.0),
    "co": (0.0, 50.0),
}
DEFAULT_POLLUTANT_RANGE = (0.0, 10000.0)

# Feature-stage clipping (lower, upper)
CLIP_RANGES = {
    "temp_avg_c": (-30.0, 45.0),
    "temp_max_c": (-25.0, 50.0),
    "temp_min_c": (-35.0, 40.0),
}
TARGET_CLIP = (0.0, 500.0)

# --------------------------------------------------------------------------
# FIXED VALUES: units
# --------------------------------------------------------------------------
POLLUTANT_UNITS = {
    "pm25": "µg/m³",
    "pm10": "µg/m³",
    "o3": "ppm",
    "no2": "ppm",
    "so2": "ppm",
    "co": "ppm",
}

# (from_unit, to_unit, multiplier); anything else is left unchanged
UNIT_FACTORS = [
    ("mg/m³", "µg/m³", 1000.0),
    ("g/m³", "µg/m³", 1000000.0),
    ("ppb", "ppm", 0.001),
    ("ppt", "ppm", 0.000001),
]

F_TO_C_OFFSET = 32.0
INCH_TO_MM = 25.4
KNOT_TO_KMH = 1.852
MILE_TO_KM = 1.60934
EARTH_RADIUS_KM = 6371.0

# --------------------------------------------------------------------------
# FIXED VALUES: sensor parameter ids
# --------------------------------------------------------------------------
PARAMETER_IDS = {"pm10": 1, "pm25": 2, "no2": 7, "co": 8, "so2": 9, "o3": 10}

# --------------------------------------------------------------------------
# FIXED VALUES: PM2.5 bands in force since 2024, and the 1-hour ozone bands
# --------------------------------------------------------------------------
PM25_BREAKPOINTS_2024 = [
    (0.0, 9.0, 0, 50),
    (9.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 125.4, 151, 200),
    (125.5, 225.4, 201, 300),
    (225.5, 325.4, 301, 500),
]
OZONE_1H_BREAKPOINTS = [
    (0.125, 0.164, 101, 150),
    (0.165, 0.204, 151, 200),
    (0.205, 0.404, 201, 300),
    (0.405, 0.604, 301, 500),
]

# --------------------------------------------------------------------------
# FIXED VALUES: EPA 24-hour AQI breakpoints (c_low, c_high, i_low, i_high)
# --------------------------------------------------------------------------
AQI_BREAKPOINTS = {
    "pm25": [
        (0.0, 12.0, 0, 50),
        (12.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 150.4, 151, 200),
        (150.5, 250.4, 201, 300),
        (250.5, 500.4, 301, 500),
    ],
    "pm10": [
        (0.0, 54.0, 0, 50),
        (55.0, 154.0, 51, 100),
        (155.0, 254.0, 101, 150),
        (255.0, 354.0, 151, 200),
        (355.0, 424.0, 201, 300),
        (425.0, 604.0, 301, 500),
    ],
    "o3": [
        (0.000, 0.054, 0, 50),
        (0.055, 0.070, 51, 100),
        (0.071, 0.085, 101, 150),
        (0.086, 0.105, 151, 200),
        (0.106, 0.200, 201, 300),
    ],
    "no2": [
        (0.000, 0.053, 0, 50),
        (0.054, 0.100, 51, 100),
        (0.101, 0.360, 101, 150),
        (0.361, 0.649, 151, 200),
        (0.650, 1.249, 201, 300),
    ],
    "so2": [
        (0.000, 0.035, 0, 50),
        (0.036, 0.075, 51, 100),
        (0.076, 0.185, 101, 150),
        (0.186, 0.304, 151, 200),
        (0.305, 0.604, 201, 300),
    ],
    "co": [
        (0.0, 4.4, 0, 50),
        (4.5, 9.4, 51, 100),
        (9.5, 12.4, 101, 150),
        (12.5, 15.4, 151, 200),
        (15.5, 30.4, 201, 300),
        (30.5, 50.4, 301, 500),
    ],
}
AQI_CAP = 500

# EPA truncation before the lookup (decimal places of the reported value)
AQI_TRUNCATION_DIGITS = {"o3": 3, "pm25": 1, "co": 1, "pm10": 0, "so2": 3, "no2": 3}

# --------------------------------------------------------------------------
# FIXED VALUES: AQI categories (aqi_low, aqi_high, label, color, chinese, description)
# --------------------------------------------------------------------------
AQI_CATEGORIES = [
    (0, 50, "Good", "#00E400", "优", "空气质量令人满意，基本无空气污染"),
    (51, 100, "Moderate", "#FFFF00", "良", "空气质量可接受，某些污染物可能对极少数敏感人群有轻微影响"),
    (101, 150, "Unhealthy for Sensitive Groups", "#FF7E00", "轻度污染", "敏感人群症状轻度加剧，健康人群出现刺激症状"),
    (151, 200, "Unhealthy", "#FF0000", "中度污染", "进一步加剧易感人群症状，可能对健康人群心脏、呼吸系统有影响"),
    (201, 300, "Very Unhealthy", "#8F3F97", "重度污染", "心脏病和肺病患者症状显著加剧，运动耐受力降低，健康人群普遍出现症状"),
    (301, 500, "Hazardous", "#7E0023", "严重污染", "健康人群运动耐受力降低，有明显强烈症状，提前出现某些疾病"),
]
OUT_OF_RANGE_CATEGORY = "Hazardous"
UNKNOWN_CATEGORY = "Unknown"

# --------------------------------------------------------------------------
# FIXED VALUES: health advice per category (label, message, health_effects,
# recommendation, color, icon); unknown labels fall back to "Good"
# --------------------------------------------------------------------------
HEALTH_ADVICE = [
    ("Good", "空气质量优良，适合所有户外活动", "无", "正常活动", "#00e400", "😊"),
    ("Moderate", "空气质量一般，敏感人群需注意", "敏感人群可能有轻微不适", "敏感人群减少长时间户外活动", "#ffff00", "😐"),
    ("Unhealthy for Sensitive Groups", "对敏感人群不健康", "敏感人群可能出现呼吸问题", "敏感人群减少户外活动，佩戴口罩", "#ff7e00", "😷"),
    ("Unhealthy", "空气质量不健康", "所有人可能出现健康问题", "减少户外活动，佩戴口罩", "#ff0000", "😟"),
    ("Very Unhealthy", "空气质量非常不健康", "健康人群也可能出现不良症状", "避免户外活动，关闭门窗", "#8f3f97", "😫"),
    ("Hazardous", "空气质量危险", "严重健康风险", "留在室内，使用空气净化器", "#7e0023", "☠️"),
]
ADVICE_HEADINGS = ("健康影响: ", "建议: ")

# Short advice line per category (second advice map)
SHORT_ADVICE = [
    ("Good", "空气质量良好，适合户外活动"),
    ("Moderate", "空气质量一般，敏感人群减少户外活动"),
    ("Unhealthy for Sensitive Groups", "敏感人群应避免户外活动"),
    ("Unhealthy", "所有人应减少户外活动"),
    ("Very Unhealthy", "避免户外活动，关闭门窗"),
    ("Hazardous", "紧急健康警告，留在室内"),
]

# --------------------------------------------------------------------------
# FIXED VALUES: inverse-distance weighting
# --------------------------------------------------------------------------
IDW_MIN_KM = 0.1          # weather: w = 1 / max(km, 0.1)
IDW_DEFAULT_KM = 1.0      # weather: unknown distance
IDW_MIN_M = 100.0         # air: w = 1 / max(m, 100)
IDW_DEFAULT_M = 1000.0    # air: unknown distance

# Station selection
STATION_RADIUS_KM = 100.0
COVERAGE_MIN = 0.3
COVERAGE_COLS = ["temp_avg_c", "precip_mm"]
INTERPOLATE_LIMIT = 3

# Baseline heuristic forecast (intercept, temp slope, temp ref, wind ref, wind slope, precip cap, precip slope)
BASELINE_PM25 = (30.0, 0.3, 20.0, 15.0, 0.5, 10.0, 0.8)

# Pollution levels for the share report (µg/m³)
POLLUTION_LEVELS = [(35.0, "high"), (15.0, "medium"), (10.0, "low")]  # else "clean"
HIGH_POLLUTION = 35.0

# Visibility bins (km) for the median report
VISIBILITY_BINS = [5.0, 10.0, 15.0, 20.0]

# Chronological split
TEST_SIZE = 0.15
VAL_SIZE = 0.15
CV_SPLITS = 5

# Modes: {Global,City} x {Today,Hist} x {Multi,Separate}
MODES = [
    ("GTM", "global", "today", "multi"),
    ("GTS", "global", "today", "separate"),
    ("GHM", "global", "hist", "multi"),
    ("GHS", "global", "hist", "separate"),
    ("CTM", "city", "today", "multi"),
    ("CTS", "city", "today", "separate"),
    ("CHM", "city", "hist", "multi"),
    ("CHS", "city", "hist", "separate"),
]
MULTI_TARGETS = ["pm25", "o3"]
