"""Fixed values that must equal the original pipeline's for identical results.

Everything here is data, not logic: names, boxes, thresholds, unit factors and
preference orders, stated plainly in their natural order.
"""

# --- fixed values: station observation variables (15-minute series) ---
STATION_VARIABLES = [
    "airTemperature", "apparentAirTemperature", "dewPoint", "wetBulb", "deltaT",
    "relativeHumidity", "panEvaporation", "evapotranspiration_shortCrop",
    "evapotranspiration_tallCrop", "richardsonUnits", "frostCondition",
    "heatCondition", "solarExposure", "rainfall",
    "wind_3m_speed", "wind_3m_degN", "wind_10m_speed", "wind_10m_degN",
]

# --- fixed values: bounding boxes (lat_min, lat_max, lon_min, lon_max) ---
WA_STATION_BOX = (-35.0, -13.0, 115.0, 129.0)
WA_GRID_BOX = (-36.0, -10.0, 110.0, 135.0)
GRID_BUILD_BOX = (-36.0, -12.556618, 111.5, 129.144934)

# --- fixed values: coordinates that are dropped when present ---
FORECAST_DROP_COORDS = ["expver", "surface", "depthBelowLandLayer"]
REFINE_DROP_COORDS = ["expver", "number"]

# --- fixed values: unit conversion groups ---
# reanalysis: exact names only
REANALYSIS_UNIT_GROUPS = {
    "temp": ["t2m", "d2m"],           # K -> degC
    "pressure": ["sp", "msl"],        # Pa -> hPa
    "wind": ["u10", "v10"],           # m/s -> km/h
    "precip": ["tp", "cp", "lsp"],    # m -> mm
}
# forecast: exact name or name followed by digits (t -> t250, t500, ...)
FORECAST_UNIT_GROUPS = {
    "temp": ["t2m", "d2m", "t"],
    "pressure": ["msl", "sp"],
    "wind": ["u10", "v10", "i10fg", "u", "v"],
    "precip": ["tp", "cp", "lsp"],
}
# group -> (operation, constant, new unit)
UNIT_RULES = {
    "temp": ("sub", 273.15, "degC"),
    "pressure": ("div", 100.0, "hPa"),
    "wind": ("mul", 3.6, "km/h"),
    "precip": ("mul", 1000.0, "mm"),
}

# --- fixed values: pressure levels ---
NEAREST_TARGET_LEVELS = [1000, 850, 500]
FORECAST_LEVELS = [250, 500, 850, 1000]

# --- fixed values: 1-hour -> 15-minute interpolation groups ---
PCHIP_VARS = ["t2m", "d2m", "sp", "msl", "q500", "q850", "q1000", "r500", "r850", "r1000"]
LINEAR_VARS = ["u10", "v10"]
PRECIP_VARS = ["tp", "cp", "lsp"]

# --- fixed values: anomaly detector ---
DT_HOURS = 0.25
ROLLING_WINDOW = 5
MEDIAN_Z = 3.0
SLOPE_Z = 4.0
MIN_SLOPE = 0.2
SOLAR_Z = 2.5
SOLAR_WINDOW = 4
# diurnal zones on hour + minute/60: [start, end) -> expected sign
RISING_HOURS = (6.0, 12.0)
FALLING_HOURS = (16.0, 21.0)

# --- fixed values: spatial ---
HULL_EXCLUDE_STATIONS = ["Broome (Skuthorpe)", "Kununurra"]
GRID_SIZE_KM = 11.0
KM_PER_DEGREE = 111.132
FILL_RADIUS_M = 10000.0
FILL_PACKING_SCALE = 0.5
FILL_MIN_SEPARATION = 1.8      # times the radius
IDW_POWER = 2.0
IDW_EPS = 1e-6

# Albers equal-area conic for Australia (GDA94 / Australian Albers):
# GRS80 ellipsoid, origin lat 0, central meridian 132, standard parallels -18, -36.
ALBERS = {
    "a": 6378137.0,
    "inv_f": 298.257222101,
    "lat0": 0.0,
    "lon0": 132.0,
    "lat1": -18.0,
    "lat2": -36.0,
    "false_easting": 0.0,
    "false_northing": 0.0,
}

# --- fixed values: display ---
DEFAULT_VAR_PREFERENCE = ["t2m", "airTemperature", "t", "temperature"]
CLOUD_VARS = ["tcc", "lcc", "mcc", "hcc"]
QUANT_STEPS = 12
CONTOUR_LEVELS = 21
COMPATIBLE_VARS = [("t2m", "airTemperature"), ("d2m", "dewPoint")]
DEFAULT_SHIFT_HOURS = 16
SOURCE_TZ = "UTC"
STATION_TZ = "Australia/Perth"
STRIDE_MIN, STRIDE_MAX = 1, 8
AUTO_STRIDE_DIVISOR = 30
RUN_FILE_SPAN_DAYS = 7

# --- fixed values: variables kept by the forecast clean job, in this order ---
FORECAST_VARS = [
    "t2m", "d2m", "msl", "tcc", "lcc", "i10fg", "u10", "v10", "cp", "lsp", "tp", "swvl1", "sh2",
    "t250", "t500", "t850", "t1000",
    "z250", "z500", "z850", "z1000",
    "q250", "q500", "q850", "q1000",
    "w250", "w500", "w850", "w1000",
    "u250", "u500", "u850", "u1000",
    "v250", "v500", "v850", "v1000",
]
# --- fixed values: variables kept by the reanalysis clean job, in this order ---
REANALYSIS_VARS = [
    "t2m", "d2m", "sp", "msl", "tcc", "lcc", "mcc", "hcc", "u10", "v10", "tp", "cp", "lsp",
    "w500", "w850", "w1000", "q500", "q850", "q1000", "r500", "r850", "r1000",
]
