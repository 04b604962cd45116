"""Names, windows, thresholds and name patterns the engine's results depend on."""

# Column roles of the daily panel.
KEY = "basin_id"
TIME = "date"
TARGET = "discharge_mm"
PRECIP = "prcp_mm_cr2met"
TMIN = "tmin_c"
TMAX = "tmax_c"
TMEAN = "tmean_c"
PET = "pet_mm_hargreaves"
SWE = "swe_mm"
FORCINGS = [PRECIP, TMIN, TMAX, PET]
NON_NEGATIVE = [PRECIP, PET, SWE]
TARGET_PRIORITY = ["y_log1p", "y", "discharge_mm"]
RESERVED = ["basin_id", "date", "y", "y_log1p", "discharge_mm"]
CANDIDATES = [PRECIP, TMIN, TMAX, TMEAN, PET, SWE]
ENCODED = "basin_te"

# Lags and leak-free windows, in rows.
LAGS = {
    PRECIP: [1, 2, 3, 7, 14, 30],
    TMIN: [1, 3, 7],
    TMAX: [1, 3, 7],
    TMEAN: [1, 3, 7],
    PET: [1, 3, 7, 14],
    SWE: [1, 3, 7],
    TARGET: [1, 3, 7],
}
PRECIP_SUMS = [3, 7, 14, 30]
PRECIP_MEANS = [7, 30]
DEFICIT_SUMS = [3, 7, 14]
DEGREE_DAY_BASES = [0, 5]
DEGREE_DAY_SUMS = [3, 7]

# Missing-cell marks of the wide files.
NA_MARKS = ["-9999", "-9999.0", "NaN", "NA", "", " "]

# Names of the core features (matched from the start of the name).
CORE_PATTERNS = [
    r"^prcp_mm_cr2met(_lag(1|2|3|7|14|30)|_sum_(3|7|14|30)d|_mean_(7|30)d)$",
    r"^pet_mm_hargreaves(_lag(1|3|7|14))$",
    r"^deficit(_sum_(3|7|14)d)?$",
    r"^tmean_c(_lag(1|3|7))$",
    r"^tmin_c(_lag(1|3|7))$",
    r"^tmax_c(_lag(1|3|7))$",
    r"^dd_above(0|5)(_sum_(3|7)d)?$",
    r"^swe_mm(_lag(1|3|7))$",
    r"^(elev|area|slope|lat|lon|aridity|glacier|forest|soil|geol).*",
]

# Names of the features whose missing values become zero (found anywhere in the name).
ZERO_PATTERNS = [
    r"_lag\d+$",
    r"_sum_\d+d$",
    r"_mean_\d+d$",
    r"^dd_above(0|5)(?:_sum_(3|7)d)?$",
    r"^deficit(?:_sum_(3|7|14)d)?$",
    r"^swe_mm(_lag(1|3|7))?$",
]

# Split, gates, caps, smoothing.
SPLIT_DATE = "2009-01-01"
MIN_ROWS = 900
MIN_FEATURES = 3
SMOOTHING = 100.0
CAP_TRAIN = 1500
CAP_TEST = 500
MAX_TRAIN = 600_000
MAX_TEST = 200_000
SAMPLE_PER_SERIES = 60
SAMPLE_TOTAL = 10_000
SEED = 42

# Diagnosis and policy thresholds.
MIN_VALID_PAIRS = 6
NEAR_ZERO_STD = 1e-3
NEAR_ZERO_RATIO = 0.01
NEAR_ZERO_EPS = 1e-6
TOP_MISSING = 15
HIGH_MISSING = 0.30
ADVISE_RATE = 0.40
EXCLUDE_RATE = 0.80
N_BOTTOM = 20
TOP_K = 60

# Boosting settings.
BOOSTING = {"rounds": 600, "rate": 0.05, "depth": 7, "subsample": 0.8, "columns": 0.8, "l2": 1.0}
BASELINE_ROUNDS = 700
