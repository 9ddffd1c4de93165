"""Fixed values that must equal the reference behaviour for the same results.

Fixed values (kept verbatim, in natural order):
"""

# pandas' default NA tokens plus the extra Spanish/LatAm sentinels.
PANDAS_DEFAULT_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
EXTRA_NA = (
    "?", "-", "--", ".", "..", "none", "None", "NONE",
    "n/a", "N/A", "#N/A", "na", "n.a.", "n. a.",
    "n/d", "n.d.", "s/d", "s.d.", "sin dato", "Sin dato", "SIN DATO",
    "sin datos", "no aplica", "No aplica", "NO APLICA",
    "missing", "Missing", "MISSING", "(blank)", "(vacío)", "vacío", "nulo", "Nulo",
)
NA_TOKENS = tuple(sorted(set(PANDAS_DEFAULT_NA) | set(EXTRA_NA)))

# CSV encodings tried in order.
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")

# Patterns of the numeric salvage, in the order they are applied.
MONEY_SEPARATORS = r"[,\s]"
MONEY_SIGN = r"^[$€£]\s?"
PERCENT = "%"

# Numeric salvage.
NUMERIC_SHARE_THRESHOLD = 0.9
NUMERIC_MIN_DISTINCT = 2  # strictly more than this many distinct raw values (tested as: a value besides min and max)

# Column rules.
ID_NAME_REGEX = r"^(id|uuid|.*_id|.*_uuid|.*id\d*)$"
FREE_TEXT_MEAN_LEN = 50
FREE_TEXT_UNIQUE_RATIO = 0.5
FREE_TEXT_MEDIUM_LEN = 15
HIGH_MISSING_SHARE = 0.7
NEAR_ZERO_CV = 0.01
MIN_ROWS_FOR_VARIANCE = 4
MAX_CATEGORICAL_CARDINALITY = 25
DATE_MIN_VALUES = 3
DATE_SHARE = 0.95  # of a text column's values that its one date format must parse

# Preparation.
IMPUTATION_NAMES = {"mode": "most_frequent", "most_frequent": "most_frequent", "mean": "mean", "median": "median"}
MAX_ONEHOT_LEVELS = 12
INFREQUENT_SUFFIX = "infrequent_sklearn"

# Clustering.
RANDOM_SEED = 42
KMEANS_N_INIT = 10
REFINE_N_INIT = 30
K_MIN = 2
K_MAX = 10
FLAT_CURVE_SPREAD = 0.03
FLAT_MAX_K = 4
REFINE_THRESHOLD = 0.25
MAX_REFINEMENT_ITERATIONS = 2

# Quality and caution ladders.
CAUTION_LEVELS = ("baja", "media", "alta")
GRADE_LADDER = ((0.5, "A", "Excelente"), (0.3, "B", "Buena"), (0.15, "C", "Aceptable"))
GRADE_FLOOR = ("D", "Baja")
GRADE_MISSING = ("—", "Sin calcular")
CAUTION_SILHOUETTE = ((0.25, "alta"), (0.5, "media"))
CAUTION_GROUP_SIZE = ((30, "alta"), (100, "media"))

# Evidence and group statistics.
EVIDENCE_MAX_NUMERIC = 5
EVIDENCE_MAX_CATEGORICAL = 4
EVIDENCE_MIN_GAP = 0.05
EVIDENCE_TOP_LEVELS = 6
GROUP_MAX_NUMERIC = 10
GROUP_MAX_CATEGORICAL = 8
GROUP_TOP_LEVELS = 3
COMPARE_DEFAULT_NUMERIC = 6

# Summaries and charts.
SUMMARY_MAX_COLUMNS = 30
SUMMARY_SAMPLES = 3
SUMMARY_TOP_VALUES = 5
PROFILE_TOP_CATEGORIES = 10
AUTO_BAR_MIN_ROWS = 2
AUTO_BAR_MAX_ROWS = 24
COMPARATIVE_OPS = ("value_counts", "groupby_count", "groupby_agg", "top_n")
HIST_MIN_BINS = 5
HIST_MAX_BINS = 12
RADAR_MAX_AXES = 8
PREVIEW_ROWS = 5
UNKNOWN_SEGMENT = "Desconocido"
LIST_JOINER = " | "
RUN_ID_REGEX = r"^[0-9a-f]{12}$"
