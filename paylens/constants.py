"""Fixed values that must equal the reference application's for equal results.

FIXED VALUES — domain lists, calibration priors, cut-offs, patterns and
keyword lists, stated as plain text in their natural order.  Nothing here is
logic; the operators that use them live in ``functions/`` and ``operators/``.
"""

from datetime import date

# ---- FIXED VALUES: domains --------------------------------------------------
STATES = ["NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT"]
STATE_WEIGHTS = [0.33, 0.26, 0.18, 0.10, 0.07, 0.03, 0.02, 0.01]
CATEGORIES = ["hospitality", "retail", "health", "services"]
TERMINALS = ["tap_and_go", "chip_and_pin", "eftpos", "manual_entry"]
TERMINAL_RATIOS = [0.95, 0.03, 0.015, 0.005]
CARD_TYPES = ["debit", "credit"]
CARD_RATIOS = [0.69, 0.31]
CURRENCY = "AUD"

# Business-hours profile per category: (category, open_hour, close_hour).
BUSINESS_HOURS = [
    ("hospitality", 7, 23),
    ("retail", 9, 19),
    ("health", 8, 18),
    ("services", 8, 20),
]
DEFAULT_OPEN_HOUR = 8
DEFAULT_CLOSE_HOUR = 20

# Expected ticket per category used by the fraud-prior rule.
CATEGORY_BASE_AMOUNT = [
    ("hospitality", 45.0),
    ("retail", 78.0),
    ("health", 120.0),
    ("services", 95.0),
]

# Fraud prior rule: base, increments, clip.
FRAUD_PRIOR_BASE = 0.0003
FRAUD_PRIOR_MANUAL = 0.1174
FRAUD_PRIOR_CHIP = 0.0106
FRAUD_PRIOR_OFF_HOURS = 0.0024
FRAUD_PRIOR_CREDIT = 0.0006
FRAUD_PRIOR_RATIO_GT4 = 0.0287
FRAUD_PRIOR_RATIO_GT8 = 0.0462
FRAUD_PRIOR_MANUAL_OFF_RATIO4 = 0.3994
FRAUD_PRIOR_CHIP_OFF_RATIO4 = 0.1747
FRAUD_PRIOR_CLIP = 0.45

# Fallback calibration frames (month, values).
RETAIL_TRADE_FALLBACK = [
    ("2025-10", 124.1), ("2025-11", 126.4), ("2025-12", 127.2), ("2026-01", 128.0),
]
CARD_PAYMENTS_FALLBACK = [
    ("2025-10", 0.93, 0.67, 0.0012),
    ("2025-11", 0.94, 0.68, 0.0011),
    ("2025-12", 0.95, 0.69, 0.0013),
    ("2026-01", 0.95, 0.69, 0.0012),
]
# ---- FIXED VALUES: scoring cut-offs ------------------------------------------
RISK_LEVELS = [(0.95, "CRITICAL"), (0.85, "HIGH"), (0.70, "MEDIUM")]
RISK_DEFAULT = "LOW"
ACTIONS = [
    (0.95, "Block transaction and require manual review"),
    (0.85, "Hold transaction for verification"),
    (0.70, "Flag for post-settlement review"),
]
ACTION_DEFAULT = "Allow"
DEFAULT_THRESHOLD = 0.85
REVIEW_CUTOFF = 0.7
STREAM_ALERT_CUTOFF = 0.85
STREAM_AMOUNT_SCALE = 5000.0
SEVERITY_HIGH_AMOUNT = 1000.0
SEVERITY_MEDIUM_AMOUNT = 300.0
STD_FLOOR = 0.01
# live feed proxy score: base, z divisor, z cap, manual, credit, fraud
FEED_BASE = 0.18
FEED_Z_DIVISOR = 9.0
FEED_Z_CAP = 0.55
FEED_MANUAL = 0.18
FEED_CREDIT = 0.08
FEED_FRAUD = 0.20
HEURISTIC_Z_DIVISOR = 10.0
ENSEMBLE_ISO_WEIGHT = 0.3
ENSEMBLE_CLF_WEIGHT = 0.7
MODEL_HEALTH_AUC = 0.8
DRIFT_THRESHOLD = 0.3
BIAS_SCORE_CUTOFF = 0.85
BIAS_FAIL_GAP = 0.10
BIAS_WARN_GAP = 0.05
FRESHNESS_ALARM_SECONDS = 7200
HISTORY_LIMIT = 2000

# ---- FIXED VALUES: data-quality rules -----------------------------------------
AMOUNT_MIN = 0.01
AMOUNT_MAX = 500000.0
REQUEST_AMOUNT_MAX = 500000.0
QUESTION_MIN_LEN = 3
QUESTION_MAX_LEN = 500
REQUIRED_STREAM_KEYS = ["transaction_id", "merchant_id", "amount_aud", "timestamp"]
CONTRACT_COLUMNS = ["transaction_id", "merchant_id", "amount_aud", "currency",
                    "timestamp", "merchant_category", "state", "is_fraud"]

# ---- FIXED VALUES: text patterns (Python/Java regex syntax) ------------------
CARD_PATTERN = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
EMAIL_PATTERN = r"[\w\.-]+@[\w\.-]+"
CARD_TAG = "[REDACTED_CARD]"
EMAIL_TAG = "[REDACTED_EMAIL]"
RESPONSE_PII_REPLACEMENT = "[REDACTED - PII detected in response]"

CROSS_MERCHANT_PATTERNS = [
    r"all\s+merchants",
    r"other\s+merchant",
    r"every\s+merchant",
    r"merchant_id\s*(!?=|<>)",
]
INJECTION_PATTERNS = [
    r";\s*(DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE)",
    r"--\s*$",
    r"\/\*.*\*\/",
    r"UNION\s+SELECT",
    r"OR\s+1\s*=\s*1",
]
PII_REQUEST_PATTERNS = [
    r"card\s*number",
    r"credit\s*card",
    r"cvv",
    r"customer\s*name",
    r"customer\s*email",
    r"phone\s*number",
    r"address",
    r"date\s*of\s*birth",
]
DANGEROUS_SQL_KEYWORDS = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "GRANT"]
READONLY_BLOCKED_TOKENS = [" drop ", " delete ", " update ", " insert ", " alter ", " create "]

# ---- FIXED VALUES: intent keyword lists (checked in this order) --------------
ROUTER_INTENTS = [
    ("sql", ["revenue", "sales", "average", "trend", "compare", "total", "count",
             "growth", "how much", "how many"]),
    ("anomaly", ["suspicious", "fraud", "anomaly", "unusual", "weird", "alert", "risk",
                 "investigate", "flagged"]),
    ("rag", ["what is", "how does", "explain", "best practice", "recommend", "terminal",
             "eftpos", "integration"]),
]
ROUTER_DEFAULT = "rag"
CHAT_INTENTS = [
    ("revenue", ["revenue", "total", "earned", "sales", "money"]),
    ("fraud", ["fraud", "suspicious", "anomaly", "risk"]),
    ("peak", ["peak", "busy", "hour", "when"]),
]
CHAT_DEFAULT = "profile"

# ---- FIXED VALUES: retrieval -------------------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
KNN_K = 5
KNN_CONTEXT_MAX_DISTANCE = 0.8
ANSWER_TOP_SOURCES = 3

# ---- test-data adapter parameters (ours) --------------------------------------
# events.event_type -> payment_terminal
EVENT_TERMINAL = [
    ("view", "tap_and_go"),
    ("click", "tap_and_go"),
    ("purchase", "chip_and_pin"),
    ("signup", "eftpos"),
    ("error", "manual_entry"),
]
FRAUD_EVENT_TYPE = "error"
FRAUD_MIN_VALUE = 150.0
AS_OF = date(2024, 1, 31)

# ---- FIXED VALUES: model feature columns (training order) ---------------------
FEATURE_COLUMNS = [
    "txn_velocity_1h",
    "txn_velocity_24h",
    "avg_amount_7d",
    "stddev_amount_30d",
    "amount_zscore",
    "max_amount_7d",
    "unique_customers_1d",
    "pct_tap_payments_7d",
    "hour_of_day",
    "is_outside_business_hours",
    "pct_debit_7d",
    "off_hours_txn_ratio_7d",
    "state_avg_amount_deviation",
    "is_manual_entry",
    "is_chip_and_pin",
    "is_credit_card",
    "amount_to_merchant_avg_7d",
]

# Feature registry: (name, computation, window) in registry order.
FEATURE_REGISTRY = [
    ("txn_velocity_1h", "count", "1H"),
    ("txn_velocity_24h", "count", "24H"),
    ("avg_amount_7d", "mean", "7D"),
    ("stddev_amount_30d", "std", "30D"),
    ("amount_zscore", "zscore", "30D"),
    ("max_amount_7d", "max", "7D"),
    ("unique_customers_1d", "nunique", "1D"),
    ("pct_tap_payments_7d", "ratio", "7D"),
    ("hour_of_day", "extract_hour", "none"),
    ("is_outside_business_hours", "business_hours_check", "none"),
    ("pct_debit_7d", "debit_ratio", "7D"),
    ("off_hours_txn_ratio_7d", "off_hours_ratio", "7D"),
    ("state_avg_amount_deviation", "state_deviation", "30D"),
]
# Monitored drift columns.
DRIFT_COLUMNS = [
    "txn_velocity_1h", "txn_velocity_24h", "avg_amount_7d", "stddev_amount_30d",
    "amount_zscore", "max_amount_7d", "unique_customers_1d", "pct_tap_payments_7d",
    "hour_of_day", "is_outside_business_hours",
]

# Default governance config: declared PII fields and handling strategy.
DEFAULT_PII_FIELDS = ["customer_email"]
DEFAULT_PII_HANDLING = "mask"
