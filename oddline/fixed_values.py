"""They must stay as they are for results to be right.

Patterns, names, weights and texts are part of the observable behaviour of the
engine, so they are stated here once, as plain text.
"""

# --- Fixed values: time stamps, in the order in which they are tried ----------
# Written for Java regular expressions.  (?U) makes \d, \s and \b follow
# Unicode; a word character is [\p{L}\p{N}_].
TIMESTAMP_ISO = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
TIMESTAMP_APACHE = r"\d{2}/[\p{L}\p{N}_]{3}/\d{4}:\d{2}:\d{2}:\d{2}"
TIMESTAMP_SYSLOG = r"[\p{L}\p{N}_]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
TIMESTAMP_EPOCH = r"\d{10,13}"
TIMESTAMP_PATTERNS = (TIMESTAMP_ISO, TIMESTAMP_APACHE, TIMESTAMP_SYSLOG, TIMESTAMP_EPOCH)

# --- Fixed values: other masked parts -----------------------------------------
IP_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PATH_PATTERN = r"(?:/[\p{L}\p{N}_\-.]+)+/?"
HEX_PATTERN = r"\b0x[0-9a-fA-F]+\b"
UUID_PATTERN = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
DROPPED_CHARACTERS = r"[^\p{L}\p{N}_\s\x1c-\x1f\-.:<>\[\]()]"

# --- Fixed values: log levels and severities ------------------------------------
LOG_LEVELS = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL")
SEVERITY_WEIGHT = {
    "info": 0.0,
    "low": 0.2,
    "medium": 0.4,
    "high": 0.6,
    "critical": 0.8,
    "emergency": 1.0,
}
SEVERITY_NUMBER = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4, "emergency": 5}
ANOMALY_SEVERITIES = ("high", "critical", "emergency")
DEFAULT_RISK = 50
DESCRIPTION_CHARS = 200

# --- Fixed values: detector defaults ---------------------------------------------
MAX_LOG_LENGTH = 512
EMBEDDING_DIM = 384
ENCODER_BATCH = 32
K_NEIGHBORS = 5
IVF_CELLS = 100
IVF_PROBES = 10
THRESHOLD_PERCENTILE = 95
MIN_DISTANCE = 0.5
MIN_CONFIDENCE = 0.5
STD_FLOOR = 0.01
WINDOW_SIZE = 100
WINDOW_MIN_COUNT = 10
TEMPORAL_WEIGHT = 0.3
CONTEXT_RANGE = (0.5, 2.0)
DECAY_PER_HOUR = 0.95
MIN_TEMPORAL_WEIGHT = 0.1
BURST_RECENT = 10
BURST_MIN_OLDER = 5
BURST_FACTOR = 2.0
TEMPORAL_DIM = 16
SEMANTIC_WEIGHT = 0.4
TRAINING_SEMANTIC_WEIGHT = 0.6
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.1
FOREST_SEED = 42
HYBRID_CONFIDENCE = 0.5

# --- Fixed values: explanation texts ------------------------------------------------
# (upper bound, band, sentence); a score outside [0, 1) gets OUT_OF_BAND.
SCORE_BANDS = (
    (0.3, "Low", "This log shows minor deviation from normal patterns."),
    (0.6, "Medium", "This log shows moderate deviation from established patterns."),
    (0.8, "High", "This log shows significant deviation that warrants investigation."),
    (1.0, "Critical", "This log is highly anomalous and requires immediate attention."),
)
OUT_OF_BAND = ("Critical", "Extremely anomalous pattern detected.")
NO_NEIGHBORS = "No neighbors found"
NO_TEXT = "N/A"
URGENT_ADVICE = (
    "Investigate this log immediately",
    "Check related system components",
    "Review recent changes in the affected service",
)
WATCH_ADVICE = (
    "Monitor for recurring patterns",
    "Add to watchlist for future occurrences",
)
CALM_ADVICE = ("Continue monitoring; no immediate action required",)
KEYWORD_ADVICE = (
    (("error", "fail"), "Check error handling and recovery mechanisms"),
    (("timeout",), "Review network connectivity and service dependencies"),
    (("memory", "cpu"), "Monitor resource utilization trends"),
    (("auth", "login"), "Review authentication logs for security concerns"),
)
REPORT_HEAD = "╔══ ANOMALY REPORT ══╗"
REPORT_TAIL = "╚════════════════════╝"
SIMILAR_LOGS = 3
SIMILAR_TEXT_CHARS = 100
NO_SUMMARY = "Anomaly detected"

# --- Fixed values: display bands and history views -------------------------------------
DISPLAY_CRITICAL = 0.7
DISPLAY_SUSPICIOUS = 0.4
HISTORY_ROWS = 50
ALERT_ROWS = 5
TREND_BUCKET = "4 hours"
