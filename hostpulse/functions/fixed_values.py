"""Values that results depend on, stated once. Everything else imports them from here."""

# Name and tag cleaning patterns.
BETWEEN_NAME_PARTS = r"[^a-zA-Z0-9]+"
BAD_HOST_CHARACTER = r"[^a-zA-Z0-9_-]"
BAD_UNIT_CHARACTER = r"[^a-zA-Z0-9_%]"
UNKNOWN_MEASUREMENT = "unknown_metric"
INVALID_MEASUREMENT = "invalid_data"
PARSE_ERROR_MEASUREMENT = "json_parse_error"
PARSE_ERROR_TYPE = "json_parsing_failed"
MISSING_FIELDS_TAG = "missing_required_fields"
UNPARSABLE_FIELDS_TAG = "unparsable_fields"
NO_UNIT = "none"

# Metrics scanned when the caller names none.
KEY_METRICS = [
    "vm_memory_utilization",
    "system_cpu_util_user",
    "proc_num",
    "proc_num_run",
    "system_uptime",
    "system_cpu_load_all_avg1",
    "system_cpu_load_all_avg5",
    "system_cpu_load_all_avg15",
    "system_cpu_intr",
    "agent_ping",
    "system_cpu_util_system",
    "net_if_out_eth0",
    "net_if_out_eth0_errors",
]

# Metrics the scheduled forecast refresh watches, and its age limits in hours.
REFRESH_METRICS = ["system_cpu_util", "system_cpu_util_user", "system_cpu_load_all_avg1", "vm_memory_utilization"]
FORECAST_STALE_HOURS = 4
DETECTOR_FRESH_HOURS = 24

# Feature windows and lags.
ROLLING_MINUTES = [5, 15, 60]
ROLLING_ROWS = [3, 5, 10]
LAG_PERIODS = [1, 2, 3, 6, 12]
FILLED_LAG_PERIODS = [1, 2, 3]

# Detector thresholds and floors.
Z_LIMIT = 3.0
MODIFIED_Z_LIMIT = 3.5
MODIFIED_Z_SCALE = 0.6745
IQR_FACTOR = 1.5
TRAINING_IQR_FACTOR = 3.0
SPREAD_FLOOR = 1e-8
RATIO_FLOOR = 1e-8
SPARSE_LIMIT = 0.8
MIN_DETECTOR_ROWS = 10
CONTAMINATION_GRID = [0.05, 0.10, 0.15, 0.20]

# Score and risk labels, highest limit first.
SEVERITY_LEVELS = [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")]
LOWEST_SEVERITY = "LOW"
HEALTH_LEVELS = [(0.85, "excellent"), (0.7, "good")]
LOWEST_HEALTH = "needs_attention"

# Threshold bands per panel, as (panel, lower bound or None, colour).
PANEL_BANDS = [
    ("filesystem", None, "green"),
    ("filesystem", 70.0, "yellow"),
    ("filesystem", 85.0, "orange"),
    ("filesystem", 95.0, "red"),
    ("uptime", None, "red"),
    ("uptime", 3600.0, "yellow"),
    ("uptime", 86400.0, "green"),
    ("memory", None, "green"),
    ("memory", 70.0, "yellow"),
    ("memory", 85.0, "orange"),
    ("memory", 95.0, "red"),
    ("swap", None, "red"),
    ("swap", 10.0, "orange"),
    ("swap", 20.0, "yellow"),
    ("swap", 50.0, "green"),
    ("risk", None, "green"),
    ("risk", 25.0, "yellow"),
    ("risk", 50.0, "orange"),
    ("risk", 75.0, "red"),
    ("anomalies", None, "green"),
    ("anomalies", 3.0, "yellow"),
    ("anomalies", 5.0, "red"),
    ("accuracy", None, "red"),
    ("accuracy", 70.0, "yellow"),
    ("accuracy", 85.0, "green"),
    ("health", None, "red"),
    ("health", 50.0, "yellow"),
    ("health", 80.0, "green"),
    ("series", None, "green"),
    ("series", 80.0, "red"),
]

# Code to text mappings.
MODEL_STATUS_TEXT = {0: "NO MODEL", 1: "ACTIVE"}
RISK_CODE_TEXT = {0: "LOW", 25: "MEDIUM", 50: "HIGH", 75: "CRITICAL"}

# Feature families by substring of the lower-case feature name.
FEATURE_FAMILIES = {
    "temporal": ["hour", "day", "weekend", "business", "sin", "cos"],
    "cpu": ["cpu"],
    "memory": ["memory", "ram"],
    "disk": ["disk", "fs", "filesystem"],
    "network": ["net"],
    "rolling": ["rolling"],
    "lag": ["lag"],
    "derived": ["avg", "max", "severity", "pressure", "critical", "health"],
}

# Failure advice per risk level.
FAILURE_ADVICE = {
    "CRITICAL": (
        "Immediate intervention required",
        "System failure predicted within %.1f hours with %.1f%% confidence",
        [
            "Check system logs immediately",
            "Verify hardware status",
            "Consider immediate maintenance",
            "Alert on-call team",
        ],
    ),
    "HIGH": (
        "Schedule maintenance within 24 hours",
        "Potential failure in %.1f hours with %.1f%% confidence",
        [
            "Schedule proactive maintenance",
            "Monitor closely",
            "Prepare backup systems",
            "Review recent changes",
        ],
    ),
    "MEDIUM": (
        "Monitor and plan maintenance",
        "Moderate risk detected with %.1f%% failure probability",
        [
            "Increase monitoring frequency",
            "Plan maintenance window",
            "Review performance trends",
        ],
    ),
}
FAILURE_HORIZON_HOURS = 72.0

# Forecasting parameters per metric family.
FAMILY_PARAMETERS = {
    "cpu_percentage": {
        "data_type": "percentage",
        "unit": "%",
        "business_hours": True,
        "growth": "logistic",
        "changepoint_scale": 0.001,
        "seasonality_scale": 15.0,
        "interval_width": 0.85,
        "cap": 100.0,
        "floor": 0.0,
        "outlier_method": "iqr",
        "outlier_factor": 2.0,
        "smooth": True,
        "fill": "interpolate",
        "target_mape": 15.0,
        "target_mae": 5.0,
    },
    "load_average": {
        "data_type": "load_average",
        "unit": "none",
        "business_hours": True,
        "seasonality_scale": 8.0,
        "interval_width": 0.80,
        "floor": 0.0,
        "outlier_method": "percentile",
        "outlier_factor": 0.95,
        "smooth": True,
        "fill": "interpolate",
        "target_mape": 25.0,
    },
    "memory_percentage": {
        "data_type": "percentage",
        "unit": "%",
        "business_hours": True,
        "growth": "logistic",
        "changepoint_scale": 0.005,
        "seasonality_scale": 12.0,
        "interval_width": 0.80,
        "cap": 100.0,
        "floor": 0.0,
        "outlier_method": "iqr",
        "outlier_factor": 1.5,
        "smooth": False,
        "fill": "forward_fill",
        "target_mape": 12.0,
        "target_mae": 3.0,
    },
    "network_traffic": {
        "data_type": "network_traffic",
        "unit": "bps",
        "business_hours": True,
        "growth": "linear",
        "changepoint_scale": 0.08,
        "seasonality_scale": 5.0,
        "interval_width": 0.85,
        "outlier_method": "percentile",
        "outlier_factor": 0.98,
        "smooth": True,
        "fill": "interpolate",
        "target_mape": 30.0,
    },
    "generic": {
        "data_type": "generic",
        "unit": "unknown",
        "business_hours": False,
        "growth": "linear",
        "changepoint_scale": 0.05,
        "seasonality_scale": 10.0,
        "interval_width": 0.80,
        "outlier_method": "iqr",
        "outlier_factor": 2.0,
        "smooth": True,
        "fill": "interpolate",
        "target_mape": 25.0,
    },
}

# Load averages count as low below these mean and maximum values; their growth,
# changepoint scale and cap follow, and the maximum decides the divisor of large loads.
LOW_LOAD_MEAN, LOW_LOAD_MAX = 2.0, 5.0
LOW_LOAD = {"growth": "linear", "changepoint_scale": 0.05}
HIGH_LOAD = {"growth": "logistic", "changepoint_scale": 0.01}
LOAD_CAP_MINIMUM, LOAD_CAP_FACTOR = 16.0, 1.5
LOAD_DIVISORS = [(1000.0, 1000.0), (100.0, 100.0)]
LOAD_MAE_SHARE = 0.3

# Domain feature limits.
CPU_SEVERITY_LIMITS = [(90, 3), (80, 2), (70, 1)]
MEMORY_PRESSURE_LIMIT = 95
DISK_CRITICAL_LIMIT = 90

# Series quality weights (completeness, consistency, range) and outlier band.
QUALITY_WEIGHTS = (0.4, 0.3, 0.3)
QUALITY_IQR_FACTOR = 3.0

# Forecast minimum rows (additive, autoregressive) per forecaster generation.
MIN_FORECAST_ROWS = {"profiled": (20, 30), "plain": (10, 50)}

#: Older versions of a model that stay beside the latest.
MODEL_BACKUPS = 5
