"""Constants of the domain, in one place."""

# Physiology defaults.
DEFAULT_HR_REST = 60
SLEEP_NEED_MIN = 480
LTHR_SHARE = 0.90
TANAKA = (208.0, 0.7)

# Training load. 100 is one hour at threshold.
CTL_DAYS, ATL_DAYS = 42.0, 7.0
RPE_CALIBRATION = 100.0 / 420.0
CONFIDENCE = {"power": 0.95, "pace": 0.80, "heart_rate": 0.75, "rpe": 0.45, "none": 0.0}
PRECEDENCE = {
    "bike": ("power", "heart_rate", "rpe"),
    "run": ("power", "heart_rate", "pace", "rpe"),
    "swim": ("pace", "heart_rate", "rpe"),
    "strength": ("heart_rate", "rpe"),
    "other": ("heart_rate", "rpe"),
}

# Readiness.
BASELINE_DAYS, BASELINE_POINTS = 28, 7
READINESS_WEIGHTS = {"hrv": 0.30, "resting_hr": 0.15, "sleep": 0.25, "subjective": 0.10, "training_load": 0.20}
READINESS_BANDS = ((25, "compromised"), (50, "limited"), (70, "moderate"), (85, "good"))
READINESS_TOP = "prime"
DEEP_REM_TARGET = 0.45
LEAST_DATA_QUALITY = 0.35

# Injury risk (log-odds for each unit of a feature).
RISK_INTERCEPT, RISK_CAP = -2.60, 3.0
RISK_COEFFICIENTS = {
    "acwr_excess": 0.45,
    "ramp_excess": 0.30,
    "monotony_excess": 0.25,
    "sleep_debt_h": 0.35,
    "hrv_suppression": 0.30,
    "resting_hr_elevation": 0.20,
    "prior_injury": 0.85,
    "low_chronic_load": 0.55,
    "training_age": -0.40,
    "age_over_40": 0.15,
}
RISK_BANDS = ((0.10, "low"), (0.20, "moderate"), (0.35, "high"))
RISK_TOP = "very_high"

# Zones, as shares of the anchor; None is open.
LTHR_ZONES = (("Z1 Recovery", 0.00, 0.85), ("Z2 Aerobic", 0.85, 0.90), ("Z3 Tempo", 0.90, 0.95), ("Z4 Threshold", 0.95, 1.00), ("Z5 VO2max", 1.00, None))
HR_MAX_ZONES = (("Z1 Recovery", 0.50, 0.60), ("Z2 Aerobic", 0.60, 0.70), ("Z3 Tempo", 0.70, 0.80), ("Z4 Threshold", 0.80, 0.90), ("Z5 VO2max", 0.90, None))
POWER_ZONES = (("Z1 Active Recovery", 0.00, 0.56), ("Z2 Endurance", 0.56, 0.76), ("Z3 Tempo", 0.76, 0.91), ("Z4 Threshold", 0.91, 1.06), ("Z5 VO2max", 1.06, 1.21), ("Z6 Anaerobic", 1.21, 1.51), ("Z7 Neuromuscular", 1.51, None))
SPEED_ZONES = (("Z1 Recovery", 0.00, 0.78), ("Z2 Aerobic", 0.78, 0.87), ("Z3 Tempo", 0.87, 0.95), ("Z4 Threshold", 0.95, 1.02), ("Z5 VO2max", 1.02, None))

# Performance.
RIEGEL_EXPONENT, RIEGEL_LEAST, RIEGEL_MOST = 1.06, 1.00, 1.20
RACES_M = (1500.0, 5000.0, 10000.0, 21097.5, 42195.0)
VDOT_BRACKET_S, VDOT_STEPS = (30.0, 43200.0), 23
RECENCY_HALF_LIFE_DAYS = 60.0
TRANSITIONS_S = 240.0

# Planning.
RAMP_CAP_PCT = {"beginner": 5.0, "intermediate": 8.0, "advanced": 10.0}
STARTING_LOAD = {"beginner": 150.0, "intermediate": 300.0, "advanced": 500.0}
LOAD_PER_HOUR = {"recovery": 36.0, "easy": 49.0, "tempo": 72.0, "threshold": 96.0, "vo2max": 117.0}
RECOVERY_EVERY, RECOVERY_SHARE, TAPER_SHARES = 4, 0.65, (0.70, 0.50)

# Activity quality.
MAX_SPEED_M_S = {"run": 12.5, "bike": 33.0, "swim": 3.0, "multisport": 33.0, "strength": 5.0, "other": 33.0}
MAX_POWER_W, MAX_DURATION_S, HOLD_BELOW = 2500.0, 108000.0, 0.6

# What is said with a session of each intensity.
SESSION_NOTES = {
    "recovery": "Zone 1 only. If it does not feel easy, stop.",
    "easy": "Zone 2. Conversational the whole way.",
    "tempo": "Zone 3 blocks with full warm-up and cool-down.",
    "threshold": "Zone 4 intervals. Hold the pace, do not race it.",
    "vo2max": "Zone 5 intervals with full recoveries between reps.",
}
