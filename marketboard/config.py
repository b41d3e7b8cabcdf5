"""Default parameters. Every operator takes these as arguments and only falls back to them here."""

# ---- fixed values: targets and names -------------------------------------------------------
CROPS = ["Onion", "Tomato"]
MANDIS = ["Nashik", "Pune"]

CROP_ALIASES = {
    "pyaaz": "Onion",
    "kanda": "Onion",
    "vengayam": "Onion",
    "tamatar": "Tomato",
    "thakkali": "Tomato",
}

# ---- fixed values: thresholds and frames ---------------------------------------------------
RAIN_THRESHOLD_MM = 5.0
FALL_THRESHOLD_PCT = -5.0
RISE_THRESHOLD_PCT = 5.0
SHORT_FRAME_ROWS = 7
LONG_FRAME_ROWS = 30

# ---- fixed values: forecasting -------------------------------------------------------------
TRAIN_ROWS = 60
MIN_SERIES_ROWS = 30
FORECAST_PERIODS = 10
NO_PAIRS_ERROR = 999.0
GOOD_MAPE_PCT = 20.0
BAND_WIDTH_SIGMAS = 1.2816  # two-sided 80 % interval of a normal distribution

# ---- fixed values: text --------------------------------------------------------------------
CHUNK_WORDS = 300
CHUNK_OVERLAP_WORDS = 50
CHUNK_MIN_CHARS = 50
TOP_K = 2
OVER_FETCH = 3
SPEECH_MAX_CHARS = 500

PROTECTED_TERMS = [
    "Nashik", "Pune", "Onion", "Tomato", "APMC",
    "ICAR", "MSP", "quintal", "₹",
]

LANGUAGE_CODES = {
    "English": "en-IN",
    "Hindi": "hi-IN",
    "Marathi": "mr-IN",
    "Telugu": "te-IN",
    "Tamil": "ta-IN",
    "Kannada": "kn-IN",
    "Gujarati": "gu-IN",
    "Bengali": "bn-IN",
    "Punjabi": "pa-IN",
}

# ---- fixed values: decision rules (trend, signal) -> (decision, confidence) ------------------
VERDICT_RULES = {
    ("FALLING", "WET"): ("SELL NOW", "HIGH"),
    ("FALLING", "DRY"): ("SELL SOON", "MEDIUM"),
    ("RISING", "DRY"): ("HOLD", "HIGH"),
    ("RISING", "WET"): ("HOLD SHORT", "MEDIUM"),
}
DEFAULT_VERDICT = ("MONITOR", "LOW")

# The key of one price series.
SERIES = ["crop", "mandi"]
