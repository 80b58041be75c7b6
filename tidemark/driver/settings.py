"""How the operators are mapped to the driver's tables; shared by queries and SQL."""

from ..presets import icu

CHANNELS = ["click", "error", "purchase", "signup", "view"]
STATS = ["mean", "median", "mode", "kurtosis", "skew", "std"]
SEG_HOURS = 48
TOTAL_HOURS = 192
GAP_HOURS = 8.0
MIN_HOURS = 12.0
WINDOW_DAYS = 60
FLAG_CODES = {"on_flag": ("click", "view"), "alt_flag": ("signup",),
              "end_flag": ("purchase", "error"), "special_flag": ("error",)}
# Interpolated values differ in their last bits: both engines round before the mode.
MODE_DECIMALS = 9
RETURN_FLAGS = ["A", "N", "R"]
LINE_SEG_HOURS = 8760
ONE_USER = 7
FOLDS = 3
FEATURE_CHANNELS = ["click", "error", "purchase", "signup", "view", "ratio", "product"]
SPLIT_MULTIPLIER = 2654435761
SPLIT_PRIME = 4294967291
SIGNAL_START = "2024-01-01 00:00:00"
SIGNAL_FS = 0.016
URL_PATTERN = r"^https?://(?:[a-z]+\.)?([a-z]+)\.example\.(?:com|net|org)/(?:[a-z]+)/(\d+)"

# Codes and texts dealt to events so that they can be read as charted items.
CHART_CODES = [c for r in icu.CHANNEL_RULES for c in r.codes]
STATUS_CODES = [*icu.STATUS_CODES, 459, 211]
BODY_CODES = [*[c for r in icu.BODY_RULES for c in r.codes], 226531]
CHART_TEXTS = [*icu.O2_DEVICE_TEXTS, *icu.O2_DEVICE_TEXTS_OLD, "Trach mask", "Ventilator",
               "Extubated", "Self Extubation", "Other", "Other/Remarks", ""]
