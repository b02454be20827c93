"""Thresholds and name patterns the analyses share.

Fixed values: they decide labels, so they must stay as they are for results to match.
"""

from __future__ import annotations

import re

# Column-name patterns (searched anywhere in the name, case-insensitive)
ID_NAME = r"(^id$|_id$|^uuid$|^guid$|^key$|_key$|^index$)"
REVENUE_NAME = r"(revenue|sales|amount|price|value|cost|profit|income|total)"
COUNT_NAME = r"(count|quantity|qty|units|orders|items|number|num_|n_)"
CHANGE_WORDS = ("change", "diff", "delta", "growth")
KEY_WORDS = ("id", "index", "key")

# Semantic types
SEMANTIC_TYPES = ("numeric", "categorical", "temporal", "text", "boolean", "id")
BOOLEAN_WORDS = ("True", "False", "true", "false", "yes", "no", "Yes", "No", "Y", "N")
HIGH_CARDINALITY = 100
HIGH_CARDINALITY_RATIO = 0.5
TEXT_MEAN_LENGTH = 50
DATE_SAMPLE = 100
DATE_SHARE = 0.8

# Data quality
MISSING_FLAG_PCT = 5.0
COMPLETE_ROWS_PCT = 80.0
DUPLICATE_PCT = 1.0

# Minimum numbers of values
MIN_SUMMARY = 10
MIN_SHAPE = 30
SHAPIRO_LIMIT = 5000

# Caps that are part of a result's definition
TREND_METRICS = 5
CORRELATED_COLUMNS = 15
SEGMENT_COLUMNS = 3
SEGMENT_KPIS = 2
SEGMENT_CARDINALITY = (2, 20)

DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
    "MM-dd-yyyy",
    "dd-MMM-yyyy",
    "MMM d, yyyy",
)


def named_like(name: str, pattern: str) -> bool:
    return re.search(pattern, name, re.IGNORECASE) is not None


def display_name(name: str) -> str:
    return name.replace("_", " ").title()
