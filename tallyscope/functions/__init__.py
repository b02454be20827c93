"""Column functions: labels, number formats, probability values."""

from tallyscope.functions.labels import (
    concentration_label,
    correlation_strength,
    distribution_label,
    finite_or,
    finite_or_null,
    human_number,
    kurtosis_label,
    skew_label,
)
from tallyscope.functions.probability import (
    dagostino_p,
    normal_quantile,
    normal_upper_tail,
    t_two_sided,
)

__all__ = [
    "concentration_label",
    "correlation_strength",
    "dagostino_p",
    "distribution_label",
    "finite_or",
    "finite_or_null",
    "human_number",
    "kurtosis_label",
    "normal_quantile",
    "normal_upper_tail",
    "skew_label",
    "t_two_sided",
]
