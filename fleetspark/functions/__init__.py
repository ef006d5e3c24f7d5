from fleetspark.functions.expressions import (
    bucket10,
    great_circle,
    haversine,
    minute_gap,
    month_of,
    safe_ratio,
    second_gap,
    switch_upper,
    time_bucket,
)
from fleetspark.functions.labels import LabelField, point_label

__all__ = [
    "LabelField",
    "bucket10",
    "great_circle",
    "haversine",
    "minute_gap",
    "month_of",
    "point_label",
    "safe_ratio",
    "second_gap",
    "switch_upper",
    "time_bucket",
]
