"""The fixed robustness conditions, as an array literal to explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (tag, display name, type, kernel size, sigma, alpha, beta).
CONDITIONS = [
    ("original", "Original", "none", None, None, None, None),
    ("gaussian_blur_k9", "Gaussian blur", "gaussian_blur", 9, 0.0, None, None),
    ("vertical_flip", "Vertical flip", "vertical_flip", None, None, None, None),
    ("brightness_increase", "Brightness increase", "brightness", None, None, 1.15, 35.0),
    ("brightness_decrease", "Brightness decrease", "brightness", None, None, 0.85, -35.0),
]
FIELDS = (
    ("condition", "string"), ("display", "string"), ("type", "string"), ("kernel_size", "int"), ("sigma", "double"),
    ("alpha", "double"), ("beta", "double"), ("condition_order", "int"),
)
TYPES = ("none", "gaussian_blur", "vertical_flip", "brightness")


def condition_array(conditions=CONDITIONS) -> Column:
    """One struct per condition, in declared order."""
    unknown = {c[2] for c in conditions} - set(TYPES)
    if unknown:
        raise ValueError(f"unknown condition type: {sorted(unknown)}")
    rows = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for (name, kind), v in zip(FIELDS, (*c, order))])
        for order, c in enumerate(conditions)
    ]
    return F.array(*rows)
