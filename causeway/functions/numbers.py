"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch; a NULL or unreadable time stays NULL."""
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str)
                         else column.cast("timestamp"))


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator / denominator * scale``; NULL, never zero, when the denominator is empty."""
    value = numerator.cast("double") / denominator.cast("double")
    return F.when(denominator > 0, value * scale if scale != 1.0 else value)


def defined(column: Column) -> Column:
    """NaN becomes NULL."""
    number = column.cast("double")
    return F.when(~F.isnan(number), number)


def logit(p: Column, eps: float = 1e-7) -> Column:
    """Log-odds of ``p`` after clipping to ``[eps, 1 - eps]``."""
    clipped = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(clipped / (1 - clipped))


def sigmoid(z: Column) -> Column:
    """Logistic function evaluated so that neither branch overflows."""
    small = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def binary_entropy(p: Column, eps: float = 1e-9) -> Column:
    """Entropy of a Bernoulli(p) in bits."""
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def clock_features(ts: str) -> dict[str, Column]:
    """Hour, Monday-0 weekday and weekend flag of a time column."""
    day = F.weekday(F.col(ts))
    return {
        "hour_of_day": F.hour(F.col(ts)),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
    }
