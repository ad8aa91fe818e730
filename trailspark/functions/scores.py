"""Column functions over times, scores and robust statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The worst first.
SEVERITIES = ("critical", "high", "medium", "low")


def severity(score: Column) -> Column:
    return F.when(score >= 85, "critical").when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def off_hours(hour: Column, start: int = 22, end: int = 6) -> Column:
    """Whether an hour lies in the off-hours, which may wrap midnight."""
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    day, second = F.unix_date(F.to_date(ts)).cast("long"), F.extract(F.lit("SECOND"), ts)
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + (second * 1_000_000).cast("long")


def variation(mean: Column, deviation: Column, n: Column) -> Column:
    """Coefficient of variation; infinite below two values or for a mean that is not positive."""
    return F.when((n >= 2) & (mean > 0), F.try_divide(deviation, mean)).otherwise(F.lit(float("inf")))


def robust_z(value: Column, n: Column, median: Column, mad: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the median in scaled median absolute deviations; in standard deviations of the mean where those are
    0; 0 for fewer than three values or none that differ."""
    by_mad = F.try_divide(F.lit(0.6745) * (value - median), mad)
    by_deviation = F.try_divide(value - mean, deviation)
    return F.when(n < 3, 0.0).when(mad > 0, by_mad).when(deviation > 0, by_deviation).otherwise(0.0)


def truncated(value: Column) -> Column:
    return value.cast("int")


def clamped(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(100)), F.lit(0)).cast("int")
