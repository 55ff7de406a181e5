"""Periods of the day, on-time classes, scores, grades and targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hours of the two period tables (label, first hour, hour after the last).
EWT_PERIODS = (("AM Peak (6-9)", 6, 9), ("Midday (9-15)", 9, 15), ("PM Peak (15-19)", 15, 19), ("Evening (19-24)", 19, 24), ("Night (0-6)", 0, 6))
PERIODS = (("am_peak", 6, 10), ("midday", 10, 15), ("pm_peak", 15, 19), ("evening", 19, 22), ("late", 22, 6))
# Seconds of deviation that count as on time, both ends included.
EARLIEST, LATEST = -120, 420
# EWT seconds with score 100 and score 0; weights with and without EWT; grade floors.
EWT_BEST, EWT_WORST = 60.0, 300.0
WEIGHTS = {"otp": 0.30, "service_delivered": 0.50, "ewt": 0.20}
WEIGHTS_NO_EWT = {"otp": 0.40, "service_delivered": 0.60}
GRADES = (("A", 80), ("B", 60), ("C", 40), ("D", 20))


def _in_hours(hour: Column, first: int, after: int) -> Column:
    return (hour >= first) & (hour < after) if first < after else (hour >= first) | (hour < after)


def _label(hour: Column, table: tuple) -> Column:
    out = F.when(hour.isNull(), None)
    for name, first, after in table:
        out = out.when(_in_hours(hour, first, after), name)
    return out


def ewt_period(hour: Column) -> Column:
    return _label(hour, EWT_PERIODS)


def period_key(hour: Column) -> Column:
    return _label(hour, PERIODS)


def hour_in_period(hour: Column, period: str) -> Column:
    """Is the hour in the named period?  ``all`` takes every hour."""
    if period == "all":
        return F.lit(True)
    first, after = {name: (a, b) for name, a, b in (*PERIODS, *EWT_PERIODS)}[period]
    return F.coalesce(_in_hours(hour, first, after), F.lit(False))


def otp_bucket(deviation_sec: Column) -> Column:
    return F.when(deviation_sec < EARLIEST, "early").when(deviation_sec > LATEST, "late").when(deviation_sec.isNotNull(), "on_time")


def ewt_score(ewt_sec: Column) -> Column:
    """100 up to the best value, 0 from the worst, linear between."""
    return F.when(ewt_sec.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), (EWT_WORST - ewt_sec) / (EWT_WORST - EWT_BEST) * 100.0)))


def composite_score(otp_pct: Column, delivered_ratio: Column, ewt_sec: Column) -> Column:
    three = otp_pct * WEIGHTS["otp"] + delivered_ratio * 100 * WEIGHTS["service_delivered"] + ewt_score(ewt_sec) * WEIGHTS["ewt"]
    two = otp_pct * WEIGHTS_NO_EWT["otp"] + delivered_ratio * 100 * WEIGHTS_NO_EWT["service_delivered"]
    return F.when(otp_pct.isNotNull() & delivered_ratio.isNotNull(), F.coalesce(three, two))


def route_grade(score: Column) -> Column:
    out = F.when(score.isNull(), "N/A")
    for name, floor in GRADES:
        out = out.when(score >= floor, name)
    return out.otherwise("F")


def sanitize(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def feed_expiry_status(end_date: Column, as_of: str, soon_days: int = 7) -> Column:
    left = F.datediff(end_date, F.lit(as_of).cast("date"))
    return F.when(left < 0, "expired").when(left <= soon_days, "expiring_soon").when(left.isNotNull(), "ok")


def attainment(current: Column, target: Column, lower_is_better: Column) -> Column:
    """Share of the target reached; the inverse where lower is better."""
    return F.when(lower_is_better, F.when(current > 0, target / current).when(current.isNotNull() & target.isNotNull(), 1.0)).otherwise(F.when(target > 0, current / target))


def attainment_band(share: Column) -> Column:
    return F.when(share >= 1, "met").when(share >= 0.9, "near").when(share.isNotNull(), "missed")


def gap_fraction(current: Column, target: Column, lower_is_better: Column) -> Column:
    """How far a value misses its target, as a share of it; negative where it beats it."""
    gap = F.when(lower_is_better, current - target).otherwise(target - current)
    return F.when(target != 0, gap / F.abs(target))
