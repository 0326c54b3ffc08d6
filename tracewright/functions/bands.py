"""Ordered classifications of planning measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in per cent of the gradient bands; the last band is open.
GRADIENT_BANDS = (("gentle", 3.0), ("noticeable", 5.0), ("steep", 8.0), ("very-steep", 12.5), ("severe", None))
# Factors of edge length by routing role, for preferred and for other edges.
ROLE_FACTORS = {"strategic": (0.35, 1.6), "b-road": (0.35, 1.6), "low-traffic": (0.75, 4.0), "ncn": (0.4, 1.3), "direct": (1.0, 1.0)}


def band(value: Column, bands: Sequence[tuple[str, float | None]]) -> Column:
    """The first band whose upper bound is not below the value; a bound of None takes all that is left."""
    out = None
    for name, upper in bands:
        test = value.isNotNull() if upper is None else value <= upper
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def gradient_band(per_cent: Column) -> Column:
    return band(F.abs(per_cent), GRADIENT_BANDS)


def freshness(year: Column, as_at: int | None, max_age: int | None) -> Column:
    """fresh, stale or unknown: unknown without a date to compare with or for years to come."""
    if max_age is None:
        return F.lit("fresh")
    if as_at is None:
        return F.lit("unknown")
    age = F.lit(as_at) - year
    return F.when(age.isNull() | (age < 0), "unknown").when(age > max_age, "stale").otherwise("fresh")


def role_weight(length: Column, role: str, preferred: Column) -> Column:
    """Length weighted for a routing role."""
    yes, no = ROLE_FACTORS[role]
    return length * F.when(preferred, yes).otherwise(no)


def first_true(*cases: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = F.when(cases[0][1], cases[0][0])
    for name, test in cases[1:]:
        out = out.when(test, name)
    return out.otherwise(otherwise)
