"""Derivation rules as plain Column expressions. Nulls stay null in every rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LOG_EPS, Z_CUT


def as_number(x: Column) -> Column:
    """Double value with NaN read as missing."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def more_than_one_decimal(x: Column) -> Column:
    """True where x is not the double nearest to a number with at most one decimal.

    Dividing and multiplying by ten round-trips exactly for such doubles, so no
    decimal or string conversion is needed per row.
    """
    return x != F.rint(x * 10.0) / 10.0


def shift_log(x: Column, minimum, eps: float = LOG_EPS) -> Column:
    """ln(x - min + eps); the minimum itself maps to ln(eps)."""
    low = minimum if isinstance(minimum, Column) else F.lit(minimum)
    return F.ln(x - low + F.lit(eps))


def zscore(x: Column, mean, sd) -> Column:
    """(x - mean) / sd, null for a constant column."""
    mu = mean if isinstance(mean, Column) else F.lit(mean).cast("double")
    s = sd if isinstance(sd, Column) else F.lit(sd).cast("double")
    return F.try_divide(x - mu, s)


def state(z: Column, cut: float = Z_CUT) -> Column:
    """Sign of z where |z| reaches the cut, else 0."""
    return F.when(F.abs(z) >= cut, F.signum(z)).when(z.isNotNull(), F.lit(0.0))


def state_interaction(s: Column, value: Column) -> Column:
    """The value where the state is 0, else 0."""
    return F.when(s == 0.0, value).when(s.isNotNull(), F.lit(0.0))


def binarize(x: Column) -> Column:
    """1 where x is positive; other values, negatives included, stay as they are."""
    return F.when(x > 0, F.lit(1.0)).otherwise(x)


def replace_rare(x: Column, rare: Sequence[float], replacement: float | None) -> Column:
    """Replace the listed rare categories by one value."""
    if not rare:
        return x
    return F.when(x.isin([float(r) for r in rare]), F.lit(float(replacement))).otherwise(x)


def balance_ratio(x: Column) -> Column:
    """Aggregate: count(x <= 0) / count(x <> 0); null when every value is zero."""
    return F.try_divide(
        F.count_if(x <= 0).cast("double"), F.count_if(x != 0).cast("double")
    )
