"""Scalar expressions shared by the operators. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_flag(c: Column) -> Column:
    """Booleans that arrive as bool, 0/1 or text; null is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "1.0"), F.lit(False))


def strict_label(c: Column) -> Column:
    """Text label to 0/1; any other text stops the job."""
    return (
        F.when(c == "True", 1)
        .when(c == "False", 0)
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(c, F.lit("null")))).cast("int"))
    )


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num/den`` with a default where the denominator is zero."""
    return F.when(den != 0, num / den).otherwise(F.lit(default))


def portable_hash(i: Column) -> Column:
    """Order key for sampling, the same in any SQL engine.

    Fixed values: multiplier 1103515245, increment 12345, modulus 2147483648. The position is
    reduced first (same result, no overflow).
    """
    m = F.lit(2147483648)
    return (i.cast("long") % m * F.lit(1103515245) + F.lit(12345)) % m


def catalogue_seconds(text: Column) -> Column:
    """Seconds since sol 0 from catalogue text ``SSSS HH:MM:SS``."""
    part = F.split(text, "[ :]")
    n = [F.try_element_at(part, F.lit(k)).try_cast("long") for k in range(1, 5)]
    return n[0] * 86400 + n[1] * 3600 + n[2] * 60 + n[3]


def prior_corrected(p: Column, train_prior: float, deploy_prior: float) -> Column:
    """Re-weigh a score from the training prior to the deployment prior."""
    eps = 1e-10
    c = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    odds = c / (1 - c) * ((deploy_prior / (1 - deploy_prior)) / (train_prior / (1 - train_prior)))
    return odds / (1 + odds)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
