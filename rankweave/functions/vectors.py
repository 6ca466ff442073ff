"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """E5: v / ||v|| as array<double>; zero vectors are returned unchanged.

    The norm is an element that a lambda reads: named in the inner lambda it would be summed again for every entry.
    """
    as_double = v.cast("array<double>")
    by = lambda n: F.when(n == 0, as_double).otherwise(F.transform(as_double, lambda x: x / n))
    return F.element_at(F.transform(F.array(l2_norm(v)), by), 1)


def is_valid_vector(v: Column) -> Column:
    """A vector is usable when it is present and non-empty."""
    return v.isNotNull() & (F.size(v) > 0)
