"""Vector math on ``array<float|double>`` columns, evaluated in the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def fit_score(a: Column, b: Column) -> Column:
    """Cosine of unit vectors squashed from [-1, 1] to [0, 1]."""
    return (dot(a, b) + 1.0) / 2.0
