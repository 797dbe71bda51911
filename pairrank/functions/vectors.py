"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors on one row; 0 if either has no length.

    For scoring two tables against each other use
    :mod:`pairrank.operators.similarity`, which multiplies whole blocks.
    """
    lengths = norm(a) * norm(b)
    value = F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)
    # zip_with would silently pad the shorter vector.
    return F.when(F.size(a) == F.size(b), value).when(
        a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different size")).cast("double")
    )
