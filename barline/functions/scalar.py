"""Column expressions that Spark has no name for; all stay in generated code."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(values: Column) -> Column:
    """Shares of an array's exponentials."""
    powers = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda s, q: s + q))


def bucketize(x: Column, edges: tuple[float, ...]) -> Column:
    """How many of the ascending edges lie below x."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.when(x.isNotNull(), 0))


def one_hot(index: Column, size: int) -> Column:
    """An array of zeros with a one at ``index``; null stays null."""
    return F.when(index.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double")))


def finite_or(x: Column, other: float = 0.0) -> Column:
    """``other`` in place of null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(other)).otherwise(x)


def run_id(settings: dict) -> str:
    """Twenty hex digits that name a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:20]


def clipped_atanh(x: Column, edge: float = 1e-6) -> Column:
    """Inverse hyperbolic tangent, of values kept inside (-1, 1) by ``edge``."""
    return F.when(x.isNotNull(), F.atanh(F.greatest(F.lit(edge - 1), F.least(F.lit(1 - edge), x))))
