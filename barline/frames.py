"""Window frames over ordered bars, and gaps-and-islands helpers.

Windows count rows, not time.  ``by`` lists the partition columns, a symbol and,
where folds or grids are in play, their numbers, which is what spreads work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SYM = ("sym",)


def ordered(by=SYM, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(ts)


def trailing(n: int, by=SYM) -> WindowSpec:
    """This row and the ``n - 1`` before it."""
    return ordered(by).rowsBetween(-(n - 1), 0)


def running(by=SYM) -> WindowSpec:
    """All rows up to this one."""
    return ordered(by).rowsBetween(Window.unboundedPreceding, 0)


def remaining(by=SYM) -> WindowSpec:
    """This row and all after it."""
    return ordered(by).rowsBetween(0, Window.unboundedFollowing)


def ahead(first: int, last: int, by=SYM) -> WindowSpec:
    return ordered(by).rowsBetween(first, last)


def at_least(value: Column, counted: Column, window: WindowSpec, least: int) -> Column:
    """``value``, or null where fewer than ``least`` values stand in the window."""
    return F.when(F.count(counted).over(window) >= least, value)


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def run_ids(df: DataFrame, changed: Column, into: str = "run", by=SYM) -> DataFrame:
    """Number runs of rows: a new one begins where ``changed`` is true."""
    return df.withColumn(into, F.sum(F.when(changed, 1).otherwise(0)).over(running(by)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns worked out once: the optimiser doesn't fold their expressions into what is built on them."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def round_to(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, for results that are compared by value."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))
