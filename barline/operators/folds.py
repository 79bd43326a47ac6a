"""Calendar walk-forward folds and what is fitted on their training rows."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.quantiles import with_quantiles

SCHEMA = "fold int, train_start timestamp_ntz, train_end timestamp_ntz, val_start timestamp_ntz, val_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz"


def _plus_months(t: datetime, n: int) -> datetime:
    """Calendar months later; the day is cut to the month's length."""
    year, month = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=year, month=month + 1, day=min(t.day, monthrange(year, month + 1)[1]))


def splits(spark: SparkSession, first: datetime, last: datetime, train_months: int = 24, val_months: int = 3, test_months: int = 3) -> DataFrame:
    """One row for each fold that ends by ``last``; the start moves on by the test length each time."""
    rows, start = [], first
    while True:
        val = _plus_months(start, train_months)
        test = _plus_months(val, val_months)
        end = _plus_months(test, test_months)
        if end > last:
            break
        rows.append((len(rows), start, val, val, test, test, end))
        start = _plus_months(start, test_months)
    return spark.createDataFrame(rows, SCHEMA)


def bar_splits(bars: DataFrame, **lengths: int) -> DataFrame:
    """Folds over the time range of the bars (one row of two values comes to the driver)."""
    low, high = bars.agg(F.min("ts"), F.max("ts")).first()
    return splits(bars.sparkSession, low, high, **lengths) if low else bars.sparkSession.createDataFrame([], SCHEMA)


def expand(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars with (fold, role), once for each fold that they fall into.

    Train and validation are half open, test includes its end, so the bar at a
    test end also opens the next test.  Folds are a few dozen rows.
    """
    ts = F.col("ts")
    role = (
        F.when((ts >= F.col("train_start")) & (ts < F.col("train_end")), "train")
        .when((ts >= F.col("val_start")) & (ts < F.col("val_end")), "val")
        .otherwise("test")
    )
    few = F.broadcast(folds)
    return bars.join(few, (ts >= folds["train_start"]) & (ts <= folds["test_end"])).select(*bars.columns, "fold", role.alias("role"))


def complete(rows: DataFrame) -> DataFrame:
    """Folds that have rows in all three roles."""
    has = lambda role: F.count_if(F.col("role") == role) > 0
    return rows.groupBy("fold").agg(*(has(r).alias(r) for r in ("train", "val", "test"))).where("train and val and test").select("fold")


def missing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    return wanted.join(have, "fold", "left_anti")


def parse_folds(text: str) -> list[int]:
    """'0-2,2,4' -> [0, 1, 2, 4], order kept."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, _, high = part.partition("-")
        out += [k for k in range(int(low), int(high or low) + 1) if k not in out]
    return list(dict.fromkeys(out))


def select(folds: DataFrame, wanted: str | Sequence[int] | None = None) -> DataFrame:
    """The folds (rows with ``fold``) that a list or a text like '0-2,5' names, all for None.

    ValueError if it names none, or one that isn't there: folds are few, and
    the missing ones come to the driver.
    """
    if wanted is None:
        return folds
    numbers = sorted(set(parse_folds(wanted) if isinstance(wanted, str) else wanted))
    if not numbers:
        raise ValueError("no fold is named")
    asked = folds.sparkSession.createDataFrame([(k,) for k in numbers], "fold int")
    lacking = sorted(r.fold for r in missing(asked, folds.select("fold").distinct()).collect())
    if lacking:
        raise ValueError(f"folds {lacking} aren't there")
    return folds.join(F.broadcast(asked), "fold", "left_semi")  # a row for each fold


def parse_run(text: str, modes: tuple[str, ...] = ("bc", "ac"), file: str = "ac.pt") -> dict[str, str]:
    """'label=dir@file:mode' -> its four parts; the mode defaults to the last of ``modes``, the file to ``file``.

    ValueError without a label or a directory, or with an empty file.
    """
    label, given, path = text.partition("=")
    head, cut, mode = path.rpartition(":")
    path, mode = (head, mode) if cut and mode in modes else (path, modes[-1])
    folder, cut, name = path.rpartition("@")
    folder, name = (folder, name) if cut else (path, file)
    if not (given and label and folder and name):
        raise ValueError(f"a run is label=dir@file:mode, not {text!r}")
    return {"label": label, "dir": folder, "file": name, "mode": mode}


def quantile_norm(rows: DataFrame, signal: str, by=("sym", "fold")) -> DataFrame:
    """Signal centred on the training median of its positive values, over q90 - q50 of these."""
    x = F.when((F.col("role") == "train") & (F.col(signal) > 0), F.col(signal))
    scale = F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6))
    return with_quantiles(rows, x, (0.5, 0.9), by).withColumn(f"{signal}_norm", (F.col(signal) - F.col("_q")[0]) / scale).drop("_q")


def standardise(rows: DataFrame, signal: str, by=("sym", "fold"), bound: float = 5.0) -> DataFrame:
    """Signal over its training mean and population deviation, bounded."""
    x = F.when(F.col("role") == "train", F.col(signal))
    fit = rows.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    value = (F.col(signal) - F.col("_m")) / F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))
    return rows.join(fit, list(by)).withColumn(f"{signal}_std", F.when(value.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), value)))).drop("_m", "_s")
