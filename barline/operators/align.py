"""As-of alignment of sparse series to bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a time bucket.
BUCKET = 30 * 86_400


def _bucket(width: float):
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (width * 1_000_000)).cast("long").alias("_bucket")


def asof(bars: DataFrame, series: DataFrame, value: str, fill_head: bool = False, zero: bool = False, width: float = BUCKET) -> DataFrame:
    """Bars with the last ``value`` at or before each bar's time.

    Both are cut into time buckets.  Inside a bucket one sorted pass puts the
    series' rows among the bars and carries the last value on, so no row is
    compared with a range of others; what a bucket begins with is the last
    value of the buckets before it, of which there is one row each.  A series
    without ``sym`` counts for all symbols, whose bars then stand in one bucket
    with it: it is not copied for them.

    ``fill_head`` gives bars before the first value that value (which looks
    ahead, as filling backwards does); ``zero`` fills what is left with 0.
    Null values of the series are passed over; of several at one time the
    largest counts.  A bar column called ``value`` is replaced.
    """
    by = ["sym"] if "sym" in series.columns else []
    keys = [*by, "_bucket"]
    points = series.select(*by, "ts", F.col(value).cast("double").alias(value), F.lit(0).alias("_bar"), _bucket(width)).where(F.col(value).isNotNull())
    kept = [F.col(c) for c in bars.columns if c != value]
    mixed = bars.select(*kept, F.lit(None).cast("double").alias(value), F.lit(1).alias("_bar"), _bucket(width)).unionByName(points, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("ts", "_bar", value).rowsBetween(Window.unboundedPreceding, 0)
    inside = mixed.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_bar = 1")

    # the buckets that have no point, or none yet, begin with the last one before: a row for each bucket of the series
    newest = F.struct("ts", value)
    ends = points.groupBy(*keys).agg(F.max_by(value, newest).alias("_last"), F.min(F.struct("ts", (-F.col(value)).alias("v"))).alias("_first"))
    after = F.lead("_bucket", 1).over(Window.partitionBy(*by).orderBy("_bucket"))
    reach = ends.withColumn("_until", F.coalesce(after, F.col("_bucket") + 1))
    begins = reach.select(*(F.col(c).alias(f"_{c}") for c in by), "_last", F.explode(F.sequence(F.col("_bucket") + 1, F.col("_until"))).alias("_from"))
    whole = ends.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg((F.max("_bucket") + 1).alias("_top"), (-F.min("_first")["v"]).alias("_head"))
    same = lambda: [F.col("sym").eqNullSafe(F.col("_sym"))] if by else []
    # one row, or one for each symbol; bars after the series' last bucket look at the one that follows it
    told = inside.join(whole, same(), "left").drop("_sym") if by else inside.join(F.broadcast(whole), F.lit(True), "left")
    told = told.withColumn("_bucket", F.least("_bucket", "_top")).join(begins, [*same(), F.col("_bucket") == F.col("_from")], "left")
    out = F.coalesce(value, "_last", *(["_head"] if fill_head else []), *([F.lit(0.0)] if zero else []))
    return told.select(*kept, out.alias(value))
