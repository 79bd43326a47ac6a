"""Bars and side series from the event and order tables, and from raw payloads."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline import scratch
from barline.frames import ordered

#: Damping of daily log returns, so that compounding does not saturate.
DAMP = 0.01


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ohlcv(rows: DataFrame, price: Column, key: Column, volume: Column) -> DataFrame:
    """Open, high, low, close and volume of (sym, ts) groups, by the order of ``key``."""
    return rows.groupBy("sym", "ts").agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, key).alias("close"), F.sum(volume).alias("volume"),
    )


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sym"), F.col("o_orderdate").alias("ts"), "o_totalprice", "o_orderkey")
    return _ohlcv(rows, F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_totalprice"))


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15-minute bars by event type; the price is 1 + value."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("sym"), F.window("ts", "15 minutes")["start"].alias("ts"), F.col("ts").alias("at"), "event_id", "value")
    return _ohlcv(rows, 1 + F.col("value"), F.struct("at", "event_id"), F.col("value"))


def returns_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, ts, ret): damped daily log returns, first rows dropped."""
    close = F.col("close")
    ret = DAMP * F.ln(close / F.lag(close).over(ordered()))
    return bars_1d(spark, sf_dir).select("sym", "ts", ret.alias("ret")).where("ret is not null")


def funding_8h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse series: mean value of error events in 8-hour buckets, over 10,000."""
    rows = read(spark, sf_dir, "events").where("event_type = 'error'")
    return rows.groupBy(F.window("ts", "8 hours")["start"].alias("ts")).agg((F.avg("value") / 1e4).alias("funding_rate"))


def mark_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily reference series: mean extended price by ship date."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("mark_close"))


#: FIXED VALUES: positions of the fields in a raw kline row.
KLINE = {"open_time": 0, "open": 1, "high": 2, "low": 3, "close": 4, "volume": 5, "quote_volume": 7, "n_trades": 8, "taker_buy_base": 9, "taker_buy_quote": 10}


def klines(payloads: DataFrame, body: str = "body", sym: str = "sym", end: str | None = None) -> DataFrame:
    """Typed bars from JSON arrays of positional kline rows; rows at or after ``end`` are dropped."""
    row = F.explode(F.from_json(F.col(body), "array<array<string>>")).alias("k")
    k = F.col("k")
    out = payloads.select(F.col(sym), row).select(
        sym, F.timestamp_millis(k[KLINE["open_time"]].cast("long")).cast("timestamp_ntz").alias("ts"),
        *(k[i].cast("long" if name == "n_trades" else "double").alias(name) for name, i in KLINE.items() if name != "open_time"),
    )
    return out.where(F.col("ts") < F.lit(end).cast("timestamp_ntz")) if end else out


def taker_proxy(df: DataFrame, volume: str = "volume", buy: str = "taker_buy_base") -> DataFrame:
    """Signed order flow, imbalance and buy/sell ratio from total and bought volume."""
    bought = F.col(buy)
    sold = F.greatest(F.col(volume) - bought, F.lit(0.0))
    return df.withColumns({"signed_order_flow": bought - sold, "taker_imbalance": (bought - sold) / (F.col(volume) + 1e-8), "buy_sell_ratio": bought / (sold + 1e-8)})


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path`` with a ``ts`` column, or None if there is none."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    df = spark.read.parquet(path)
    name = next((c for c in ("ts", "time", "timestamp") if c in df.columns), None)
    return df if name in (None, "ts") else df.withColumn("ts", F.col(name).cast("timestamp_ntz")).drop(name)


def series_files(spark: SparkSession, pattern: str, include: list[str] | None = None) -> DataFrame:
    """(series, ts, value) of files named ``..._series_NAME.parquet``: each one's first value column."""
    times = ("ts", "time", "timestamp")
    files = sorted(r[0] for r in spark.read.option("mergeSchema", "true").parquet(pattern).select("_metadata.file_path").distinct().collect())  # one for each series
    parts = []
    for path in files:
        name = re.search(r"_series_([^/]+)\.parquet", path).group(1)
        if include and name not in include:
            continue
        df = spark.read.parquet(path)
        time, value = next(c for c in times if c in df.columns), next(c for c in df.columns if c not in times)
        parts.append(df.select(F.lit(name).alias("series"), F.col(time).cast("timestamp_ntz").alias("ts"), F.col(value).cast("double").alias("value")))
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "series string, ts timestamp_ntz, value double")


def long_short_ratio(payloads: DataFrame, body: str = "body", sym: str = "sym") -> DataFrame:
    """(sym, ts, buy, sell, imbalance, ratio) of JSON arrays of taker volumes, in time order."""
    k = F.col("k")
    rows = payloads.select(F.col(sym).alias("sym"), F.explode(F.from_json(F.col(body), "array<struct<timestamp: bigint, buyVol: string, sellVol: string, buySellRatio: string>>")).alias("k"))
    out = rows.select("sym", F.timestamp_millis(k["timestamp"]).cast("timestamp_ntz").alias("ts"), k["buyVol"].cast("double").alias("buy"), k["sellVol"].cast("double").alias("sell"), k["buySellRatio"].cast("double").alias("ratio"))
    return out.withColumn("imbalance", (F.col("buy") - F.col("sell")) / (F.col("buy") + F.col("sell") + 1e-8)).orderBy("sym", "ts")


def mark_klines(payloads: DataFrame, **options) -> DataFrame:
    """(sym, ts, mark_close) of kline payloads of mark prices."""
    return klines(payloads, **options).select("sym", "ts", F.col("close").alias("mark_close"))


def millis(text: Column) -> Column:
    """Milliseconds since 1970 of a time in UTC."""
    return F.unix_millis(F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone()))


def union_symbols(frames: dict[str, DataFrame]) -> DataFrame:
    """One table of several symbols' frames, with the symbol as a column."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("sym", F.lit(sym)) for sym, df in frames.items()))


def cached_pair(spark: SparkSession, folder: str, make, on: tuple[str, ...] = ("sym", "ts")) -> tuple[DataFrame, DataFrame]:
    """(features, returns) of a folder, computed by ``make()`` and written unless both are there; rows that both have.

    Each frame is worked out once, into the shared folder, before they are cut to each other's rows.
    """
    have = [optional(spark, f"{folder}/{name}.parquet") for name in ("features", "returns")]
    if None in have:
        features, returns = (scratch.table(df, "pair") for df in make())
        both = features.select(*on).join(returns.select(*on), list(on))
        for name, df in (("features", features), ("returns", returns)):
            df.join(both, list(on), "left_semi").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        have = [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("features", "returns")]
    return have[0], have[1]


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; ``make()`` is computed and written there first if it is missing."""
    found = optional(spark, path)
    if found is None:
        make().write.parquet(path)
        found = spark.read.parquet(path)
    return found
