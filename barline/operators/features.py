"""Causal features over ordered bars: row t uses rows before t only.

Each function returns columns; many share one partitioning and order, so a
single sort serves a whole feature table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.frames import SYM, at_least, ordered, running, trailing

EPS = 1e-8


def lag(x: Column, n: int = 1, by=SYM) -> Column:
    return F.lag(x, n).over(ordered(by))


def log_return(name: str, by=SYM) -> Column:
    """Log return of the bar before."""
    return F.ln(F.lag(name, 1).over(ordered(by)) / F.lag(name, 2).over(ordered(by)))


def raw_return(name: str = "close", by=SYM) -> Column:
    return F.ln(F.col(name) / F.lag(name, 1).over(ordered(by)))


def zscore(name: str, n: int, by=SYM) -> Column:
    """Trailing z-score with the sample deviation, from a quarter of the window on."""
    w = trailing(n, by)
    x = F.col(name)
    return at_least((x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + EPS), x, w, max(n // 4, 1))


def add_rsi(df: DataFrame, n: int = 14, by=SYM) -> DataFrame:
    """Relative strength from simple means of gains and losses, one bar late."""
    d = df.withColumn("_d", F.col("close") - F.lag("close").over(ordered(by)))
    w = trailing(n, by)
    gain = F.avg(F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))).over(w)
    loss = F.avg(F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0)))).over(w)
    value = at_least(100 - 100 / (1 + gain / (loss + EPS)), F.col("_d"), w, n)
    return d.withColumn("_r", value).withColumn("rsi", lag(F.col("_r"), 1, by)).drop("_d", "_r")


def add_atr(df: DataFrame, n: int = 14, by=SYM) -> DataFrame:
    """Mean true range, one bar late."""
    before = F.lag("close").over(ordered(by))
    d = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    w = trailing(n, by)
    return d.withColumn("_a", at_least(F.avg("_tr").over(w), F.col("_tr"), w, n)).withColumn("atr", lag(F.col("_a"), 1, by)).drop("_tr", "_a")


def add_realized_vol(df: DataFrame, windows: tuple[int, ...], ret: str = "r", by=SYM) -> DataFrame:
    """``rv_w``: sample deviation of the last w returns, one bar late."""
    made = {f"_v{w}": at_least(F.stddev_samp(ret).over(trailing(w, by)), F.col(ret), trailing(w, by), max(w // 2, 1)) for w in windows}
    return df.withColumns(made).withColumns({f"rv_{w}": lag(F.col(f"_v{w}"), 1, by) for w in windows}).drop(*made)


def add_rebound(df: DataFrame, windows: tuple[int, ...], ret: str = "r", by=SYM) -> DataFrame:
    """Drawdown, rebound, place in range and momentum of the lagged log price."""
    d = df.withColumn("_p", F.sum(ret).over(running(by))).withColumn("_p", lag(F.col("_p"), 1, by))
    p, out = F.col("_p"), {}
    for w in windows:
        frame, least = trailing(w, by), max(w // 3, 1)
        top, low = F.max(p).over(frame), F.min(p).over(frame)
        out |= {
            f"dd_{w}": at_least(p - top, p, frame, least), f"rebound_{w}": at_least(p - low, p, frame, least),
            f"range_pos_{w}": at_least((p - low) / F.greatest(top - low, F.lit(EPS)), p, frame, least),
            f"mom_{w}": p - F.lag(p, w).over(ordered(by)),
        }
    return d.withColumns(out).drop("_p")


def add_context(df: DataFrame, windows: tuple[int, ...], ret: str = "r", means: dict[str, str] | None = None, by=SYM) -> DataFrame:
    """Momentum over whole windows, deviation, downside deviation and the means of other columns over past rows, one bar late.

    ``means``: column -> name; ``ctx_NAME_w`` is its trailing mean.
    """
    made = {}
    df = df.withColumn("_p", F.sum(ret).over(running(by)))
    for w in windows:
        frame, least, r = trailing(w, by), max(w // 3, 1), F.col(ret)
        down = F.when(r.isNotNull(), F.least(r, F.lit(0.0)))
        made |= {f"_{name}_{w}": at_least(F.avg(c).over(frame), F.col(c), frame, least) for c, name in (means or {}).items()}
        made |= {f"_mom_{w}": F.col("_p") - F.lag("_p", w).over(ordered(by)), f"_vol_{w}": at_least(F.stddev_samp(r).over(frame), r, frame, least), f"_down_{w}": at_least(F.sqrt(F.avg(down * down).over(frame)), r, frame, least)}
    return df.withColumns(made).withColumns({f"ctx{k}": lag(F.col(k), 1, by) for k in made}).drop("_p", *made)


def add_series_stats(df: DataFrame, name: str, windows: tuple[int, ...], by=SYM) -> DataFrame:
    """Change, size and, by window, mean, deviation, z-score and impulse of an aligned series."""
    x = F.col(name)
    out = {f"{name}_delta1": x - F.lag(x, 1).over(ordered(by)), f"{name}_abs": F.abs(x)}
    for w in windows:
        frame, least = trailing(w, by), max(2, w // 3)
        mean, dev = F.avg(x).over(frame), F.stddev_samp(x).over(frame)
        out |= {f"{name}_mean_{w}": at_least(mean, x, frame, least), f"{name}_std_{w}": at_least(dev, x, frame, least), f"{name}_z_{w}": at_least((x - mean) / (dev + EPS), x, frame, least), f"{name}_impulse_{w}": at_least(F.abs(x - mean), x, frame, least)}
    return df.withColumns(out)


def add_funding_context(df: DataFrame, windows: tuple[int, ...], name: str = "funding_rate", by=SYM) -> DataFrame:
    """Mean, deviation, z-score, adjusted skew, positive share and impulse, one bar late."""
    x, made = F.col(name), {}
    for w in windows:
        frame, least = trailing(w, by), max(w // 3, 3)
        n = F.count(x).over(frame)
        mean = F.avg(x).over(frame)
        skew = F.when((n >= 3) & (F.stddev_pop(x).over(frame) > 1e-12), F.skewness(x).over(frame) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))
        made |= {f"_mean_{w}": at_least(mean, x, frame, least), f"_std_{w}": at_least(F.stddev_samp(x).over(frame), x, frame, least), f"_skew_{w}": at_least(skew, x, frame, least), f"_pos_{w}": at_least(F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).over(frame), x, frame, least), f"_impulse_{w}": at_least(F.abs(x - mean), x, frame, least), f"_z_{w}": at_least((x - mean) / (F.stddev_samp(x).over(frame) + EPS), x, frame, least)}
    return df.withColumns(made).withColumns({f"f{k}": lag(F.col(k), 1, by) for k in made}).drop(*made)


#: Rows of a window from which trailing moments come from prefix sums: a frame is gone through again for each row.
LONG = 256


def zscores(df: DataFrame, names: list[str], n: int, by=SYM, long: int = LONG) -> DataFrame:
    """(by, ts, names): ``zscore`` of each column.

    Long windows take the same work for each row whatever their length: rows
    are numbered and cut into blocks of n, inside which values less their
    group's mean, their squares and their number are summed up; a window is
    what the block so far holds and what the block before holds beyond the row
    n rows back.
    """
    if n < long:
        return df.select(*by, "ts", *(zscore(c, n, by).alias(c) for c in names))
    place = (F.row_number().over(ordered(by)) - 1).alias("_i")
    level = {f"_x{k}": F.col(c) - F.avg(c).over(Window.partitionBy(*by)) for k, c in enumerate(names)}
    rows = df.select(*by, "ts", *(F.col(c).cast("double").alias(c) for c in names), place).withColumns({**level, "_block": F.floor(F.col("_i") / n)})
    inside = Window.partitionBy(*by, "_block")
    upto = inside.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    parts = {"s": lambda x: F.coalesce(x, F.lit(0.0)), "q": lambda x: F.coalesce(x * x, F.lit(0.0)), "n": lambda x: F.when(x.isNull(), 0).otherwise(1)}
    terms = {f"{p}{k}": f(F.col(f"_x{k}")) for k in range(len(names)) for p, f in parts.items()}
    summed = rows.withColumns({f"_{t}": x for t, x in terms.items()})
    summed = summed.withColumns({f"_p{t}": F.sum(f"_{t}").over(upto) for t in terms} | {f"_t{t}": F.sum(f"_{t}").over(inside) for t in terms})
    back = lambda t: F.coalesce(F.lag(F.col(f"_t{t}") - F.col(f"_p{t}"), n).over(ordered(by)), F.lit(0))
    summed = summed.withColumns({f"_w{t}": F.col(f"_p{t}") + back(t) for t in terms})

    def score(k: int) -> Column:
        s, q, count = (F.col(f"_w{p}{k}") for p in "sqn")
        mean = F.try_divide(s, count)
        dev = F.sqrt(F.greatest(F.try_divide(q - s * mean, count - 1), F.lit(0.0)))
        return F.when((count >= max(n // 4, 1)) & (count > 1), (F.col(f"_x{k}") - mean) / (dev + EPS))

    return summed.select(*by, "ts", *(score(k).alias(c) for k, c in enumerate(names)))


def scored(df: DataFrame, names: list[str], z: int, by=SYM) -> DataFrame:
    """Trailing z-scores of the columns; rows with a null dropped."""
    return zscores(df, names, z, by).na.drop("any")


def feature_matrix(bars: DataFrame, z: int, rv: tuple[int, ...] = (2, 4), by=SYM) -> DataFrame:
    """Lagged returns, RSI, ATR forms and realised volatility, z-scored; rows with a null dropped."""
    df = add_atr(add_rsi(bars.withColumn("r", raw_return("close", by)), by=by), by=by)
    df = add_realized_vol(df, rv, by=by)
    names = ["open", "high", "low", "close", "volume"]
    df = df.withColumns({f"{n}_ret": log_return(n, by) for n in names})
    df = df.withColumn("atr_norm_ret", F.col("close_ret") / (F.col("atr") / F.lag("close").over(ordered(by)) + EPS))
    features = [f"{n}_ret" for n in names] + ["rsi", "atr_norm_ret", "atr"] + [f"rv_{w}" for w in rv]
    return scored(df, features, z, by)


#: Bars of a day, by the length of a bar.
BARS_PER_DAY = {"1m": 1440, "5m": 288, "15m": 96, "30m": 48, "1h": 24, "4h": 6, "1d": 1}


def days_to_bars(days: int, interval: str = "15m") -> int:
    """Bars in so many days; unknown intervals count as 15 minutes."""
    return days * BARS_PER_DAY.get(interval, BARS_PER_DAY["15m"])


def composite(bars: DataFrame, z: int, rv: tuple[int, ...], side: dict[str, int] | None = None, windows: tuple[int, ...] = (12,), by=SYM) -> DataFrame:
    """The whole feature table: prices, RSI, MACD pair, ATR forms, realised volatility and what side series are there, z-scored.

    ``bars`` may carry (late by no bar yet) ``funding_rate``, ``open_interest``
    and ``mark_close``, aligned, and series named in ``side``; each adds its
    features.  Needs the columns ``macd`` and ``macd_signal`` from
    ``scans.macd``.  Rows with a null feature are dropped.
    """
    names = ["open", "high", "low", "close", "volume"]
    df = add_realized_vol(add_atr(add_rsi(bars.withColumn("r", raw_return("close", by)), by=by), by=by), rv, by=by)
    df = df.withColumns({f"{n}_ret": log_return(n, by) for n in names})
    df = df.withColumn("atr_norm_ret", F.col("close_ret") / (F.col("atr") / F.lag("close").over(ordered(by)) + EPS))
    features = [f"{n}_ret" for n in names] + ["rsi", "macd", "macd_signal", "atr_norm_ret", "atr"] + [f"rv_{w}" for w in rv]
    if "funding_rate" in bars.columns:
        df = df.withColumn("funding_rate", lag(F.col("funding_rate"), 1, by))
        features.append("funding_rate")
    if "open_interest" in bars.columns:
        df = df.withColumn("_oi", F.coalesce(F.ln(F.col("open_interest") / F.lag("open_interest").over(ordered(by))), F.lit(0.0))).withColumn("oi_change", lag(F.col("_oi"), 1, by))
        features.append("oi_change")
    if "mark_close" in bars.columns:
        df = df.withColumn("basis", lag(F.ln(F.col("mark_close") / F.col("close")), 1, by)).withColumn("_m", F.col("basis") - F.lag("basis").over(ordered(by)))
        df = df.withColumns({"basis_mom": lag(F.col("_m"), 1, by), "basis_abs": lag(F.abs("basis"), 1, by)})
        features += ["basis", "basis_mom", "basis_abs"]
    for name in side or ():
        df = add_series_stats(df.withColumn(name, lag(F.col(name), 1, by)), name, windows, by)
        features += [name, f"{name}_delta1", f"{name}_abs", *(f"{name}_{k}_{w}" for w in windows for k in ("mean", "std", "z", "impulse"))]
    return scored(df, features, z, by)
