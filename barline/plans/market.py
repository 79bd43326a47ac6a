"""Queries on bars, features, alignment and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.frames import ordered, round_to
from barline.operators import align, chunks, features, folds, scans
from barline.plans.views import BARS_1D, BARS_15M, EXPANDED, FOLDS, RETS, rolling
from barline.sources import bars

W = "OVER (PARTITION BY sym ORDER BY ts)"


def q_bars_1d(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(bars.bars_1d(spark, sf))


def q_bars_15m(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(bars.bars_15m(spark, sf))


def _sql_bars(view: str, name: str) -> str:
    return f"WITH {view} SELECT sym, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM {name}"


def q_raw_returns(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(bars.bars_1d(spark, sf).select("sym", "ts", features.raw_return().alias("ret")).where("ret is not null"))


def q_log_returns(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(bars.bars_1d(spark, sf).select("sym", "ts", *(features.log_return(c).alias(f"{c}_ret") for c in ("open", "high", "low", "close", "volume"))))


def q_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(features.add_rsi(bars.bars_1d(spark, sf)).select("sym", "ts", "rsi"))


def q_atr(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(features.add_atr(bars.bars_1d(spark, sf)).select("sym", "ts", "atr"), 4)


def q_atr_norm_ret(spark: SparkSession, sf: str) -> DataFrame:
    df = features.add_atr(bars.bars_1d(spark, sf))
    return round_to(df.select("sym", "ts", (features.log_return("close") / (F.col("atr") / F.lag("close").over(ordered()) + 1e-8)).alias("atr_norm_ret")))


def q_rolling_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(bars.bars_15m(spark, sf).select("sym", "ts", features.zscore("close", 96).alias("z")))


def q_realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    df = bars.bars_15m(spark, sf).withColumn("r", features.raw_return())
    return round_to(features.add_realized_vol(df, (4, 16, 96)).select("sym", "ts", "rv_4", "rv_16", "rv_96"))


def q_ema(spark: SparkSession, sf: str) -> DataFrame:
    df = bars.bars_1d(spark, sf).select("sym", "ts", "close")
    return round_to(chunks.ema(df, ("close",), scans.span(12), ("ema",)).select("sym", "ts", "ema"), 4)


def q_macd(spark: SparkSession, sf: str) -> DataFrame:
    df = bars.bars_1d(spark, sf).select("sym", "ts", "close")
    return round_to(chunks.macd(df, outputs=("macd", "signal")).select("sym", "ts", "macd", "signal"), 4)


def _ema_sql(select: str) -> str:
    # an exponential mean is a fold over the values so far
    return f"""
WITH RECURSIVE {BARS_1D}, b AS MATERIALIZED (SELECT sym, ts, close, row_number() {W} AS n FROM bars),
e AS (
  SELECT sym, ts, n, close AS f, close AS s, 0.0::DOUBLE AS g FROM b WHERE n = 1
  UNION ALL
  SELECT b.sym, b.ts, b.n, e.f + (b.close - e.f) * 2 / 13, e.s + (b.close - e.s) * 2 / 27,
         e.g + ((e.f + (b.close - e.f) * 2 / 13) - (e.s + (b.close - e.s) * 2 / 27) - e.g) * 2 / 10
  FROM e JOIN b ON b.sym = e.sym AND b.n = e.n + 1)
{select}"""


def q_rebound(spark: SparkSession, sf: str) -> DataFrame:
    df = features.add_rebound(bars.bars_15m(spark, sf).withColumn("r", features.raw_return()), (24,))
    return round_to(df.select("sym", "ts", "dd_24", "rebound_24", "range_pos_24", "mom_24"))


def q_context(spark: SparkSession, sf: str) -> DataFrame:
    df = features.add_context(bars.bars_15m(spark, sf).withColumn("r", features.raw_return()), (24,))
    return round_to(df.select("sym", "ts", "ctx_mom_24", "ctx_vol_24", "ctx_down_24"))


def q_asof_funding(spark: SparkSession, sf: str) -> DataFrame:
    df = align.asof(bars.bars_15m(spark, sf).select("sym", "ts"), bars.funding_8h(spark, sf), "funding_rate", zero=True)
    return round_to(df.select("sym", "ts", F.coalesce(features.lag(F.col("funding_rate")), F.lit(0.0)).alias("funding_rate")), 10)


def q_funding_context(spark: SparkSession, sf: str) -> DataFrame:
    df = align.asof(bars.bars_15m(spark, sf).select("sym", "ts"), bars.funding_8h(spark, sf), "funding_rate", zero=True).withColumn("funding_rate", F.col("funding_rate") * 1e4)
    return round_to(features.add_funding_context(df, (96,)).select("sym", "ts", "f_mean_96", "f_std_96", "f_z_96", "f_skew_96", "f_pos_96", "f_impulse_96"), 3)


def q_basis(spark: SparkSession, sf: str) -> DataFrame:
    df = align.asof(bars.bars_1d(spark, sf).select("sym", "ts", "close"), bars.mark_1d(spark, sf), "mark_close", fill_head=True)
    df = df.withColumn("basis", features.lag(F.ln(F.col("mark_close") / F.col("close"))))
    df = df.withColumn("m", F.col("basis") - F.lag("basis").over(ordered()))
    return round_to(df.select("sym", "ts", "basis", features.lag(F.col("m")).alias("basis_mom"), features.lag(F.abs("basis")).alias("basis_abs")))


def q_oi_change(spark: SparkSession, sf: str) -> DataFrame:
    df = align.asof(bars.bars_1d(spark, sf).select("sym", "ts"), bars.mark_1d(spark, sf), "mark_close", fill_head=True)
    df = df.withColumn("d", F.coalesce(F.ln(F.col("mark_close") / F.lag("mark_close").over(ordered())), F.lit(0.0)))
    return round_to(df.select("sym", "ts", features.lag(F.col("d")).alias("oi_change")))


def q_extra_series(spark: SparkSession, sf: str) -> DataFrame:
    df = align.asof(bars.bars_1d(spark, sf).select("sym", "ts"), bars.mark_1d(spark, sf), "mark_close", fill_head=True)
    df = df.withColumn("x", features.lag(F.col("mark_close")) / 1e4)
    return round_to(features.add_series_stats(df, "x", (12,)).drop("mark_close"))


def q_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(features.feature_matrix(bars.bars_1d(spark, sf), 60), 5)


def q_taker_proxy(spark: SparkSession, sf: str) -> DataFrame:
    rows = bars.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("volume"), (F.col("l_quantity") * F.col("l_discount") * 10).alias("taker_buy_base"))
    return round_to(bars.taker_proxy(rows).select("l_orderkey", "l_linenumber", "signed_order_flow", "taker_imbalance", "buy_sell_ratio"), 4)


def q_wfo_splits(spark: SparkSession, sf: str) -> DataFrame:
    return folds.bar_splits(bars.returns_1d(spark, sf))


def _fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rets = bars.returns_1d(spark, sf)
    return folds.expand(rets, folds.bar_splits(rets))


def q_fold_rows(spark: SparkSession, sf: str) -> DataFrame:
    return round_to(_fold_rows(spark, sf).groupBy("fold", "role", "sym").agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("ret")))


def q_fold_boundary_dups(spark: SparkSession, sf: str) -> DataFrame:
    return _fold_rows(spark, sf).where("role = 'test'").groupBy("sym", "ts").agg(F.count(F.lit(1)).alias("folds")).where("folds > 1")


def q_train_quantile_norm(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.quantile_norm(_fold_rows(spark, sf), "ret")
    return round_to(df.where("role = 'test'").select("sym", "fold", "ts", "ret_norm"), 5)


def q_train_standardize(spark: SparkSession, sf: str) -> DataFrame:
    df = folds.standardise(_fold_rows(spark, sf), "ret")
    return round_to(df.where("role <> 'train'").select("sym", "fold", "ts", "role", "ret_std"), 5)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_R15 = f"WITH {BARS_15M}, r15 AS (SELECT *, ln(close / lag(close) {W}) AS r FROM bars15)"
_X1D = f"WITH {BARS_1D}"
_FUND = "fund AS (SELECT time_bucket(INTERVAL 8 HOUR, ts) AS ts, avg(value) / 1e4 AS funding_rate FROM events WHERE event_type = 'error' GROUP BY 1)"
_MARK = "mark AS (SELECT l_shipdate AS ts, avg(l_extendedprice) AS mark_close FROM lineitem GROUP BY 1), head AS (SELECT arg_min(mark_close, ts) AS h FROM mark), am AS (SELECT b.sym, b.ts, b.close, coalesce(m.mark_close, h) AS mark_close FROM bars b ASOF LEFT JOIN mark m ON b.ts >= m.ts CROSS JOIN head)"
_ATR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) AS x FROM bars), a0 AS (SELECT *, {rolling('avg(x) OVER @', 14, 14)} AS a FROM tr), atr AS (SELECT *, lag(a) {W} AS atr FROM a0)"
_RSI = f"d AS (SELECT *, close - lag(close) {W} AS x FROM bars), g AS (SELECT *, {rolling('100 - 100 / (1 + avg(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER @ / (avg(CASE WHEN x IS NOT NULL THEN greatest(-x, 0) END) OVER @ + 1e-8))', 14, 14)} AS v FROM d), rsi AS (SELECT sym, ts, lag(v) {W} AS rsi FROM g)"
_LR = ", ".join(f"ln(lag({c}, 1) {W} / lag({c}, 2) {W}) AS {c}_ret" for c in ("open", "high", "low", "close", "volume"))
_FEATURES = ["open_ret", "high_ret", "low_ret", "close_ret", "volume_ret", "rsi", "atr_norm_ret", "atr", "rv_2", "rv_4"]


def _z(c: str, n: int) -> str:
    return rolling(f"({c} - avg({c}) OVER @) / (stddev_samp({c}) OVER @ + 1e-8)", n, n // 4, c)


ORACLES = {
    "q_bars_1d": _sql_bars(BARS_1D, "bars"),
    "q_bars_15m": _sql_bars(BARS_15M, "bars15"),
    "q_raw_returns": f"{_X1D} SELECT sym, ts, round(ret, 6) AS ret FROM (SELECT sym, ts, ln(close / lag(close) {W}) AS ret FROM bars) WHERE ret IS NOT NULL",
    "q_log_returns": f"{_X1D} SELECT sym, ts, {', '.join(f'round({c}_ret, 6) AS {c}_ret' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM (SELECT sym, ts, {_LR} FROM bars)",
    "q_rsi": f"{_X1D}, {_RSI} SELECT sym, ts, round(rsi, 6) AS rsi FROM rsi",
    "q_atr": f"{_X1D}, {_ATR} SELECT sym, ts, round(atr, 4) AS atr FROM atr",
    "q_atr_norm_ret": f"{_X1D}, {_ATR} SELECT sym, ts, round(ln(lag(close, 1) {W} / lag(close, 2) {W}) / (atr / lag(close) {W} + 1e-8), 6) AS atr_norm_ret FROM atr",
    "q_rolling_zscore": f"WITH {BARS_15M} SELECT sym, ts, round({_z('close', 96)}, 6) AS z FROM bars15",
    "q_realized_vol": f"{_R15}, v AS (SELECT sym, ts, {', '.join(rolling('stddev_samp(r) OVER @', w, w // 2, 'r') + f' AS v{w}' for w in (4, 16, 96))} FROM r15) SELECT sym, ts, {', '.join(f'round(lag(v{w}) {W}, 6) AS rv_{w}' for w in (4, 16, 96))} FROM v",
    "q_ema": _ema_sql("SELECT sym, ts, round(f, 4) AS ema FROM e"),
    "q_macd": _ema_sql(f"SELECT sym, ts, round(lag(f - s) {W}, 4) AS macd, round(lag(g) {W}, 4) AS signal FROM e"),
    "q_rebound": f"{_R15}, p0 AS (SELECT *, sum(r) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM r15), p AS (SELECT *, lag(c) {W} AS x FROM p0) SELECT sym, ts, round({rolling('x - max(x) OVER @', 24, 8)}, 6) AS dd_24, round({rolling('x - min(x) OVER @', 24, 8)}, 6) AS rebound_24, round({rolling('(x - min(x) OVER @) / greatest(max(x) OVER @ - min(x) OVER @, 1e-8)', 24, 8)}, 6) AS range_pos_24, round(x - lag(x, 24) {W}, 6) AS mom_24 FROM p",
    "q_context": f"{_R15}, c0 AS (SELECT *, sum(r) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM r15), c AS (SELECT sym, ts, c - lag(c, 24) {W} AS m, {rolling('stddev_samp(r) OVER @', 24, 8, 'r')} AS v, {rolling('sqrt(avg(CASE WHEN r IS NOT NULL THEN least(r, 0) * least(r, 0) END) OVER @)', 24, 8, 'r')} AS d FROM c0) SELECT sym, ts, round(lag(m) {W}, 6) AS ctx_mom_24, round(lag(v) {W}, 6) AS ctx_vol_24, round(lag(d) {W}, 6) AS ctx_down_24 FROM c",
    "q_asof_funding": f"WITH {BARS_15M}, {_FUND} SELECT sym, ts, round(coalesce(lag(f) {W}, 0), 10) AS funding_rate FROM (SELECT b.sym, b.ts, coalesce(funding_rate, 0) AS f FROM bars15 b ASOF LEFT JOIN fund ON b.ts >= fund.ts)",
    "q_funding_context": f"WITH {BARS_15M}, {_FUND}, a AS (SELECT b.sym, b.ts, coalesce(funding_rate, 0) * 1e4 AS x FROM bars15 b ASOF LEFT JOIN fund ON b.ts >= fund.ts), c AS (SELECT sym, ts, {rolling('avg(x) OVER @', 96, 32)} AS m, {rolling('stddev_samp(x) OVER @', 96, 32)} AS s, {rolling('avg((x > 0)::DOUBLE) OVER @', 96, 32)} AS p, {rolling('abs(x - avg(x) OVER @)', 96, 32)} AS i, {rolling('(x - avg(x) OVER @) / (stddev_samp(x) OVER @ + 1e-8)', 96, 32)} AS z, {rolling('CASE WHEN stddev_pop(x) OVER @ > 1e-12 THEN skewness(x) OVER @ END', 96, 32)} AS k FROM a) SELECT sym, ts, round(lag(m) {W}, 3) AS f_mean_96, round(lag(s) {W}, 3) AS f_std_96, round(lag(z) {W}, 3) AS f_z_96, round(lag(k) {W}, 3) AS f_skew_96, round(lag(p) {W}, 3) AS f_pos_96, round(lag(i) {W}, 3) AS f_impulse_96 FROM c",
    "q_basis": f"{_X1D}, {_MARK}, x AS (SELECT sym, ts, lag(ln(mark_close / close)) {W} AS basis FROM am), y AS (SELECT *, basis - lag(basis) {W} AS m FROM x) SELECT sym, ts, round(basis, 6) AS basis, round(lag(m) {W}, 6) AS basis_mom, round(lag(abs(basis)) {W}, 6) AS basis_abs FROM y",
    "q_oi_change": f"{_X1D}, {_MARK}, x AS (SELECT sym, ts, coalesce(ln(mark_close / lag(mark_close) {W}), 0) AS d FROM am) SELECT sym, ts, round(lag(d) {W}, 6) AS oi_change FROM x",
    "q_extra_series": f"{_X1D}, {_MARK}, y AS (SELECT sym, ts, lag(mark_close) {W} / 1e4 AS x FROM am) SELECT sym, ts, round(x, 6) AS x, round(x - lag(x) {W}, 6) AS x_delta1, round(abs(x), 6) AS x_abs, round({rolling('avg(x) OVER @', 12, 4)}, 6) AS x_mean_12, round({rolling('stddev_samp(x) OVER @', 12, 4)}, 6) AS x_std_12, round({rolling('(x - avg(x) OVER @) / (stddev_samp(x) OVER @ + 1e-8)', 12, 4)}, 6) AS x_z_12, round({rolling('abs(x - avg(x) OVER @)', 12, 4)}, 6) AS x_impulse_12 FROM y",
    "q_feature_matrix": f"{_X1D}, {_ATR}, {_RSI}, rr AS (SELECT *, ln(close / lag(close) {W}) AS r FROM atr), v AS (SELECT rr.*, {rolling('stddev_samp(r) OVER @', 2, 1, 'r')} AS v2, {rolling('stddev_samp(r) OVER @', 4, 2, 'r')} AS v4 FROM rr), f0 AS (SELECT sym, ts, atr, {_LR}, lag(close) {W} AS pc, lag(v2) {W} AS rv_2, lag(v4) {W} AS rv_4 FROM v), f AS (SELECT f0.*, rsi, close_ret / (atr / pc + 1e-8) AS atr_norm_ret FROM f0 JOIN rsi USING (sym, ts)), z AS (SELECT sym, ts, {', '.join(f'{_z(c, 60)} AS {c}_z' for c in _FEATURES)} FROM f) SELECT sym, ts, {', '.join(f'round({c}_z, 5) AS {c}' for c in _FEATURES)} FROM z WHERE {' AND '.join(f'{c}_z IS NOT NULL' for c in _FEATURES)}",
    "q_taker_proxy": "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, l_quantity * l_discount * 10 AS b FROM lineitem), u AS (SELECT *, greatest(v - b, 0.0) AS s FROM t) SELECT l_orderkey, l_linenumber, round(b - s, 4) AS signed_order_flow, round((b - s) / (v + 1e-8), 4) AS taker_imbalance, round(b / (s + 1e-8), 4) AS buy_sell_ratio FROM u",
    "q_wfo_splits": f"{RETS}, {FOLDS} SELECT * FROM folds",
    "q_fold_rows": f"{RETS}, {FOLDS}, {EXPANDED} SELECT fold, role, sym, count(*) AS n, round(sum(ret), 6) AS ret FROM fr GROUP BY ALL",
    "q_fold_boundary_dups": f"{RETS}, {FOLDS}, {EXPANDED} SELECT sym, ts, count(*) AS folds FROM fr WHERE role = 'test' GROUP BY sym, ts HAVING count(*) > 1",
    "q_train_quantile_norm": f"{RETS}, {FOLDS}, {EXPANDED}, q AS (SELECT sym, fold, quantile_cont(ret, 0.5) AS a, quantile_cont(ret, 0.9) AS b FROM fr WHERE role = 'train' AND ret > 0 GROUP BY ALL) SELECT sym, fold, ts, round((ret - a) / greatest(b - a, 1e-6), 5) AS ret_norm FROM fr JOIN q USING (sym, fold) WHERE role = 'test'",
    "q_train_standardize": f"{RETS}, {FOLDS}, {EXPANDED}, q AS (SELECT sym, fold, avg(ret) AS m, stddev_pop(ret) AS s FROM fr WHERE role = 'train' GROUP BY ALL) SELECT sym, fold, ts, role, round(greatest(-5, least(5, (ret - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END)), 5) AS ret_std FROM fr JOIN q USING (sym, fold) WHERE role <> 'train'",
}
