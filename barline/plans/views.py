"""SQL of the views that the queries' oracles start from."""

import re

BARS_1D = "bars AS (SELECT o_orderpriority AS sym, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume FROM orders GROUP BY 1, 2)"
BARS_15M = "bars15 AS (SELECT event_type AS sym, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, arg_min(1 + value, (ts, event_id)) AS open, max(1 + value) AS high, min(1 + value) AS low, arg_max(1 + value, (ts, event_id)) AS close, sum(value) AS volume FROM events GROUP BY 1, 2)"
RETURNS = "rets AS (SELECT sym, ts, ret FROM (SELECT sym, ts, 0.01 * ln(close / lag(close) OVER (PARTITION BY sym ORDER BY ts)) AS ret FROM bars) WHERE ret IS NOT NULL)"
POSITIONS = "rows AS (SELECT *, CASE WHEN lag(ret) OVER (PARTITION BY sym ORDER BY ts) > 0 THEN 1.12 ELSE 0.5 END::DOUBLE AS pos FROM rets)"
UNIT = 0.00055
#: Blends, steps and holds of the whole execution grid.
SPECS = [(b, s, h) for b in (0.25, 0.5, 0.75, 1.0) for s in (0.01, 0.02, 0.04) for h in (16, 32, 64)]
#: The same, and holding the benchmark.
CANDIDATES = [*SPECS, (0.0, 0.04, 16)]
PNL = f"""pnl AS (SELECT *, {UNIT} * abs(pos - lag(pos, 1, 0.0) OVER w) AS cost, pos * ret - {UNIT} * abs(pos - lag(pos, 1, 0.0) OVER w) AS pnl,
  ret - CASE WHEN row_number() OVER w = 1 THEN {UNIT} ELSE 0.0 END AS bench_pnl FROM rows WINDOW w AS (PARTITION BY sym ORDER BY ts))"""
EQUITY = """eq0 AS (SELECT *, exp(sum(pnl) OVER w) AS equity, exp(sum(bench_pnl) OVER w) AS bench_equity FROM pnl WINDOW w AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING)),
eq AS (SELECT *, (equity - max(equity) OVER w) / (max(equity) OVER w + 1e-8) AS dd, (bench_equity - max(bench_equity) OVER w) / (max(bench_equity) OVER w + 1e-8) AS bench_dd FROM eq0 WINDOW w AS (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
RETS = f"WITH {BARS_1D}, {RETURNS}"
ROWS = f"{RETS}, {POSITIONS}"
PNLS = f"{ROWS}, {PNL}"
EQS = f"{PNLS}, {EQUITY}"
#: Walk-forward folds of 24 + 3 + 3 months over the returns.
FOLDS = """span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM rets),
folds AS (SELECT k::INT AS fold, s AS train_start, s + INTERVAL 24 MONTH AS train_end, s + INTERVAL 24 MONTH AS val_start, s + INTERVAL 27 MONTH AS val_end, s + INTERVAL 27 MONTH AS test_start, s + INTERVAL 30 MONTH AS test_end
  FROM (SELECT k, lo + to_months((3 * k)::INT) AS s, hi FROM span, range(200) r(k)) WHERE s + INTERVAL 30 MONTH <= hi)"""
EXPANDED = """fr AS (SELECT r.*, fold, CASE WHEN ts >= train_start AND ts < train_end THEN 'train' WHEN ts >= val_start AND ts < val_end THEN 'val' ELSE 'test' END AS role FROM rets r JOIN folds f ON ts >= train_start AND ts <= test_end)"""


def rolling(expr: str, n: int, least: int, counted: str = "x") -> str:
    """An expression over the last n rows, null under ``least`` values of ``counted``."""
    frame = f"(PARTITION BY sym ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({counted}) OVER {frame} >= {least} THEN {expr.replace('@', frame)} END"


def plain_zeros(sql: str) -> str:
    """Rounded columns without negative zeros, which compare as another value."""
    return re.sub(r", (\d+)\) AS ", r", \1) + 0.0 AS ", sql)
