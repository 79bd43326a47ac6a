"""Time plain single-threaded pandas, NumPy and tokenizers forms of headline queries: python baseline.py [DIR].

reading the tables is part of the time, as it is in bench.py.
"""

import json
import os
import sys
import time

for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS", "TOKENIZERS_PARALLELISM"):
    os.environ[name] = "false" if name == "TOKENIZERS_PARALLELISM" else "1"

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

SF = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
UNIT = 5.5e-4


def table(name, columns):
    return pd.read_parquet(f"{SF}/{name}.parquet", columns=columns)


def bars_1d():
    o = table("orders", ["o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"]).sort_values("o_orderkey")
    g = o.groupby(["o_orderpriority", "o_orderdate"])["o_totalprice"]
    return pd.DataFrame({"open": g.first(), "high": g.max(), "low": g.min(), "close": g.last(), "volume": g.sum()}).reset_index()


def bars_15m():
    e = table("events", ["event_type", "ts", "event_id", "value"]).sort_values(["ts", "event_id"])
    g = e.assign(ts=e.ts.dt.floor("15min"), p=1 + e.value).groupby(["event_type", "ts"])["p"]
    return pd.DataFrame({"open": g.first(), "high": g.max(), "low": g.min(), "close": g.last()}).reset_index()


def returns():
    for _, g in bars_1d().groupby("o_orderpriority"):
        yield 0.01 * np.diff(np.log(g.close.to_numpy()))


def positions(ret):
    return np.where(np.r_[False, ret[:-1] > 0], 1.12, 0.5)


def q_backtest_summary():
    for ret in returns():
        pos = positions(ret)
        pnl = pos * ret - UNIT * np.abs(np.diff(pos, prepend=0))
        equity = np.exp(np.cumsum(pnl))
        peak = np.maximum.accumulate(equity)
        pnl.mean(), pnl.std(), equity[-1], ((equity - peak) / (peak + 1e-8)).min()


def q_rolling_zscore():
    for _, g in bars_15m().groupby("event_type"):
        r = g.close.rolling(96, min_periods=24)
        (g.close - r.mean()) / (r.std() + 1e-8)


def q_feature_matrix():
    for _, g in bars_1d().groupby("o_orderpriority"):
        d = g.close.diff()
        rsi = 100 - 100 / (1 + d.clip(lower=0).rolling(14).mean() / ((-d.clip(upper=0)).rolling(14).mean() + 1e-8))
        tr = np.maximum(g.high - g.low, np.maximum((g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()))
        r = np.log(g.close / g.close.shift())
        f = pd.DataFrame({c: np.log(g[c] / g[c].shift()).shift() for c in ("open", "high", "low", "close", "volume")} | {"rsi": rsi.shift(), "atr": tr.rolling(14).mean().shift(), "v2": r.rolling(2).std().shift(), "v4": r.rolling(4).std().shift()})
        w = f.rolling(60, min_periods=15)
        ((f - w.mean()) / (w.std() + 1e-8)).dropna()


def q_oracle_dp():
    a = np.array([0.0, 0.5, 1.0, 1.25])
    change = UNIT * np.abs(a[None, :] - a[:, None])
    for ret in returns():
        value = np.zeros(4)
        for r in ret[::-1]:
            value = ((a - 1) * r + value - change).max(axis=1)


def q_asof_funding():
    e = table("events", ["event_type", "ts", "value"])
    f = e[e.event_type == "error"]
    f = f.groupby(f.ts.dt.floor("8h")).value.mean().rename("rate").reset_index()
    pd.merge_asof(bars_15m().sort_values("ts"), f, on="ts")


def q_lambda_return():
    e = table("events", ["user_id", "ts", "event_id", "value"]).sort_values(["user_id", "ts", "event_id"])
    symlog = lambda x: np.sign(x) * np.log1p(np.abs(x))
    for _, v in e.groupby("user_id").value:
        for x in v.to_numpy()[: len(v) // 8 * 8].reshape(-1, 8):
            g = symlog(x[-1] / 200)
            for y in x[::-1]:
                g = symlog(y / 100 - 0.5) + 0.99 * (0.05 * symlog(y / 200) + 0.95 * g)


def q_knn_anchor():
    v = np.stack(table("embeddings", ["embedding"]).embedding.to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    bank = v[np.linspace(0, len(v) - 1, 32, dtype=int)]
    np.sqrt(np.maximum(2 - 2 * v @ bank.T, 0)).argmin(axis=1)


def _tokens(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path(name))
    for text in table("documents", ["text"]).text:
        yield coder, coder.encode(text or "", add_special_tokens=False).ids


def op2_bpe():
    for coder, ids in _tokens("word_bpe_49k.json"):
        coder.decode(ids, skip_special_tokens=False)


def op3_token_counts():
    sum(len(ids) for _, ids in _tokens("byte_bpe_50k.json"))


if __name__ == "__main__":
    took = {}
    for name, run in [(k, v) for k, v in list(globals().items()) if k.startswith(("q_", "op"))]:
        if callable(run):
            began = time.time()
            run()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "plain_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF}))
