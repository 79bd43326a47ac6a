"""Queries on trailing state, overlays, soft labels, routes, stress and control targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.frames import ordered, round_to
from barline.operators import chunks, diagnostics, folds, labels, scans, teachers
from barline.plans.paths import _BEST, _REC, _TARGETS, _VALUES, ORACLES as PATHS, W, _advantage, _targets, rows
from barline.plans.views import EXPANDED, FOLDS, RETS, ROWS, UNIT
from barline.sources import bars


def q_trailing_state(spark, sf):
    return round_to(teachers.add_trailing_state(rows(spark, sf), 8, 16, 16).select("sym", "ts", "trend", "depth", "past_vol"), 8)


def _slow(spark, sf):
    df = rows(spark, sf).withColumns({"risk": F.abs("ret") * 100, "edge": F.col("ret") * 100})
    return teachers.add_trailing_state(teachers.smoothed(df, ("risk", "edge"), 16), 8, 16, 16)


def q_low_frequency_overlay(spark, sf):
    df = teachers.low_frequency_overlay(_slow(spark, sf), hold=5, dead=0.01, risk_hi=0.35, risk_lo=0.3, trend_max=0.01, trend_min=-0.01, edge_hi=-0.05, edge_lo=0.05, depth_max=0.03, base=0.01, down=0.04, up=0.03)
    return round_to(df.select("sym", "ts", "overlay"))


def q_affine_overlay(spark, sf):
    over = teachers.affine_overlay(0.01, 0.05, 0.02, 0.03, 0.4, 0.2, centre=0.2)
    return round_to(_slow(spark, sf).withColumn("utility", F.col("edge_slow") - F.col("risk_slow")).select("sym", "ts", over.alias("overlay")))


def q_risk_budget_overlay(spark, sf):
    over = teachers.risk_budget_overlay(F.abs("ret") * 100, 0.4, 3.0, 0.1, 0.02, 0.05, 0.1)
    return round_to(rows(spark, sf).select("sym", "ts", over.alias("overlay")))


def _chain(spark, sf):
    return chunks.overlay_chain(_targets(spark, sf).withColumn("edge", F.col("ret") * 100), edge="edge", centre=0.1, scale=2.0, down_cut=0.5, up_add=0.02)


def q_edge_protected_chain(spark, sf):
    return round_to(_chain(spark, sf).select("sym", "ts", "position"))


def q_overlay_report(spark, sf):
    return round_to(teachers.describe_overlay(_chain(spark, sf), "target", "position"))


def q_oracle_soft_labels(spark, sf):
    ahead = [f"v{i}" for i in range(4)]
    df = chunks.hindsight(rows(spark, sf).select("sym", "ts", "ret"), ahead=ahead, bench=1.0)
    df = df.withColumn("prev", F.lag("best", 1, 0.0).over(ordered())).withColumn("ahead", F.array(*ahead))
    soft = teachers.soft_labels(df, "prev", "ahead", bench=1.0, temperature=0.5)
    return round_to(soft.select("sym", "ts", *(F.col("soft")[i].alias(f"p{i}") for i in range(4))), 5)


def q_bad_underweight(spark, sf):
    df = teachers.relabel_bad_underweights(labels.outcome_edge(rows(spark, sf), "pos"))
    return round_to(df.select("sym", "ts", "pos", "relabelled"))


def q_normalised_stress(spark, sf):
    rets = bars.returns_1d(spark, sf)
    df = folds.expand(rets, folds.bar_splits(rets)).withColumn("stress", F.greatest(F.lit(0.0), F.abs("ret") * 100 - 0.2))
    return round_to(teachers.normalised_stress(df, "stress").where("role <> 'train'").select("sym", "fold", "role", "ts", "stress_share"), 5)


def _routes(spark, sf):
    return teachers.route_targets(rows(spark, sf), margin=0.0005, penalties=(0.0, 0.0001, 0.0, 0.0002))


def q_route_targets(spark, sf):
    return round_to(_routes(spark, sf).select("sym", "ts", "route", "route_advantage", *(F.col("soft")[i].alias(f"soft{i}") for i in range(4))))


def q_route_report(spark, sf):
    return round_to(teachers.route_report(_routes(spark, sf)), 7)


def q_class_report(spark, sf):
    """Bars whose horizons are all known: the last of each symbol have no advantage to report."""
    return round_to(teachers.class_report(_advantage(spark, sf).where("values[2] is not null")))


def q_safe_routes(spark, sf):
    df = diagnostics.controller_state(rows(spark, sf), cooldown=16)
    x = F.col("ret") * 100
    shares = teachers.safe_routes(F.array(F.lit(0.5), x, -x, x / 2), F.col("over"), F.col("under_age"), F.col("cooldown"), least_age=0.03, least_share=0.45)
    to = teachers.route_overlays(F.col("over"))
    return round_to(df.select("sym", "ts", shares.alias("p"), to.alias("t")).select("sym", "ts", *(F.col("p")[i].alias(f"p{i}") for i in range(4)), *(F.col("t")[i].alias(f"t{i}") for i in range(1, 4))))


def q_future_control(spark, sf):
    return round_to(labels.future_control(rows(spark, sf), 4, scale=100.0).select("sym", "ts", "overweight_4", "recovery_4"), 5)


def q_utility_allocator(spark, sf):
    x = F.col("ret") * 100
    return round_to(rows(spark, sf).select("sym", "ts", labels.utility_allocator(F.array(F.lit(0.1), -x, x / 2, x - 0.2)).alias("action")))


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q_")}

_P = "(PARTITION BY sym ORDER BY ts ROWS"
_STATE = f"l0 AS (SELECT *, coalesce(lag(ret) OVER {W}, 0.0) AS x FROM rows), l1 AS (SELECT *, sum(x) OVER {_P} UNBOUNDED PRECEDING) AS path FROM l0), st AS (SELECT *, sum(x) OVER {_P} 7 PRECEDING) AS trend, max(path) OVER {_P} 15 PRECEDING) - path AS depth, coalesce(stddev_pop(ret) OVER {_P} BETWEEN 16 PRECEDING AND 1 PRECEDING), 0) AS past_vol, row_number() OVER {W} AS n FROM l1)"
_SLOW = f"{_REC}, {_STATE}, sm AS MATERIALIZED (SELECT *, abs(ret) * 100 AS risk, ret * 100 AS edge FROM st), e AS (SELECT sym, n, risk AS rs, edge AS es FROM sm WHERE n = 1 UNION ALL SELECT m.sym, m.n, e.rs + (m.risk - e.rs) * 2 / 17, e.es + (m.edge - e.es) * 2 / 17 FROM e JOIN sm m ON m.sym = e.sym AND m.n = e.n + 1), sl AS MATERIALIZED (SELECT sm.*, rs, es FROM sm JOIN e USING (sym, n))"
_SIGMOID = "(1 / (1 + exp(-greatest(-30, least(30, {x})))))"


def chain_sql(over: str) -> str:
    """Stages of the overlay chain, each a fold over the rows in order."""
    return f"""{_TARGETS}, c0 AS MATERIALIZED (SELECT *, greatest(-0.5, least(0.12, {over})) AS o FROM tg),
c1 AS (SELECT sym, ts, n, o AS m FROM c0 WHERE n = 1 UNION ALL SELECT t.sym, t.ts, t.n, c1.m + 0.2 * (t.o - c1.m) FROM c1 JOIN c0 t ON t.sym = c1.sym AND t.n = c1.n + 1), c1m AS MATERIALIZED (SELECT * FROM c1),
c2 AS (SELECT sym, ts, n, m AS h FROM c1m WHERE n = 1 UNION ALL SELECT t.sym, t.ts, t.n, CASE WHEN abs(t.m - c2.h) >= 0.02 THEN t.m ELSE c2.h END FROM c2 JOIN c1m t ON t.sym = c2.sym AND t.n = c2.n + 1), c2m AS MATERIALIZED (SELECT sym, ts, n, CASE WHEN abs(h) < 0.01 THEN 0 ELSE h END AS h FROM c2),
c3 AS (SELECT sym, ts, n, greatest(-0.05, least(0.05, h)) AS p FROM c2m WHERE n = 1 UNION ALL SELECT t.sym, t.ts, t.n, c3.p + greatest(-0.05, least(0.05, t.h - c3.p)) FROM c3 JOIN c2m t ON t.sym = c3.sym AND t.n = c3.n + 1),
chain AS (SELECT c3.sym, c3.ts, target, 1 + p AS position FROM c3 JOIN tg USING (sym, n))"""


_GATE = _SIGMOID.format(x="(ret * 100 - 0.1) * 2")
_OVER = f"CASE WHEN target < 1 THEN CASE WHEN (target - 1) * (1 - 0.5 * {_GATE}) >= 0 THEN (target - 1) * (1 - 0.5 * {_GATE}) + 0.02 * {_GATE} ELSE (target - 1) * (1 - 0.5 * {_GATE}) END ELSE target - 1 + 0.02 * {_GATE} END"
_ROUTES = f"""{ROWS}, {_VALUES}, r0 AS (SELECT *, CASE WHEN pos = 0.5 THEN a1 ELSE a2 END AS cur FROM ta), r1 AS (SELECT *, {', '.join(f'greatest(a{i} - a2, a{i} - cur) AS g{i}' for i in range(4))} FROM r0),
r2 AS (SELECT *, CASE WHEN a2 IS NOT NULL THEN greatest(g0, g1, 0) - 0.0001 END AS s1, CASE WHEN a2 IS NOT NULL AND pos < 1 THEN greatest(g2, 0) END AS s2, CASE WHEN a2 IS NOT NULL THEN greatest(g3, 0) - 0.0002 END AS s3 FROM r1),
r3 AS (SELECT *, greatest(coalesce(s1, -1e300), coalesce(s2, -1e300), coalesce(s3, -1e300)) AS best FROM r2),
r4 AS (SELECT *, CASE WHEN best > 0.0005 THEN CASE WHEN s1 = best THEN 1 WHEN s2 = best THEN 2 ELSE 3 END ELSE 0 END::INT AS route, CASE WHEN best > 0.0005 THEN best ELSE 0 END AS route_advantage,
 {', '.join(f'exp(greatest(-60, least(60, CASE WHEN s{i} > 0.0005 THEN s{i} ELSE -1e300 END / 0.001)))' + f' AS w{i}' for i in (1, 2, 3))} FROM r3),
r5 AS (SELECT *, 1 + w1 + w2 + w3 AS w FROM r4)"""
_SAFE = f"""{PATHS['q_controller_state'].split(' SELECT sym, ts, round("over"')[0]}, k AS (SELECT *, CASE WHEN low THEN least(row_number() OVER (PARTITION BY sym, u ORDER BY ts) / 64, 1) ELSE 0 END AS age, coalesce(greatest(0.25 - (n - rise) / 64, 0), 0) AS cool FROM h),
k1 AS (SELECT k.*, ret * 100 AS x, ("over" < -0.05 AND age >= 0.03 OR cool > 0) AS lowst FROM k JOIN rows USING (sym, ts)),
k2 AS (SELECT *, exp(0.5) AS e0, exp(x - CASE WHEN lowst THEN 8 ELSE 0 END) AS e1, exp(-x + CASE WHEN lowst THEN 2 ELSE 0 END) AS e2, exp(x / 2) AS e3 FROM k1),
k3 AS (SELECT *, e0 + e1 + e2 + e3 AS e, greatest(e0, e1, e2, e3) AS m FROM k2), k4 AS (SELECT *, m > e0 AND m / e < 0.45 AS weak FROM k3)"""

ORACLES = {
    "q_trailing_state": f"{ROWS}, {_STATE} SELECT sym, ts, round(trend, 8) AS trend, round(depth, 8) AS depth, round(past_vol, 8) AS past_vol FROM st",
    "q_low_frequency_overlay": f"""{_SLOW}, raw AS MATERIALIZED (SELECT sym, ts, n, CASE WHEN rs <= 0.3 AND trend >= -0.01 AND depth <= 0.03 AND es >= -0.05 THEN 0.04 WHEN rs >= 0.35 AND trend <= 0.01 AND depth >= 0 AND es <= 0.05 THEN -0.03 ELSE 0.01 END::DOUBLE AS o FROM sl),
h AS (SELECT DISTINCT sym, NULL::TIMESTAMP AS ts, 0::BIGINT AS n, 0.0::DOUBLE AS p, 5 AS idle FROM raw UNION ALL SELECT sym, ts, n, np, CASE WHEN abs(np - p) <= 1e-8 THEN idle + 1 ELSE 0 END FROM (SELECT r.sym, r.ts, r.n, h.p, h.idle, CASE WHEN h.idle < 5 AND abs(r.o - h.p) > 0.01 THEN h.p ELSE r.o END AS np FROM h JOIN raw r ON r.sym = h.sym AND r.n = h.n + 1)) SELECT sym, ts, round(p, 6) AS overlay FROM h WHERE n > 0""",
    "q_affine_overlay": f"{_SLOW} SELECT sym, ts, round(0.01 + 0.02 * es + 0.03 * (es - rs) + 0.2 * greatest(trend, 0) - 0.05 * greatest(rs - 0.2, 0) * {_SIGMOID.format(x='-3 * es')} - 0.4 * greatest(-trend, 0), 6) AS overlay FROM sl",
    "q_risk_budget_overlay": f"{ROWS}, g AS (SELECT sym, ts, 0.1 + 0.9 * {_SIGMOID.format(x='(abs(ret) * 100 - 0.4) * 3')} AS g FROM rows) SELECT sym, ts, round(0.02 + 0.05 * (1 - g) - 0.1 * g, 6) AS overlay FROM g",
    "q_overlay_chain": f"{_REC}, {chain_sql('target - 1')} SELECT sym, ts, round(position, 6) AS position FROM chain",
    "q_edge_protected_chain": f"{_REC}, {chain_sql(_OVER)} SELECT sym, ts, round(position, 6) AS position FROM chain",
    "q_overlay_report": f"{_REC}, {chain_sql(_OVER)}, o AS (SELECT sym, position - 1 AS o, abs(position - target) > 1e-6 AS moved FROM chain) SELECT sym, round(avg(o), 6) AS mean, round(quantile_cont(o, 0.1), 6) AS p10, round(quantile_cont(o, 0.5), 6) AS p50, round(quantile_cont(o, 0.9), 6) AS p90, round(avg((abs(o) > 1e-6)::DOUBLE), 6) AS active, round(avg((abs(o) > 0.05)::DOUBLE), 6) AS active_05, round(avg(moved::DOUBLE), 6) AS remapped FROM o GROUP BY sym",
    "q_oracle_soft_labels": PATHS["q_oracle_dp"].rpartition("SELECT sym, ts, [0.0")[0]
    + f""", b AS (SELECT f.sym, f.ts, f.k, m.n, m.ret, [0.0, 0.5, 1.0, 1.25][f.s]::DOUBLE AS best FROM f JOIN m USING (sym, k)), b1 AS (SELECT *, lag(best, 1, 0.0::DOUBLE) OVER {W} AS prev FROM b),
q AS (SELECT b1.sym, b1.ts, list_transform([0.0, 0.5, 1.0, 1.25]::DOUBLE[], lambda a, i: (a - 1) * ret - {UNIT} * abs(a - prev) + v.val[i]) AS q FROM b1 JOIN v ON v.sym = b1.sym AND v.n = b1.n - 1),
a AS (SELECT sym, ts, list_transform(q, lambda x: x - list_max(q)) AS a FROM q), s AS (SELECT sym, ts, a, sqrt(list_avg(list_transform(a, lambda x: pow(x - list_avg(a), 2)))) AS d FROM a),
e AS (SELECT sym, ts, list_transform(a, lambda x: exp(x / (d + 1e-8) / 0.5)) AS e FROM s) SELECT sym, ts, {', '.join(f'round(e[{i + 1}] / list_sum(e), 5) AS p{i}' for i in range(4))} FROM e""",
    "q_normalised_stress": f"{RETS}, {FOLDS}, {EXPANDED}, s AS (SELECT *, greatest(0, abs(ret) * 100 - 0.2) AS s FROM fr), q AS (SELECT sym, fold, quantile_cont(s, 0.5) FILTER (role = 'train' AND s > 0) AS a, quantile_cont(s, 0.9) FILTER (role = 'train' AND s > 0) AS b FROM s GROUP BY ALL) SELECT sym, fold, role, ts, round(greatest(0, least(1, (s - coalesce(a, 0)) / coalesce(greatest(b - a, 1e-6), 1))), 5) AS stress_share FROM s JOIN q USING (sym, fold) WHERE role <> 'train'",
    "q_route_targets": f"{_ROUTES} SELECT sym, ts, route, round(route_advantage, 6) AS route_advantage, round(0.95 / w + 0.0125, 6) AS soft0, {', '.join(f'round(0.95 * w{i} / w + 0.0125, 6) AS soft{i}' for i in (1, 2, 3))} FROM r5",
    "q_route_report": f"{_ROUTES}, q AS (SELECT route, quantile_cont(route_advantage, 0.9) AS q FROM r5 GROUP BY 1), g AS (SELECT route, count(*) AS n, avg(route_advantage) AS mean_adv, avg(route_advantage) FILTER (route_advantage >= q) AS top_adv FROM r5 JOIN q USING (route) GROUP BY 1), s AS (SELECT 0 AS route, 0.0::DOUBLE AS m {' '.join(f'UNION ALL SELECT {i}, (SELECT avg(s{i}) FROM r5)' for i in (1, 2, 3))}) SELECT s.route::INT AS route, coalesce(n, 0::BIGINT) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM r5), 7) AS rate, round(coalesce(mean_adv, 0), 7) AS mean_adv, round(coalesce(top_adv, 0), 7) AS top_adv, round(m, 7) AS mean_score FROM s LEFT JOIN g ON g.route = s.route",
    "q_class_report": f"{ROWS}, {_VALUES}, {_BEST}, l AS (SELECT best_class, best_advantage AS v FROM te WHERE a2 IS NOT NULL), q AS (SELECT best_class, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.9) AS c FROM l GROUP BY 1), g AS (SELECT best_class, b AS median, count(*) AS n, avg(v) AS mean, avg(v) FILTER (v >= c) AS top_mean, avg(v) FILTER (v <= a) AS bottom_mean, avg((v > 0)::DOUBLE) AS positive_rate FROM l JOIN q USING (best_class) GROUP BY best_class, b) SELECT best_class, n, round(median, 6) AS median, round(mean, 6) AS mean, round(top_mean, 6) AS top_mean, round(bottom_mean, 6) AS bottom_mean, round(positive_rate, 6) AS positive_rate, round(n / sum(n) OVER (), 6) AS rate FROM g",
    "q_safe_routes": f"{_SAFE} SELECT sym, ts, {', '.join(f'round(CASE WHEN weak THEN {float(i == 0)} ELSE e{i} / e END, 6) AS p{i}' for i in range(4))}, round(greatest(\"over\" - 0.1, -0.5), 6) AS t1, round(greatest(-0.5, least(0.12, \"over\" + greatest(-0.1, least(0.1, -\"over\")))), 6) AS t2, round(least(\"over\" + 0.1, 0.12), 6) AS t3 FROM k4",
    "q_future_control": f"{ROWS}, u AS (SELECT sym, ts, {', '.join(f'lead(ret, {k}) OVER {W} AS r{k}' for k in (1, 2, 3, 4))} FROM rows), w AS (SELECT *, r1 + r2 + r3 + r4 AS c, -least(0, r1, r1 + r2, r1 + r2 + r3, r1 + r2 + r3 + r4) AS d, sqrt((r1 * r1 + r2 * r2 + r3 * r3 + r4 * r4) / 4 + 1e-12) AS v FROM u) SELECT sym, ts, round(CASE WHEN r4 IS NOT NULL THEN (0.1 * c - 0.1 * d - {UNIT} * 0.1) * 100 END, 5) AS overweight_4, round(CASE WHEN r4 IS NOT NULL THEN greatest(-5, least(5, (c - d) / (v * 2 + 1e-6))) / 5 END, 5) AS recovery_4 FROM w",
    "q_utility_allocator": f"{ROWS}, u AS (SELECT sym, ts, [0.1, -100 * ret, 50 * ret, 100 * ret - 0.2] AS u FROM rows) SELECT sym, ts, [0.0, 0.5, 1.0, 1.25][list_position(u, list_max(u))]::DOUBLE AS action FROM u",
}
_EDGE = PATHS["q_outcome_edge"].replace(" SELECT sym, ts, round(greatest(", ", oe AS (SELECT sym, ts, pos, greatest(", 1).replace(", 6) AS edge FROM rows", " AS edge FROM rows)")
ORACLES["q_bad_underweight"] = f"{_EDGE}, q AS (SELECT sym, coalesce(quantile_cont(edge, 0.25) FILTER (edge > 0), 0) AS q FROM oe GROUP BY sym) SELECT sym, ts, pos, CASE WHEN pos < 1 - 1e-6 AND edge <= q THEN 1.0 ELSE pos END::DOUBLE AS relabelled FROM oe JOIN q USING (sym)"
