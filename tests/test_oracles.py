"""Every query with SQL gives what the SQL gives in DuckDB, at the smallest scale."""

import duckdb
import pytest

from barline import plans
from compare import TABLES, key

from .conftest import SF


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: One or two queries of each kind; compare.py runs all of them.
CHECKED = [
    "q_backtest_summary", "q_feature_matrix", "q_asof_funding", "q_oracle_dp", "q_transition_advantage", "q_lambda_return", "q_context",
    "q_controller_state", "q_smooth_aim", "q_overlay_chain", "q_edge_protected_chain", "q_low_frequency_overlay", "q_affine_overlay",
    "q_oracle_soft_labels", "q_route_targets", "q_class_report", "q_safe_routes", "q_selector_choice", "q_fold_table", "q_fire_danger_summary",
    "q_fire_candidates", "q_component_attribution", "q_differential_sharpe", "q_soft_executor", "q_reward_functionals", "q_reward_scale", "q_masked_losses",
    "q_ema", "q_min_hold", "q_transition_summary", "q_train_quantile_norm", "q_knn_anchor", "q_fingerprint", "q_rollout", "q_regime_path", "q_teacher_bundles",
    "q_risk_gated_chain", "q_vector_states", "q_path_windows", "q_context_means", "q_future_risk_targets", "q_composite", "q_extra_series", "q_funding_context",
]
#: Queries some of whose values end in a tie at this last digit at the smallest scale: one unit of it may differ.
LAST_DIGIT = {"q_extra_series": 6, "q_funding_context": 3}


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    cur = db.execute(plans.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    want = [tuple(v for _, v in sorted(zip(columns, r))) for r in cur.fetchall()]
    if name not in LAST_DIGIT:
        assert sorted(tuple(map(key, r)) for r in got) == sorted(tuple(map(key, r)) for r in want)
        return
    plain = lambda r: tuple(v for v in r if v is not None and not isinstance(v, float))
    got, want = sorted(got, key=plain), sorted(want, key=plain)
    assert [tuple(v is None for v in r) for r in got] == [tuple(v is None for v in r) for r in want] and list(map(plain, got)) == list(map(plain, want))
    assert all(abs(x - y) < 1.5 * 10 ** -LAST_DIGIT[name] for a, b in zip(got, want) for x, y in zip(a, b) if isinstance(x, float))


def test_every_query_has_a_plan(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
