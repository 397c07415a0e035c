"""Queries against their SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from tickloom.plans import catalog

#: One of each family here; the driver compares all.
NAMES = [
    "feat_rsi14", "feat_macd_hist", "feat_aroon_osc_25", "feat_ret_entropy_20", "feat_cs_rank_ret5", "factor_op_winsorize", "factor_op_ema_5", "factor_op_product_5", "formula_nested", "ohlcv_bars", "bars_valid", "bars_diff_sync", "upsert_last_wins", "keep_latest",
    "bt_cost_stress", "bt_trades", "bt_trade_stats", "bt_subperiods", "rank_ic", "wf_folds", "reward", "indicators", "touch_outcomes", "volume_profile", "auc_brier", "clean_html", "canonical_url", "theme_heat", "disc_rank", "disc_states", "merge_leads", "source_chart_arrays", "dag_levels", "stream_bars", "stream_flip_events", "pa_directions", "pa_breakout_events", "risk_gate", "misfires_fire_once", "misfires_catch_up", "percentile_score", "pa_hl_legs", "pa_hl_count", "cron_next_fire", "known_at", "nearest_level", "disc_transitions", "timeframe_seconds", "bt_t_plus_one", "event_uuid", "cluster_events", "symbol_leads", "disc_features", "mtf_summary", "mtf_decision", "neighbour_timeframes", "text_probabilities", "user_filter",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    f, sql = catalog.load()[name]
    df = f(spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall())
    assert got == want and got
