"""Registered queries against their SQL in DuckDB, on the smallest tables. BARWEAVE_ALL=1 runs every one."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from barweave.plans import catalogue, catalogue_live, catalogue_rules, catalogue_studies  # noqa: F401
from barweave.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = (
    "s1_tidy_bars s2_parse_klines s4_funding_by_hour s6_incremental_append r1_resample r2_rollup_ladder r3_resample_last r5_asof_join r10_calendar_sample r13_date_gaps r14_freshness r15_fingerprint f1_f6_core_features f7_f10_streaks "
    "f9_session_streak f11_candles f14_double_extremes f22_kgram chunked_features p2_p14_discretize p5_p7_changes p15_folds m1_mine_rules m2_votes m7_evaluate m10_stability q2_reversion_index q7_conviction_tier q12_micro_macro "
    "n3_funding_carry a5_return_stats a6_min_hold a7_thesis_hold q18_rule_catalog q19_rule_replay a9_expanding_oracle a10_rank_portfolio a11_hold_cycles w1_stream_bars w6_feed_sessions w1_live_bars w2_live_log w3_live_scores w4_live_cycles w6_live_sessions"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    flat = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(flat, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("BARWEAVE_ALL") else SOME)
def test_same_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_names_and_columns(spark, duck):
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100
