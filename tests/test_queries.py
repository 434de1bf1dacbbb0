"""Every registered query against its SQL; those over ordered series also in blocks."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from barflow import session
from compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
IN_BLOCKS = (
    "a08_vol_quantiles", "a16_shrinkage", "a18_lag_diagnostic", "a19_correlation", "a34_median_impute", "a38_buy_and_hold",
    "feature_matrix", "j05_cross_asset", "j06_asof_macro", "j07_forward_align", "j08_last_headlines", "j14_first_touch",
    "j15_trade_paths", "r04_stream_smoothed", "w02_lagged_returns", "w06_rsi", "w07_macd", "w09_atr", "w12_forward_fill",
    "w14_every_nth", "w15_news_carry", "w19_leakage_shift", "w20_chronological_split", "w21_sequences", "w24_latest_n",
    "w26_drawdown", "w27_cumulative_pnl", "w33_side_bias", "a21_news_volume_6h",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(name, spark, duck):
    message = compare(spark, duck, QUERIES[name], ORACLE[name], SF)
    assert message is None, message


@pytest.mark.parametrize("name", IN_BLOCKS)
def test_query_in_blocks(name, spark, duck):
    spark.conf.set(session.SINGLE_TASK_BYTES[0], "-1")
    spark.conf.set(session.BLOCK_ROWS[0], "61")
    try:
        message = compare(spark, duck, QUERIES[name], ORACLE[name], SF)
    finally:
        for option, _ in (session.SINGLE_TASK_BYTES, session.BLOCK_ROWS):
            spark.conf.unset(option)
    assert message is None, message


def test_every_sql_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


def test_without_sql(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"asset", "ts", "rsi_14", "ret_4h"} <= set(df.columns)
