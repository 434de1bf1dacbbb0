"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Names on the command line replace the headline set; `all` runs every query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "a01_hourly_sentiment", "a02_ohlcv_resample", "a08_vol_quantiles", "a09_regression_metrics", "a16_shrinkage",
    "a18_lag_diagnostic", "a19_correlation", "a25_trade_summary", "a34_median_impute", "a37_ridge_all_assets",
    "a38_buy_and_hold", "f01_lexicon_score", "feature_matrix", "j01_dataset", "j05_cross_asset", "j06_asof_macro",
    "j07_forward_align", "j14_first_touch", "j15_trade_paths", "p05_phrase_tags", "p24_trade_accounting", "s11_upsert",
    "w02_lagged_returns", "w06_rsi", "w07_macd", "w09_atr", "w10_regimes", "w17_normalised_targets", "w19_leakage_shift",
    "w21_sequences", "w24_latest_n", "w26_drawdown", "w27_cumulative_pnl", "w28_dedup_last", "w33_side_bias",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from barflow import session
    from barflow.plans import registry

    spark = session.build("bench", f"local[{cpus}]", int(cpus), memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or list(HEADLINE)
    if names == ["all"]:
        names = list(queries)

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("a02_ohlcv_resample")  # start-up of the JVM is not the query's
    times = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
