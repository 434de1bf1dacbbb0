"""Pieces of SQL shared by the comparison queries (DuckDB dialect)."""

from __future__ import annotations

WA = "PARTITION BY asset ORDER BY ts"

BARS_H = """b AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS ts,
         arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

BARS_D = """b AS (
  SELECT o_orderpriority AS asset, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
  FROM orders GROUP BY 1, 2)"""

# b with the one-bar log return, its percent change and its 0-based position
LR = f"""r AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS lr,
         close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1 AS pct,
         row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS k
  FROM b)"""

# r with vol_20 and the 20-bar mean return
VOL = """v AS (
  SELECT *, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END AS vol_20,
         CASE WHEN count(lr) OVER w = 20 THEN avg(lr) OVER w END AS mean_lr_20
  FROM r WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""

MACRO = """m AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS ts,
         avg(value) FILTER (event_type = 'view') AS dxy,
         avg(value) FILTER (event_type = 'click') AS vix,
         avg(value) FILTER (event_type = 'purchase') AS spy
  FROM events GROUP BY 1)"""

ARTICLES = """a AS (
  SELECT event_id, event_type AS asset, ts AS timestamp_utc,
         'u/' || user_id || '/' || strftime(ts, '%Y%m%d%H') AS url, event_type AS title,
         'd' || (user_id % 20) AS domain, 'c' || (user_id % 7) AS sourcecountry,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS sentiment_score,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive' WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS label,
         json_extract(props, '$.k')::INT / 100::DOUBLE AS confidence
  FROM events)"""

FORECASTS = """f0 AS (
  SELECT asset, ts, close, 0.1::DOUBLE * lr AS p, vol_20 AS vol,
         ln(lead(close, 4) OVER (PARTITION BY asset ORDER BY ts) / close) AS a
  FROM v),
f AS (SELECT * FROM f0 WHERE p IS NOT NULL AND a IS NOT NULL)"""

TRADES = """t AS (
  SELECT l_returnflag AS exit_reason, l_linestatus AS side, l_shipdate AS exit_time,
         l_extendedprice * (l_discount - l_tax) AS net_pnl, l_extendedprice AS notional_value,
         l_extendedprice * l_tax AS transaction_cost_total, l_quantity AS holding_bars,
         l_discount + 0.01::DOUBLE AS risk_reward_ratio,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""


def ts(c: str = "ts", name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


def rd(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(({c})::DOUBLE, {digits}) + 0.0 AS {name or c}"


def rds(*cols: str, digits: int = 6) -> str:
    return ", ".join(rd(c, digits=digits) for c in cols)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def frame(back: int, ahead: int = 0) -> str:
    end = "CURRENT ROW" if ahead == 0 else (f"{ahead} FOLLOWING" if ahead > 0 else f"{-ahead} PRECEDING")
    return f"OVER ({WA} ROWS BETWEEN {back} PRECEDING AND {end})"


def full(agg: str, c: str, n: int) -> str:
    """agg(c) over n rows if all are non-NULL."""
    return f"CASE WHEN count({c}) {frame(n - 1)} = {n} THEN {agg}({c}) {frame(n - 1)} END"
