"""Independent DuckDB formulations of every registered query.

Written from the semantics (plain SQL: CASE, GROUP BY, conditional sums,
row_number, regr_*, brute-force cross products), not from the Spark plans,
so a shared mistake is unlikely. Building blocks are CTE strings composed
per query; the base tables are the generated star-schema views.
"""

from __future__ import annotations

from ..schema import CLASS_SOURCES, MEASURES, PANEL_KEYS, dollar_col, trade_col
from ..sources.starschema import (
    DTM_MODULUS, NO_MATURITY_EVERY, NO_STRIKE_EVERY, NO_VOLUME_EVERY, SEGMENT_CLASS, STOCK_EXCLUDED_BRANDS,
    STOCK_GAP_EVERY, STOCK_HIGH_EVERY, STOCK_HIGH_FACTOR,
)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _f(x: float) -> str:
    return repr(float(x)) + "::DOUBLE"


def _segments(cls: str) -> str:
    return _in([s for s, c in SEGMENT_CLASS.items() if c == cls])


def _vol(cls: str, side: str) -> str:
    flags = "('A', 'N')" if side == "buy" else "('R')"
    return (f"CASE WHEN c_mktsegment IN {_segments(cls)} THEN "
            f"(CASE WHEN l_returnflag IN {flags} AND l_orderkey % {NO_VOLUME_EVERY} <> 0 THEN l_quantity ELSE 0.0::DOUBLE END) "
            f"ELSE 0.0::DOUBLE END")


def option_month_cte() -> str:
    v = {(c, s): _vol(c, s) for c in ("customer_100", "customer_100_199", "customer_199",
                                      "professional", "firm") for s in ("buy", "sell")}
    cust = {s: f"({v[('customer_100', s)]}) + ({v[('customer_100_199', s)]}) + ({v[('customer_199', s)]})"
            for s in ("buy", "sell")}
    return f"""
option_month AS (
  SELECT
    CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
    p_brand AS ticker,
    CASE l_linestatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'P' END AS cp_flag,
    CAST(CASE WHEN l_orderkey % {NO_MATURITY_EVERY} = 0 THEN -1
         ELSE abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) % {DTM_MODULUS} END AS INTEGER) AS dtm,
    CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS forward_price,
    CASE WHEN p_partkey % {NO_STRIKE_EVERY} <> 0 THEN p_retailprice * 2.2::DOUBLE END AS strike_price,
    l_tax * 10.0::DOUBLE AS impl_volatility,
    CASE l_linestatus WHEN 'F' THEN l_discount * 10.0::DOUBLE
                      WHEN 'O' THEN -(l_discount * 10.0::DOUBLE) END AS delta,
    (CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END) * (1.0::DOUBLE - l_discount) AS best_bid,
    (CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END) * (1.0::DOUBLE + l_tax) AS best_offer,
    {cust['buy']} AS customer_open_buy_volume,
    {cust['sell']} AS customer_open_sell_volume,
    {v[('customer_100', 'buy')]} AS customer_open_buy_volume_100,
    {v[('customer_100', 'sell')]} AS customer_open_sell_volume_100,
    {v[('customer_100_199', 'buy')]} AS customer_open_buy_volume_100_199,
    {v[('customer_100_199', 'sell')]} AS customer_open_sell_volume_100_199,
    {v[('customer_199', 'buy')]} AS customer_open_buy_volume_199,
    {v[('customer_199', 'sell')]} AS customer_open_sell_volume_199,
    {v[('professional', 'buy')]} AS professional_customer_open_buy_volume,
    {v[('professional', 'sell')]} AS professional_customer_open_sell_volume,
    {v[('firm', 'buy')]} AS firm_open_buy_volume,
    {v[('firm', 'sell')]} AS firm_open_sell_volume
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
)"""


def stock_daily_cte() -> str:
    return f"""
stock_all AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         p_brand AS ticker,
         avg(CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END) AS avg_price,
         sum(l_quantity) AS shrout
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_brand NOT IN {_in(STOCK_EXCLUDED_BRANDS)}
  GROUP BY 1, 2
),
stock_daily AS (
  SELECT date, ticker, ticker AS comnam,
         avg_price * CASE WHEN turn % {STOCK_HIGH_EVERY} = 0 THEN {_f(STOCK_HIGH_FACTOR)} ELSE 1.0::DOUBLE END AS prc, shrout
  FROM (SELECT *, 12 * year(date) + month(date) + CAST(substr(ticker, 7) AS INTEGER) AS turn FROM stock_all)
  WHERE turn % {STOCK_GAP_EVERY} <> 0
)"""


def _rha(expr: str, decimals: int) -> str:
    """Round half away from zero on x * 10**d (DuckDB round on DOUBLE)."""
    if decimals == 0:
        return f"(round({expr}) + 0.0::DOUBLE)"
    m = float(10 ** decimals)
    return f"(round(({expr}) * {_f(m)}) / {_f(m)} + 0.0::DOUBLE)"


def classified_cte() -> str:
    fk = ("(CASE WHEN strike_price <> 0 THEN forward_price / strike_price "
          "WHEN strike_price = 0 AND forward_price > 0 THEN 'inf'::DOUBLE "
          "WHEN strike_price = 0 AND forward_price < 0 THEN '-inf'::DOUBLE END)")
    vols = []
    for cls, (buy, sell) in CLASS_SOURCES.items():
        vols.append(f"({buy} + {sell}) AS {trade_col(cls)}")
        vols.append(f"((best_offer + best_bid) / 2.0::DOUBLE) * ({buy} + {sell}) AS {dollar_col(cls)}")
    vols_sql = ",\n    ".join(vols)
    return f"""
classified AS (
  SELECT date, ticker,
    {_rha(fk, 1)} AS f_k,
    CASE WHEN {fk} > 0.975::DOUBLE AND {fk} < 1.025::DOUBLE THEN 'atm'
         WHEN {fk} <= 0.975::DOUBLE AND cp_flag = 'P' THEN 'itm'
         WHEN {fk} <= 0.975::DOUBLE AND cp_flag = 'C' THEN 'otm'
         WHEN {fk} >= 1.025::DOUBLE AND cp_flag = 'P' THEN 'otm'
         WHEN {fk} >= 1.025::DOUBLE AND cp_flag = 'C' THEN 'itm'
         ELSE 'nan' END AS f_k_moneyness,
    CASE WHEN dtm = 0 THEN '0_days'
         WHEN dtm > 0 AND dtm <= 7 THEN '1_7_days'
         WHEN dtm > 7 AND dtm <= 30 THEN '7_30_days'
         WHEN dtm > 30 AND dtm <= 90 THEN '30_90_days'
         WHEN dtm > 90 AND dtm <= 120 THEN '90_120_days'
         WHEN dtm > 120 THEN '120_days'
         ELSE 'nan' END AS maturity,
    cp_flag,
    {_rha('impl_volatility * 100.0::DOUBLE', 0)} AS impl_volatility,
    {_rha('delta * 100.0::DOUBLE', 0)} AS delta,
    {vols_sql}
  FROM option_month
  WHERE ticker IN (SELECT ticker FROM stock_daily)
)"""


def panel_cte() -> str:
    keys = ", ".join(PANEL_KEYS)
    sums = ",\n    ".join(f"coalesce(sum({m}), 0.0::DOUBLE) AS {m}" for m in MEASURES)
    return f"""
panel AS (
  SELECT {keys},
    {sums}
  FROM classified
  GROUP BY {keys}
  HAVING coalesce(sum(customer_trade_volume), 0) + coalesce(sum(professional_trade_volume), 0)
         + coalesce(sum(firm_trade_volume), 0) > 0
)"""


def base_ctes() -> list[str]:
    return [option_month_cte(), stock_daily_cte(), classified_cte(), panel_cte()]


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


# ---------------------------------------------------------------- stage C

def delta_moneyness_sql(d: str = "delta", cp: str = "cp_flag") -> str:
    return (f"CASE WHEN {d} > 45.0 AND {d} < 55.0 THEN 'atm' "
            f"WHEN {d} >= 55.0 AND {cp} = 'C' THEN 'itm' "
            f"WHEN {d} <= 45.0 AND {cp} = 'C' THEN 'otm' "
            f"WHEN {d} > -55.0 AND {d} < -45.0 THEN 'atm' "
            f"WHEN {d} <= -55.0 AND {cp} = 'P' THEN 'itm' "
            f"WHEN {d} >= -45.0 AND {cp} = 'P' THEN 'otm' ELSE 'nan' END")


def joined_cte() -> str:
    return f"""
joined AS (
  SELECT p.*, {delta_moneyness_sql('p.delta', 'p.cp_flag')} AS delta_moneyness,
         s.comnam, s.shrout * 1000.0::DOUBLE * s.prc AS mcap, s.prc
  FROM panel p LEFT JOIN stock_daily s ON p.date = s.date AND p.ticker = s.ticker
)"""


def _ln(expr: str) -> str:
    return f"(CASE WHEN ({expr}) > 0 THEN ln({expr}) END)"


def short_cte(maturities) -> str:
    prc_b = f"({_rha(_rha('prc', 0) + ' / 5.0::DOUBLE', 0)} * 5.0::DOUBLE)"
    mcap_b = _rha("mcap / 1e9::DOUBLE", 0)
    return f"""
short0 AS (
  SELECT * REPLACE ({prc_b} AS prc, {mcap_b} AS mcap)
  FROM joined
  WHERE maturity IN {_in(maturities)} AND cp_flag IN ('C', 'P') AND prc < 100000.0
    AND f_k_moneyness IN ('itm', 'otm')
),
short AS (
  SELECT *, {_ln('prc')} AS ln_prc, {_ln('mcap')} AS ln_mcap,
         {_ln('impl_volatility')} AS ln_impl_volatility
  FROM short0
)"""


def curve_ctes(x: str, classes, name: str = "curve") -> list[str]:
    unions = "\n    UNION ALL ".join(
        f"SELECT cp_flag, '{c}' AS investor, date, ticker, {x} AS x, f_k_moneyness, "
        f"{dollar_col(c)} AS volume FROM short" for c in classes)
    return [f"""
{name}_long AS (
    {unions}
)""", f"""
{name}_cell AS (
  SELECT cp_flag, investor, date, x, ticker,
         coalesce(sum(CASE WHEN f_k_moneyness = 'itm' THEN volume END), 0.0) AS itm,
         coalesce(sum(CASE WHEN f_k_moneyness = 'otm' THEN volume END), 0.0) AS otm
  FROM {name}_long GROUP BY ALL
)""", f"""
{name}_ticker AS (
  SELECT cp_flag, investor, ticker, x, avg((itm - otm) / (itm + otm)) AS itm_otm
  FROM {name}_cell WHERE itm + otm > 0 GROUP BY ALL
)""", f"""
{name} AS (
  SELECT cp_flag, investor, x, avg(itm_otm) AS itm_otm
  FROM {name}_ticker GROUP BY ALL
  HAVING x IS NOT NULL AND avg(itm_otm) IS NOT NULL
)"""]


__all__ = [
    "base_ctes", "with_ctes", "joined_cte", "short_cte", "curve_ctes", "delta_moneyness_sql",
    "option_month_cte", "stock_daily_cte", "classified_cte", "panel_cte",
]
