"""Mini-table tests of the panel, the tables and the curves (FIXTURES.md section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tiltkit.operators import imbalance as imb
from tiltkit.operators import panel as pnl
from tiltkit.operators import tables as tb
from tiltkit.schema import MATURITIES, MEASURES, OPEN_VOLUME, OPTION_MONTH, RAW_VOLUME_COLS

D1, D2 = dt.date(2014, 1, 31), dt.date(2014, 2, 28)


def option_rows(spark, rows):
    base = {f.name: None for f in OPTION_MONTH.fields}
    base.update({c: 0.0 for c in RAW_VOLUME_COLS})
    base.update(dict(dtm=10, forward_price=100.0, strike_price=100.0, impl_volatility=0.3, delta=0.5,
                     best_bid=1.0, best_offer=3.0))
    out = []
    for r in rows:
        b = dict(base)
        b.update(r)
        out.append(tuple(b[f.name] for f in OPTION_MONTH.fields))
    return spark.createDataFrame(out, OPTION_MONTH)


def test_panel_small(spark):
    rows = [
        # AAA month 1: two rows in one 8-key group
        dict(date=D1, ticker="AAA", cp_flag="C", customer_open_buy_volume=2.0, customer_open_sell_volume=1.0,
             customer_open_buy_volume_100=2.0, firm_open_buy_volume=4.0),
        dict(date=D1, ticker="AAA", cp_flag="C", customer_open_buy_volume=1.0,
             customer_open_buy_volume_100=1.0),
        # zero-volume group: dropped by HAVING
        dict(date=D1, ticker="AAA", cp_flag="P", dtm=200),
        # month 2
        dict(date=D2, ticker="BBB", cp_flag="P", professional_customer_open_sell_volume=5.0,
             forward_price=90.0),
        # outside the universe
        dict(date=D2, ticker="ZZZ", cp_flag="C", firm_open_sell_volume=9.0),
    ]
    opts = option_rows(spark, rows)
    universe = spark.createDataFrame([("AAA",), ("BBB",), ("AAA",)], "ticker string")
    out = {(r.date, r.ticker, r.cp_flag): r for r in pnl.yearly_panel(opts, universe).collect()}
    assert set(out) == {(D1, "AAA", "C"), (D2, "BBB", "P")}
    a = out[(D1, "AAA", "C")]
    assert a.customer_trade_volume == 4.0 and a.customer_100_trade_volume == 3.0
    assert a.firm_trade_volume == 4.0 and a.firm_dollar_trade_volume == 8.0  # mid 2 x 4
    assert a.f_k == 1.0 and a.f_k_moneyness == "atm" and a.maturity == "7_30_days"
    assert a.impl_volatility == 30.0 and a.delta == 50.0
    b = out[(D2, "BBB", "P")]
    assert b.f_k == 0.9 and b.f_k_moneyness == "itm" and b.professional_trade_volume == 5.0
    # union of months == per-month panels unioned
    per_month = pnl.yearly_panel(opts.where(F.col("date") == D1), universe).unionByName(
        pnl.yearly_panel(opts.where(F.col("date") == D2), universe))
    assert sorted(map(tuple, per_month.collect())) == sorted(map(tuple, pnl.yearly_panel(opts, universe).collect()))


def panel_rows(spark, rows):
    base = {f.name: None for f in OPEN_VOLUME.fields}
    base.update({m: 0.0 for m in MEASURES})
    base.update(dict(f_k=1.0, maturity="1_7_days", impl_volatility=30.0, delta=50.0))
    out = []
    for r in rows:
        b = dict(base)
        b.update(r)
        out.append(tuple(b[f.name] for f in OPEN_VOLUME.fields))
    return spark.createDataFrame(out, OPEN_VOLUME)


def test_shares_small(spark):
    m = "firm_dollar_trade_volume"
    rows = [
        dict(date=D1, ticker="A", f_k_moneyness="itm", cp_flag="C", **{m: 3.0}),
        dict(date=D1, ticker="B", f_k_moneyness="otm", cp_flag="C", **{m: 1.0}),
        dict(date=D1, ticker="A", f_k_moneyness="atm", cp_flag="C", **{m: 0.0}),
        dict(date=D1, ticker="A", f_k_moneyness="nan", cp_flag="C", **{m: 4.0}),
        dict(date=D2, ticker="A", f_k_moneyness="itm", cp_flag="C", **{m: 0.0}),  # all-zero day
        dict(date=D2, ticker="A", f_k_moneyness="otm", cp_flag="C", **{m: 0.0}),
    ]
    sh = tb.moneyness_share_daily(panel_rows(spark, rows))
    got = {(r.date, r.f_k_moneyness): r[f"{m}_f_k_pct"] for r in sh.collect()}
    assert got[(D1, "itm")] == pytest.approx(3 / 8) and got[(D1, "nan")] == pytest.approx(0.5)
    assert got[(D2, "itm")] is None and got[(D2, "otm")] is None
    # shares of a (date, flag) sum to 1 when the total is positive
    tot = sh.groupBy("date").agg(F.sum(f"{m}_f_k_pct").alias("s")).collect()
    assert {r.date: r.s for r in tot}[D1] == pytest.approx(1.0)
    assert [r.Year for r in sh.collect()][0] == "2014"


def test_distribution_share_includes_nan_group(spark):
    m = "firm_dollar_trade_volume"
    rows = [dict(date=D1, ticker="A", f_k_moneyness=k, cp_flag="C", **{m: v})
            for k, v in (("itm", 1.0), ("itm", 3.0), ("otm", 2.0), ("nan", 4.0), ("atm", 0.0))]
    daily = tb.daily_totals(panel_rows(spark, rows), factor=1.0)
    dist = {(r.investor, r.f_k_moneyness): r for r in tb.volume_distribution(daily).collect()}
    assert ("firm", "nan") not in dist and ("firm", "atm") not in dist  # zero values filtered
    itm = dist[("firm", "itm")]
    assert itm.n == 1 and itm.total == 4.0 and itm.share_pct == pytest.approx(40.0)
    assert dist[("firm", "otm")].share_pct == pytest.approx(20.0)


def test_pivot_gaps_and_imbalance(spark):
    # ticker X only itm, Y only otm, W neither (atm only) -> dropped
    m = "customer_100_dollar_trade_volume"
    rows = [dict(date=D1, ticker="X", f_k_moneyness="itm", cp_flag="C", x=1.0, **{m: 5.0}),
            dict(date=D1, ticker="Y", f_k_moneyness="otm", cp_flag="C", x=1.0, **{m: 5.0}),
            dict(date=D2, ticker="Y", f_k_moneyness="otm", cp_flag="C", x=1.0, **{m: 1.0}),
            dict(date=D2, ticker="Y", f_k_moneyness="itm", cp_flag="C", x=1.0, **{m: 3.0}),
            dict(date=D1, ticker="W", f_k_moneyness="atm", cp_flag="C", x=2.0, **{m: 5.0}),
            dict(date=D1, ticker="V", f_k_moneyness="itm", cp_flag="C", x=None, **{m: 5.0})]
    df = spark.createDataFrame([(r["date"], r["ticker"], r["f_k_moneyness"], r["cp_flag"], r["x"], r[m])
                                for r in rows],
                               f"date date, ticker string, f_k_moneyness string, cp_flag string, x double, {m} double")
    cur = imb.imbalance_curve(df, "x", {"customer_100": m}).collect()
    assert len(cur) == 1
    # X: +1; Y: mean(-1, 0.5) = -0.25; mean over tickers (unweighted) = 0.375
    assert cur[0].x == 1.0 and cur[0].itm_otm == pytest.approx(0.375)
    for r in imb.imbalance_by_ticker(df, "x", [m]).collect():
        assert -1.0 <= r.itm_otm <= 1.0


def test_maturity_missing_domain(spark):
    m = "firm_trade_volume"
    rows = [dict(date=D1, ticker="A", maturity="1_7_days", f_k_moneyness="itm", cp_flag="C", **{m: 2.0}),
            dict(date=D2, ticker="A", maturity="1_7_days", f_k_moneyness="itm", cp_flag="C", **{m: 4.0}),
            dict(date=D1, ticker="A", maturity="nan", f_k_moneyness="otm", cp_flag="C", **{m: 9.0})]
    mt = tb.maturity_table(panel_rows(spark, rows), classes=("firm",))
    got = [r for r in mt.where((F.col("measure") == m) & (F.col("cp_flag") == "C"))
           .orderBy("maturity_order").collect()]
    assert [r.maturity for r in got] == list(MATURITIES)  # 0_days present, 'nan' absent
    assert got[1].itm == 3.0 and got[1].otm is None
    assert all(r.itm is None for i, r in enumerate(got) if i != 1)


def test_stock_join_keeps_misses(spark):
    p = panel_rows(spark, [dict(date=D1, ticker="A", f_k_moneyness="itm", cp_flag="C"),
                           dict(date=D1, ticker="B", f_k_moneyness="itm", cp_flag="C")])
    s = spark.createDataFrame([(D1, "A", "A Inc", 10.0, 2.0)], "date date, ticker string, comnam string, prc double, shrout double")
    j = {r.ticker: r for r in imb.join_stock_panel(p, s).collect()}
    assert j["A"].mcap == 20000.0 and j["B"].prc is None
    assert imb.duplicate_keys(s).count() == 0
    short = imb.short_dated(imb.with_delta_moneyness(imb.join_stock_panel(p, s)))
    rows = short.collect()
    assert [r.ticker for r in rows] == ["A"] and rows[0].prc == 10.0 and rows[0].mcap == 0.0
    assert rows[0].ln_mcap is None
