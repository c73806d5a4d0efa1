"""The three study entry points on files written from the generated tables."""

from pyspark.sql import functions as F

from tiltkit.plans import jobs
from tiltkit.sources import io
from tiltkit.sources import starschema as ss

from .conftest import SF001


def test_entry_points(spark, tmp_path):
    opts = ss.option_month(spark, SF001)
    stock = ss.stock_daily(spark, SF001)
    months = [r.date for r in opts.select("date").distinct().orderBy("date").limit(2).collect()]
    paths = []
    for m in months:
        p = str(tmp_path / f"opt_{m}.parquet")
        opts.where(F.col("date") == m).write.parquet(p)
        paths.append(p)
    stock_path = str(tmp_path / "stock.parquet")
    stock.write.parquet(stock_path)
    panel = jobs.build_yearly_panel(spark, paths, stock_path, str(tmp_path / "panel"))
    n = panel.count()
    assert n > 0 and "year" in panel.columns
    tables = jobs.distribution_tables(io.read_panel(spark, str(tmp_path / "panel")))
    assert tables["maturity_table"].count() == 10 * 2 * 6
    assert tables["volume_distribution_panel"].count() > 0
    study = jobs.discontinuity_study(panel.drop("year"), io.read_stock_daily(spark, stock_path),
                                     maturities=("30_90_days", "90_120_days", "120_days"),
                                     cutoffs={"customer_100": 8.0, "professional": 8.0, "firm": 8.0},
                                     price_grid=(7.5, 8.5, 11))
    coef = study["coefficients"].collect()
    assert {r.term for r in coef} == {"Intercept", "Z", "Xc", "Z:Xc"}
    assert study["optimal_cutoff"].count() == study["coefficients"].select("model").distinct().count()
    assert study["model_comparison"].count() == 11
