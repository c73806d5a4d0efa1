"""The monthly stream equals the batch panel over all months."""

from pyspark.sql import functions as F

from tiltkit.operators import panel as pnl
from tiltkit.sources import starschema as ss
from tiltkit.sources import io
from tiltkit.streaming import compact_stream_panel, panel_stream, read_stream_panel

from .conftest import SF001


def test_stream_equals_batch(spark, tmp_path):
    opts = ss.option_month(spark, SF001).where(F.col("date") < "1995-04-01")
    stock = ss.stock_daily(spark, SF001)
    src = tmp_path / "months"
    months = sorted(r.date for r in opts.select("date").distinct().collect())
    assert len(months) == 3
    for m in months:  # one parquet file per month, like the study's inputs
        opts.where(F.col("date") == m).coalesce(1).write.parquet(str(src / f"m={m}"))
    # the file source reads plain files of one folder: move them up
    import shutil
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, m in enumerate(months):
        for f in (src / f"m={m}").glob("*.parquet"):
            shutil.copy(f, flat / f"month_{i}.parquet")
    q = panel_stream(spark, str(flat), stock, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None
    got = read_stream_panel(spark, str(tmp_path / "out"))
    want = pnl.yearly_panel(opts, stock)
    cols = sorted(want.columns)
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 3
    # restart from the checkpoint: nothing is reprocessed or duplicated
    q2 = panel_stream(spark, str(flat), stock, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q2.awaitTermination(300)
    assert q2.exception() is None
    assert read_stream_panel(spark, str(tmp_path / "out")).count() == want.count()
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 3


def _same(a, b):
    cols = sorted(b.columns)
    rounded = lambda d: d.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in sorted(d.dtypes)])
    return a.count() == b.count() and rounded(a.select(*cols)).exceptAll(rounded(b.select(*cols))).count() == 0


def test_dates_in_several_files_merge(spark, tmp_path):
    """Every date is in every file, and a group may have volume only in sum of
    its parts; a replayed batch replaces its part."""
    opts = ss.option_month(spark, SF001).where(F.col("date") < "1996-01-01")
    stock = ss.stock_daily(spark, SF001)
    src, out, panel = (str(tmp_path / d) for d in ("files", "out", "panel"))
    for i in range(3):
        opts.where(F.pmod(F.hash("strike_price", "dtm"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(src)
    q = panel_stream(spark, src, stock, out, str(tmp_path / "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None
    want = pnl.yearly_panel(opts, stock)
    assert len(list((tmp_path / "out").glob("batch_id=*"))) == 3
    parts = spark.read.parquet(out)
    assert parts.groupBy("date").agg(F.countDistinct("batch_id").alias("n")).where("n > 1").count() > 3
    assert _same(read_stream_panel(spark, out), want) and want.count() > 0
    # a batch written again, as after a failure between its output and its commit
    part = f"{out}/batch_id=1"
    again = spark.createDataFrame(spark.read.parquet(part).toPandas(), spark.read.parquet(part).schema)
    again.write.mode("overwrite").partitionBy("year").parquet(part)
    assert _same(read_stream_panel(spark, out), want)
    compact_stream_panel(spark, out, panel)
    assert _same(io.read_panel(spark, panel).drop("year"), want)


def test_having_is_judged_on_whole_sums(spark, tmp_path):
    """Parts without volume are kept as parts, and dropped in the panel."""
    opts = ss.option_month(spark, SF001).where(F.col("date") == "1995-01-01")
    zero = opts.withColumns({c: F.lit(0.0) for c in opts.columns if c.endswith("_volume") or "_volume_" in c})
    src, out = str(tmp_path / "files"), str(tmp_path / "out")
    opts.coalesce(1).write.mode("append").parquet(src)
    zero.coalesce(1).write.mode("append").parquet(src)
    panel_stream(spark, src, ss.stock_daily(spark, SF001), out, str(tmp_path / "ckpt")).awaitTermination(300)
    assert _same(read_stream_panel(spark, out), pnl.yearly_panel(opts, ss.stock_daily(spark, SF001)))
