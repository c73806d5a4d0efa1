"""Plan-shape checks and the driver contract."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tiltkit.operators import imbalance as imb
from tiltkit.operators import panel as pnl
from tiltkit.operators.joins import KeySet
from tiltkit.plans import catalog, registry, stored
from tiltkit.sources import io
from tiltkit.sources import starschema as ss

from .conftest import SF001

PY_UDF = re.compile(r"ArrowEvalPython|BatchEvalPython|PythonUDF|FlatMapGroupsInPandas|MapInPandas")
UDF_KEYS: set[str] = set()  # none: the p-value is a SQL expression too


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def built(spark):
    return {k: q(spark, SF001) for k, q in registry.queries().items()}


def test_every_query_has_an_oracle():
    qs, sql = registry.queries(), registry.oracles()
    assert set(sql) <= set(qs) <= set(E.queries())
    assert set(qs) == set(sql)


def test_no_python_udf_anywhere(built):
    for k, df in built.items():
        plan = _physical(df)
        if k not in UDF_KEYS:
            assert not PY_UDF.search(plan), k


def test_no_round_robin_exchange(built):
    for k, df in built.items():
        assert "RoundRobin" not in _physical(df) + _optimized(df), k


def test_no_cartesian_products(built):
    for k, df in built.items():
        plan = _physical(df) + _optimized(df)
        assert "CartesianProduct" not in plan and "Join Cross" not in plan, k
        assert "BroadcastNestedLoopJoin" not in plan, k


def test_semi_join_below_aggregate(spark):
    opts = ss.option_month(spark, SF001)
    plan = _optimized(pnl.yearly_panel(opts, ss.stock_daily(spark, SF001)))
    agg = plan.index("Aggregate [date")
    semi = plan.index("Join LeftSemi")
    assert semi > agg  # printed below the panel aggregate = evaluated before it


def test_scans_prune_columns_and_push_filters(spark):
    df = E.queries()["stock_panel_join"](spark, SF001)
    plan = _physical(df)
    assert "PushedFilters: [IsNotNull(l_orderkey), IsNotNull(l_partkey)]" in plan or \
        "IsNotNull(l_orderkey)" in plan
    # lineitem has 11 columns; the option view reads 9, the stock view 4
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        if "l_orderkey" in schema:
            assert "l_suppkey" not in schema and "l_linenumber" not in schema
    part = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "p_brand" in s]
    assert part and all("p_name" not in s and "p_type" not in s for s in part)
    assert "Not(p_brand IN" in plan or "NOT p_brand IN" in plan or "Not(In(p_brand" in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cp_flag", "investor", "x", "itm_otm"]
    assert df.count() > 0


def test_panel_sink_roundtrip(spark, tmp_path):
    panel = pnl.yearly_panel(ss.option_month(spark, SF001), ss.stock_daily(spark, SF001))
    path = str(tmp_path / "open_volume")
    io.write_panel(panel, path)
    back = io.read_panel(spark, path, years=[1996])
    plan = _physical(back)
    assert "PartitionFilters: [isnotnull(year" in plan and "= 1996" in plan
    assert back.count() == panel.where(F.year("date") == 1996).count() > 0
    # every file is sorted, and the files of a year cover ranges that do not overlap
    spans = {}
    for f in sorted(tmp_path.glob("open_volume/year=*/*.parquet")):
        rows = [tuple((v is not None, v) for v in r) for r in spark.read.parquet(str(f)).select(*io.PANEL_SORT).collect()]
        assert rows == sorted(rows), f
        spans.setdefault(f.parent.name, []).append((rows[0], rows[-1]))
    assert len(spans) > 1
    for ends in spans.values():
        ends.sort()
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    csv = str(tmp_path / "csv")
    io.write_csv(panel.limit(5), csv)
    assert spark.read.option("header", True).csv(csv).count() == 5


def _month_file(spark, path, dtm_type, delta):
    from tiltkit.schema import OPTION_MONTH

    cols = {"date": "date'2014-01-02'", "ticker": "'A'", "cp_flag": "'C'", "dtm": f"cast(7 as {dtm_type})",
            "delta": f"double('{delta}')"}
    spark.range(3).selectExpr(*[f"{cols.get(f.name, 'cast(1.5 as double)')} AS {f.name}" for f in OPTION_MONTH.fields]) \
        .write.parquet(path)


def test_months_of_mixed_types_and_nan(spark, tmp_path):
    from tiltkit.schema import OPTION_MONTH

    paths = [str(tmp_path / f"m{i}") for i in range(3)]
    for p, (kind, delta) in zip(paths, (("bigint", "50"), ("int", "NaN"), ("double", "45"))):
        _month_file(spark, p, kind, delta)
    got = io.read_months(spark, paths)
    assert [f.dataType for f in got.schema.fields] == [f.dataType for f in OPTION_MONTH.fields]
    assert got.count() == 9 and got.where("delta IS NULL").count() == 3 and got.where("dtm = 7").count() == 9


def test_no_task_writes_a_whole_month(spark, tmp_path):
    """A month larger than a partition is dealt to several tasks; all rows arrive in their months."""
    rows = spark.range(0, 80_000, 1, 8).selectExpr("id", "uuid() AS x", "if(id % 1000 = 0, 2, 1) AS month")
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(name)
    spark.conf.set(name, "512k")
    try:
        io.write_months(rows, str(tmp_path / "months"))
    finally:
        spark.conf.set(name, was)
    back = spark.read.parquet(str(tmp_path / "months"))
    assert back.selectExpr("sum(id)", "count_if(month = if(id % 1000 = 0, 2, 1))").first() == (80_000 * 79_999 // 2, 80_000)
    files = back.groupBy(F.input_file_name().alias("f")).count().collect()
    assert max(r["count"] for r in files) <= 40_000


def test_impossible_type_is_an_error(spark, tmp_path):
    path = str(tmp_path / "bad")
    _month_file(spark, path, "string", "1")
    with pytest.raises(ValueError, match="dtm"):
        io.read_months(spark, path)


def test_cluster_without_checkpoint_folder_is_an_error():
    from unittest import mock

    from tiltkit.session import ensure_checkpoint_dir

    fake = mock.MagicMock()
    fake.conf.get.return_value = None
    fake.sparkContext.getCheckpointDir.return_value = None
    fake.sparkContext.getConf.return_value.get.return_value = None
    fake.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(fake)


@pytest.fixture()
def no_auto_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, was)


@pytest.fixture(scope="module")
def raw_options(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("raw") / "options")
    ss.option_month(spark, SF001).write.parquet(path)
    return spark.read.parquet(path)


def _shuffles_above_scan(plan: str) -> int:
    """Shuffles between the option scan and the first aggregation above it."""
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in plan.split("\n")]
    scan = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "customer_open_buy_volume" in line or "Scan parquet" in line and "ticker" in line)
    above = []
    for line in reversed(lines[:scan]):
        if line.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
            break
        above.append(line)
    return sum(line.startswith("Exchange") for line in above)


@pytest.mark.parametrize("most_keys", [1_000_000, 0])
def test_universe_filter_moves_no_raw_row(spark, raw_options, no_auto_broadcast, most_keys):
    """A small set is broadcast by its checked size, a larger one as a filter
    below the panel's aggregation."""
    stock = ss.stock_daily(spark, SF001)
    keys = KeySet(stock, "ticker", most_keys=most_keys)
    assert keys.small == (most_keys > 0) and keys.count == stock.select("ticker").distinct().count()
    panel = pnl.yearly_panel(raw_options, keys)
    assert _shuffles_above_scan(_physical(panel)) == 0 and "BroadcastHashJoin" in _physical(panel)
    want = {(r.ticker, r.date): r.n for r in pnl.aggregate_panel(pnl.classify_options(raw_options)).groupBy("ticker", "date").agg(
        F.count("*").alias("n")).collect()}
    got = {(r.ticker, r.date): r.n for r in panel.groupBy("ticker", "date").agg(F.count("*").alias("n")).collect()}
    names = {r.ticker for r in stock.select("ticker").distinct().collect()}
    assert got == {k: n for k, n in want.items() if k[0] in names} and len(got) < len(want)
    if most_keys:
        rows = pnl.universe_rows(raw_options, stock)
        assert _shuffles_above_scan(_physical(rows)) == 0


def test_filter_of_a_large_key_set_loses_nothing(spark):
    keys = KeySet(spark.range(0, 20_000, 2).selectExpr("id AS k", "id % 7 AS g"), ["k", "g"], most_keys=10)
    big = spark.range(20_000).selectExpr("id AS k", "id % 7 AS g", "id AS v").unionByName(
        spark.createDataFrame([(None, 1, 5), (4, None, 6)], "k long, g long, v long"))
    for n_words in (None, 1, 64):
        assert keys.might_hold(big, n_words).where("v % 2 = 0 AND k IS NOT NULL AND g IS NOT NULL AND v = k").count() == 10_000
    assert keys.might_hold(big).count() < 12_000
    assert sorted(r.v for r in keys.semi_join(big).collect()) == list(range(0, 20_000, 2))
    assert KeySet(spark.createDataFrame([], "k long"), "k").semi_join(big).count() == 0


def test_repeated_stock_key_is_an_error(spark, raw_options):
    panel = pnl.aggregate_panel(pnl.classify_options(raw_options))
    stock = ss.stock_daily(spark, SF001)
    twice = stock.unionByName(stock.where("ticker = 'Brand#11'").limit(1))
    with pytest.raises(Exception, match="stock panel: more than one row for date=.*, ticker=Brand#11"):
        imb.join_stock_panel(panel, twice).agg(F.sum("prc")).collect()
    # a result that needs no stock value needs no join, and has no row too many
    assert imb.join_stock_panel(panel, twice).count() == panel.count()
    nulls = spark.createDataFrame([(None, "Brand#11", "c", 1.0, 2.0)] * 2, stock.schema)
    joined = imb.join_stock_panel(panel, stock.unionByName(nulls))
    assert joined.count() == panel.count()
    # one read of the panel and one aggregation of the stock rows
    assert _physical(imb.join_stock_panel(raw_options.select("date", "ticker"), stock)).count("customer_open") == 0


def test_bucketed_join_moves_no_row(spark):
    panel, stock = catalog.panel(spark, SF001), catalog.stock(spark, SF001)
    joined = stored.bucketed_stock_join(spark, panel, stock)
    plan = _physical(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "SelectedBucketsCount" in plan
    assert joined.count() == panel.count()


def test_listed_years_prune_while_running(spark):
    plan = _physical(stored.q_panel_of_listed_years(spark, SF001))
    assert "dynamicpruning" in plan.lower()
    df = stored.q_panel_of_listed_years(spark, SF001)
    df.collect()
    assert df.count() > 0
