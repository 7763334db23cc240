"""Plan-shape checks: the properties the design relies on at scale."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as E
from market_fixtures import SF001

from marketframe.plans import catalog

# queries that run fits or store writes when they are built
EAGER = {"forest_metrics", "gbt_metrics", "train_summary", "runs_append", "runs_compare", "ingest_stream", "predict_linear",
         "predict_latest", "bars_upsert", "feature_store_put", "feature_store_get", "feature_store_delete", "latency_percentile",
         "boosted_stumps", "leafwise_metrics", "store_latest_bars", "features_incremental", "drift_from_profiles",
         "train_join_bucketed", "bars_datasource"}


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def q(spark, name):
    return plan(E.queries()[name](spark, SF001))


def exchanges(txt):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)\(([^)]*)", txt)


@pytest.mark.parametrize("name", ["feat_sma_20", "feat_macd_signal", "features_all", "features_default"])
def test_feature_plans_shuffle_twice(spark, name):
    """ticks -> (Ticker, Date) with partial aggregation, then bars -> Ticker; nothing else."""
    txt = q(spark, name)
    ex = exchanges(txt)
    assert len(ex) == 2, ex
    assert ex[0][1].startswith("Ticker") and "Date" not in ex[0][1]
    assert "partial_max_by" in txt and "SortAggregate" not in txt
    assert "InPandas" not in txt and "EvalPython" not in txt


@pytest.mark.parametrize("name", ["ols_fit", "ols_fit_2", "regression_metrics"])
def test_linear_model_plans_stay_in_the_jvm(spark, name):
    txt = q(spark, name)
    assert "InPandas" not in txt and "EvalPython" not in txt
    assert len(exchanges(txt)) <= 2
    assert len(re.findall(r"FileScan parquet", txt)) == 1


def test_drift_is_one_feature_plan(spark):
    txt = q(spark, "drift_report")
    ticker_period = [e for e in exchanges(txt) if e[1].startswith("Ticker") and "period" in e[1]]
    assert len(ticker_period) == 1


@pytest.mark.parametrize("name", ["drift_report", "drift_summary", "drift_skipped", "ingest_rejected", "features_brands"])
def test_raw_ticks_are_read_and_hash_aggregated_once(spark, name):
    """One scan of the ticks (and one of the parts where brands are tickers, or of
    nothing but the tickers where all of them are listed)."""
    txt = q(spark, name)
    listing = name in ("drift_summary", "drift_skipped")
    assert len(re.findall(r"FileScan parquet", txt)) == (2 if listing or name in ("ingest_rejected", "features_brands") else 1)
    if listing:
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", txt)
        assert any("date" not in x and "price" not in x for x in schemas)
    assert "SortAggregate" not in txt.split("Generate")[-1]
    assert "SinglePartition" not in txt


def test_drift_windows_see_only_the_two_periods(spark):
    """The date bounds stand between the scan and the first exchange."""
    txt = q(spark, "drift_report")
    scan = txt.index("FileScan parquet")
    first_exchange = txt.rindex("Exchange hashpartitioning", 0, scan)
    assert re.search(r"Filter [^\n]*1997-01-01|Filter [^\n]*>= 9862", txt[first_exchange:scan])


def test_ingest_is_one_batch_pass(spark):
    txt = q(spark, "ingest_accepted")
    assert len(re.findall(r"FileScan parquet", txt)) == 2 and len(exchanges(txt)) <= 4
    assert "SinglePartition" not in txt


def test_filters_reach_the_scan(spark):
    txt = q(spark, "features_range_slice")
    assert re.search(r"PushedFilters: \[[^\]]*In\(o_orderpriority", txt)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:[a-z_]+,o_orderpriority:string>", txt)


def test_no_cross_joins_anywhere(spark):
    for name in catalog.QUERIES:
        if name in EAGER:
            continue
        txt = q(spark, name)
        assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt, name


def test_bucketed_join_has_no_exchange(spark):
    txt = q(spark, "train_join_bucketed")
    assert "Exchange" not in txt and "SortMergeJoin" in txt and txt.count("Bucketed: true") == 2
