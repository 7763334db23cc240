import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from market_fixtures import bars_of
from marketframe.operators import drift as DR


def _feat(spark, rows):
    return spark.createDataFrame(rows, "Ticker string, Date date, x double")


def test_known_shift(spark):
    d0 = dt.date(2024, 1, 1)
    ref = _feat(spark, [("A", d0 + dt.timedelta(days=k), float(v)) for k, v in enumerate([1, 2, 3, 4, 5])])
    cur = _feat(spark, [("A", d0 + dt.timedelta(days=10 + k), float(v)) for k, v in enumerate([2, 3, 4, 5, 6])])
    rep = DR.report(DR.profile(ref, cur, ["x"]), 0.05).collect()[0]
    assert rep.mean_shift == pytest.approx(1 / 3)
    assert rep.std_shift == pytest.approx(0.0)
    exp_q = np.mean([abs(1 / (q + 1e-6)) for q in (2, 3, 4)])
    assert rep.percentile_shift == pytest.approx(exp_q)
    assert rep.drift_detected and rep.max_shift == pytest.approx(exp_q)


def test_one_row_period_and_absent_feature(spark):
    d0 = dt.date(2024, 1, 1)
    ref = _feat(spark, [("A", d0, 1.0), ("A", d0 + dt.timedelta(days=1), 1.0)])
    cur = _feat(spark, [("A", d0 + dt.timedelta(days=5), 1.0)])
    prof = DR.profile(ref, cur, ["x", "missing"])
    rep = DR.report(prof).collect()
    assert len(rep) == 1 and rep[0].std_shift is None and not rep[0].drift_detected


def _bars(spark, spans):
    """spans: ticker -> list of (day offset, close)."""
    d0 = dt.date(2024, 1, 1)
    return bars_of(spark, [(d0 + dt.timedelta(days=k), t, c, c + 1, c - 1, c, 100) for t, days in spans.items() for k, c in days])


REF, CUR = ("2024-01-01", "2024-01-10"), ("2024-02-01", "2024-02-10")


def test_summary_and_skipped_of_short_and_missing_periods(spark):
    spans = {"A": [(k, 10.0) for k in range(10)] + [(31 + k, 20.0) for k in range(10)],
             "B": [(0, 10.0), (31, 10.0)],                       # too short for any indicator
             "C": [(31 + k, 10.0) for k in range(10)],           # no reference period
             "D": [(20, 10.0)]}                                  # in neither period
    d = DR.detect(_bars(spark, spans), ["sma_5", "nope"], *REF, *CUR)
    s = {r.Ticker: r for r in d.summary.collect()}
    assert s["A"].drift_detected and s["A"].message == "Drift detected in 1/1 features"
    # rows in both periods but no defined value: no drift, zero features
    assert not s["B"].drift_detected and s["B"].n_features == 0 and s["B"].message == "No significant drift detected"
    for t in "CD":
        assert not s[t].drift_detected and s[t].message == "Insufficient data for drift detection"
    assert {(r.Ticker, r.feature, r.reason) for r in d.skipped.collect()} == {
        ("A", "nope", "not computed"), ("B", "nope", "not computed"), ("C", "nope", "not computed"), ("D", "nope", "not computed"),
        ("B", "sma_5", "no values in reference"), ("C", "sma_5", "no values in reference"), ("D", "sma_5", "no values in reference")}


def test_overlapping_periods_count_a_day_in_both(spark):
    spans = {"A": [(k, 10.0 + k) for k in range(10)]}
    tagged = DR.periods(_bars(spark, spans), ("2024-01-01", "2024-01-06"), ("2024-01-05", "2024-01-08"))
    assert {r.period: r["count"] for r in tagged.groupBy("period").count().collect()} == {"ref": 6, "cur": 4}


def test_detect_on_bars(spark):
    d0 = dt.date(2024, 1, 1)
    rows = [(d0 + dt.timedelta(days=k), "A", 10.0, 11.0, 9.0, 10.0 + (k if k >= 40 else 0), 100) for k in range(80)]
    rep, summ, _ = DR.detect(bars_of(spark, rows), ["sma_5", "returns"], "2024-01-01", "2024-02-09",
                          "2024-02-10", "2024-03-20")
    r = {x.feature: x for x in rep.collect()}
    assert r["sma_5"].drift_detected
    assert summ.collect()[0].n_features == 2
